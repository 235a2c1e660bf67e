"""Groups, folds, ranking quality, rankers and explanations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shortlist.operators import ltr
from shortlist.sources import files

FEATURES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    data = []
    for i in range(150):
        values = [draw.random() for _ in FEATURES]
        data.append((f"CAND_{i:07d}", *values, min(3, int(values[0] * 4)), 1))
    return spark.createDataFrame(data, "candidate_id string, " + ", ".join(f"{f} double" for f in FEATURES) + ", label int, group_id bigint")


def test_manual_labels_win(spark):
    pseudo = spark.createDataFrame([("a", 0), ("b", 1)], "candidate_id string, label int")
    manual = spark.createDataFrame([("a", 3)], "candidate_id string, label int")
    assert [tuple(r) for r in ltr.preferred_labels(manual, pseudo).collect()] == [("a", 3)]
    assert ltr.preferred_labels(manual.where("false"), pseudo).count() == 2
    assert ltr.preferred_labels(None, pseudo).count() == 2


def test_groups_of_one_hundred(spark, rows):
    groups = ltr.synthetic_groups(rows.drop("group_id"))
    assert sorted(r["size"] for r in ltr.group_sizes(groups).collect()) == [50, 100]
    first = groups.where("group_id = 0").agg(F.max("candidate_id")).first()[0]
    assert first == "CAND_0000099"
    wide = spark.range(0, 30000).select(F.format_string("CAND_%07d", F.col("id") * 331 % 9999991).alias("candidate_id"))
    numbered = ltr.synthetic_groups(wide).orderBy("candidate_id").select("group_id").collect()
    assert [r[0] for r in numbered] == [i // 100 for i in range(30000)]


def test_given_groups_are_kept_when_there_are_enough(spark, rows):
    assert ltr.prepare_groups(rows, 3).select("group_id").distinct().count() == 2
    many = rows.withColumn("group_id", F.pmod(F.xxhash64("candidate_id"), F.lit(6)))
    assert ltr.prepare_groups(many, 3).select("group_id").distinct().count() == many.select("group_id").distinct().count()


def test_folds_are_whole_groups_and_balanced(spark):
    df = spark.range(2000).select(F.floor(F.sqrt(F.col("id"))).alias("group_id"))
    folds = ltr.group_folds(df, 5)
    sizes = {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.sum("size").alias("n")).collect()}
    assert set(sizes) == set(range(5)) and sum(sizes.values()) == 2000
    biggest = folds.agg(F.max("size")).first()[0]
    assert max(sizes.values()) - min(sizes.values()) <= biggest
    assert folds.count() == folds.select("group_id").distinct().count()


def greedy(sizes, k):
    """The plain loop: every group to the lightest fold."""
    loads, out = [0] * k, {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold = loads.index(min(loads))
        loads[fold] += size
        out[name] = fold
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_packing_equals_the_plain_loop(k):
    draw = random.Random(k)
    for _ in range(200):
        histogram = {draw.choice([1, 2, 3, 5, 7, 50, 1000]): draw.choice([1, 2, 3, 9, 40]) for _ in range(draw.randint(1, 6))}
        sizes = {f"{size:05d}-{i:05d}": size for size, n in histogram.items() for i in range(n)}
        got = {}
        for size, start, stop, folds in ltr.packed(list(histogram.items()), k):
            for i in range(start, stop):
                got[f"{size:05d}-{i:05d}"] = folds[(i - start) % len(folds)]
        assert got == greedy(sizes, k)


def test_packing_makes_no_step_per_group():
    runs = ltr.packed([(3, 10**12), (1000, 7), (1, 10**13)], 5)
    assert len(runs) <= 15 and sum(stop - start for _, start, stop, _ in runs) == 11 * 10**12 + 7


def test_folds_take_text_ids_and_skewed_groups(spark):
    draw = random.Random(1)
    sizes = {f"g{i}": draw.choice([1, 1, 2, 3, 30]) for i in range(300)} | {"hot": 900}
    rows = [(name,) for name, n in sizes.items() for _ in range(n)]
    found = ltr.group_folds(spark.createDataFrame(rows, "group_id string"), 4).collect()
    assert {r.group_id: r.fold for r in found} == greedy(sizes, 4) and len(found) == len(sizes)


def test_ndcg_equals_the_definition(spark):
    draw = random.Random(3)
    data = [(g, f"c{i}", draw.choice([0, 0, 1, 2, 3]), draw.random()) for g in range(4) for i in range(60)]
    data += [(9, f"z{i}", 0, draw.random()) for i in range(5)]
    df = spark.createDataFrame(data, "group_id int, candidate_id string, label int, score double")
    got = {r["group_id"]: r for r in ltr.ndcg(df).collect()}
    for g in (0, 1, 2, 3):
        mine = [(lab, s) for gg, _, lab, s in data if gg == g]
        for k in (10, 50):
            dcg = lambda labs: sum((2**lab - 1) / math.log2(i + 2) for i, lab in enumerate(labs[:k]))  # noqa: E731, B023
            want = dcg([lab for lab, _ in sorted(mine, key=lambda x: -x[1])]) / dcg(sorted((lab for lab, _ in mine), reverse=True))
            assert got[g][f"ndcg_at_{k}"] == pytest.approx(want)
    assert got[9]["ndcg_at_10"] == 1.0
    assert ltr.mean_ndcg(df).first()["groups"] == 5


def test_ranker(spark, rows, tmp_path):
    params = ltr.RankerParams(trees=5, depth=3)
    frame = ltr.prepare_groups(rows, 3)
    scores = ltr.cross_validate(frame, FEATURES, k=3, params=params).collect()
    assert len(scores) == 2  # two groups fill two folds
    assert all(r["ndcg_at_10"] > r["random_ndcg"] for r in scores)
    model = ltr.fit_ranker(frame, FEATURES, params)
    importance = ltr.feature_importance(model, FEATURES, spark)
    assert importance.count() == 5 and importance.first()["feature"] == "f0"
    lost = ltr.permutation_importance(model, frame, FEATURES, exchange=FEATURES[:2]).collect()
    assert lost[0]["feature"] == "f0" and lost[0]["importance"] > 0
    predicted = ltr.predict(model, frame, FEATURES, "prediction_score")
    files.write_predictions(predicted, str(tmp_path / "pred"))
    assert spark.read.csv(str(tmp_path / "pred"), header=True).columns == ["candidate_id", "label", "prediction_score"]
    files.write_importance(importance, str(tmp_path / "imp"))
    back = spark.read.csv(str(tmp_path / "imp"), header=True, inferSchema=True).collect()
    assert [r["importance"] for r in back] == sorted((r["importance"] for r in back), reverse=True)


def test_no_model_or_wrong_columns_fall_back_to_the_weighted_sum(spark, rows):
    names = ["embedding_similarity", "years_experience_score", "recruiter_response_rate", "production_ml_score",
             "startup_score", "career_growth_score"]
    df = spark.range(1).select(*[F.lit(1.0).alias(n) for n in names])
    assert ltr.predict_or_weighted(None, df, names).first()["score"] == pytest.approx(1.0)
    model = ltr.fit_ranker(rows, FEATURES, ltr.RankerParams(trees=1, depth=2))
    assert ltr.predict_or_weighted(model, df, names).first()["score"] == pytest.approx(1.0)
    assert ltr.predict_or_weighted(model, rows, FEATURES).first()["score"] is not None


def test_linear_contributions_sum_to_the_difference_from_the_mean(spark, rows):
    weights = {"f0": 0.7, "f1": 0.3}
    long = ltr.linear_contributions(rows, weights)
    assert long.agg(F.sum("contribution")).first()[0] == pytest.approx(0.0, abs=1e-9)
    assert {r["feature"] for r in ltr.mean_abs_contributions(long).collect()} == set(weights)


def test_feature_columns(rows):
    assert ltr.feature_columns(rows) == FEATURES
