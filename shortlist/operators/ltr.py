"""Training data, folds, ranking quality and rankers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.operators.positions import with_positions
from shortlist.operators.scoring import weighted_score
from shortlist.session import checkpointing, staged

# --- training frame -----------------------------------------------------------------------


def preferred_labels(manual: DataFrame | None, pseudo: DataFrame) -> DataFrame:
    """Hand-made labels where there are any at all, otherwise the generated ones."""
    columns = ["candidate_id", "label"]
    if manual is None:
        return pseudo.select(*columns)
    has_manual = manual.agg(F.count("*") > 0).scalar()
    return manual.select(*columns).unionByName(pseudo.where(~has_manual).select(*columns))


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the candidate; score columns of the label table stay out."""
    return features.join(labels.select("candidate_id", "label"), "candidate_id")


def feature_columns(df: DataFrame, extra: tuple[str, ...] = ("group_id", "fold")) -> list[str]:
    """Numeric columns that may be learned from."""
    excluded = {*vocab.NON_FEATURE_COLUMNS, *extra}
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [name for name, kind in df.dtypes if kind in numeric and name not in excluded]


# --- positions, groups and folds ------------------------------------------------------------


def row_index(df: DataFrame, buckets: list[Column], order: list[Column], out: str = "row_index") -> DataFrame:
    """0-based position of every row in the order of ``buckets`` and then ``order``, without one big sort.

    Rows are numbered inside their bucket and shifted by the rows of all earlier buckets. Only
    the bucket counts, one small row each, meet in a single window. The caller picks buckets
    that follow the order and are not too large.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    placed = df.select("*", *[b.alias(n) for b, n in zip(buckets, names, strict=True)])
    counts = placed.groupBy(*names).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*names).orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, names)
        .withColumn(out, F.col("_before") + F.col("_rn") - 1)
        .drop(*names, "_rn", "_before")
    )


def synthetic_groups(df: DataFrame, size: int = 100, id_col: str = "candidate_id") -> DataFrame:
    """Query groups of ``size`` rows in id order. Ids are numbered in ranges, so ids of any form spread over tasks."""
    rest = [F.xxhash64(*[c for c in df.columns if c != id_col])] if len(df.columns) > 1 else []
    indexed = with_positions(df, [F.col(id_col), *rest], "_i")
    return indexed.withColumn("group_id", F.floor(F.col("_i") / size).cast("bigint")).drop("_i")


def group_sizes(df: DataFrame, group: str = "group_id") -> DataFrame:
    """W8."""
    return df.groupBy(group).agg(F.count("*").alias("size"))


def packed(histogram: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Which fold takes which group when each in turn goes to the lightest fold, the largest groups first.

    ``histogram`` lists sizes with their numbers of groups. The result lists runs ``(size, start, stop, folds)``: the groups
    of a size numbered from ``start`` up to ``stop`` (from 0, exclusive) go to ``folds`` in turn. Among folds of equal weight the first is the
    lightest. No step is made per group: with groups of size s a fold of load L is the lightest at L, L + s, L + 2s, ..., and
    folds take turns in the order of these numbers. From a fold's level L // s on it takes part in every turn, in the order of L % s.
    """
    loads, runs = [0] * k, []
    for size, groups in sorted(histogram, reverse=True):
        entry = sorted((load // size, fold) for fold, load in enumerate(loads))
        taken, at = [0] * k, 0
        for i, (level, _) in enumerate(entry):
            active = sorted((fold for _, fold in entry[: i + 1]), key=lambda fold: (loads[fold] % size, fold))
            turns = entry[i + 1][0] - level if i + 1 < k else -(-(groups - at) // k)
            stop = min(groups, at + turns * len(active))
            if stop > at:
                runs.append((size, at, stop, active))
                whole, rest = divmod(stop - at, len(active))
                for place, fold in enumerate(active):
                    taken[fold] += whole + (place < rest)
                at = stop
            if at == groups:
                break
        loads = [load + size * n for load, n in zip(loads, taken)]
    return runs


def group_folds(df: DataFrame, k: int = 5, group: str = "group_id") -> DataFrame:
    """``(group, size, fold)``; every group in turn, largest first and then by id, goes to the fold with the fewest rows.

    The packing runs on the histogram of sizes, which has at most about the square root of twice the rows as entries. Groups of a size are
    numbered in ranges of the ids, of whatever type.
    """
    sizes = group_sizes(df, group)
    histogram = [(r["size"], r["groups"]) for r in sizes.groupBy("size").agg(F.count("*").alias("groups")).collect()]
    larger, first = 0, {}
    for size, groups in sorted(histogram, reverse=True):
        first[size] = larger
        larger += groups
    numbered = with_positions(sizes, [F.desc("size"), F.col(group)], "_i")
    rows = [(size, start, stop, first[size], folds) for size, start, stop, folds in packed(histogram, k)]
    runs = df.sparkSession.createDataFrame(rows, "size long, _start long, _stop long, _first long, _folds array<int>")
    place = F.col("_i") - F.col("_first")
    found = numbered.join(runs, "size").where((place >= F.col("_start")) & (place < F.col("_stop")))
    fold = F.get("_folds", F.pmod(place - F.col("_start"), F.size("_folds")).cast("int"))
    return found.select(group, "size", fold.alias("fold"))


def usable_folds(df: DataFrame, k: int, group: str = "group_id") -> int:
    """The number of folds the data can fill: never more than there are groups."""
    return min(k, df.select(group).distinct().limit(k).count())


def prepare_groups(df: DataFrame, k: int = 5, group: str = "group_id", size: int = 100) -> DataFrame:
    """Keep the given groups if there are at least ``k``, else make synthetic ones."""
    if group in df.columns and usable_folds(df, k, group) >= k:
        return df
    return synthetic_groups(df.drop(group), size)


# --- ranking quality ------------------------------------------------------------------------


def ndcg(df: DataFrame, ks: tuple[int, ...] = (10, 50), group: str = "group_id", label: str = "label",
         score: str = "score", id_col: str = "candidate_id") -> DataFrame:
    """``(group, ndcg_at_k...)`` with gain ``2^label - 1`` and log2 discount.

    A group without any gain counts as 1. Only the ``max(ks)`` best rows by score and by label
    of a group take part, and each task drops the others before the shuffle.
    """
    depth = max(ks)

    def gains(order: Column, name: str) -> DataFrame:
        window = Window.partitionBy(group).orderBy(order, F.asc(id_col))
        top = df.select(group, id_col, label, score).withColumn("_at", F.row_number().over(window))
        gain = (F.pow(F.lit(2.0), F.col(label)) - 1.0) / F.log2(F.col("_at") + 1.0)
        return (
            top.where(F.col("_at") <= depth)
            .groupBy(group)
            .agg(*[F.sum(F.when(F.col("_at") <= k, gain).otherwise(0.0)).alias(f"{name}_{k}") for k in ks])
        )

    joined = gains(F.desc(score), "dcg").join(gains(F.desc(label), "ideal"), group)
    return joined.select(
        group,
        *[
            F.when(F.col(f"ideal_{k}") == 0, 1.0)
            .otherwise(F.try_divide(F.col(f"dcg_{k}"), F.col(f"ideal_{k}")))
            .alias(f"ndcg_at_{k}")
            for k in ks
        ],
    )


def mean_ndcg(df: DataFrame, ks: tuple[int, ...] = (10, 50), **columns) -> DataFrame:
    per_group = ndcg(df, ks, **columns)
    return per_group.agg(
        F.count("*").alias("groups"), *[F.avg(f"ndcg_at_{k}").alias(f"ndcg_at_{k}") for k in ks]
    )


# --- rankers --------------------------------------------------------------------------------


@dataclass(frozen=True)
class RankerParams:
    """Boosted trees that predict the label of one row; the prediction is the ranking score."""

    trees: int = 100
    learning_rate: float = 0.05
    depth: int = 5
    seed: int = 42


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return assembler.transform(df.na.fill(0.0, subset=features))


def fit_ranker(df: DataFrame, features: list[str], params: RankerParams = RankerParams(), label: str = "label") -> Model:
    """L1: fit on all rows of ``df``."""
    checkpointing(df.sparkSession)
    learner = GBTRegressor(
        featuresCol="features", labelCol="_y", maxIter=params.trees, stepSize=params.learning_rate,
        maxDepth=params.depth, seed=params.seed, predictionCol="score", checkpointInterval=10,
    )
    return learner.fit(_assembled(df, features).select("features", F.col(label).cast("double").alias("_y")))


def predict(model: Model, df: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    """L2: the model's score for every row."""
    scored = model.transform(_assembled(df.drop("score"), features)).drop("features")
    return scored if out == "score" else scored.withColumnRenamed("score", out)


def predict_or_weighted(model: Model | None, df: DataFrame, features: list[str], weights=None) -> DataFrame:
    """L2: the model's score, or the weighted sum where there is no model or it does not fit the columns."""
    if model is not None and set(features) <= set(df.columns) and model.numFeatures == len(features):
        return predict(model, df, features)
    return df.withColumn("score", weighted_score(weights))


def cross_validate(df: DataFrame, features: list[str], k: int = 5, params: RankerParams = RankerParams(),
                   ks: tuple[int, ...] = (10, 50), group: str = "group_id") -> DataFrame:
    """L1: one row per fold with its quality on held-out groups, next to random order.

    The frame is written once to the shared folder, because every tree of every fold reads it.
    With fewer groups than folds, fewer folds are used.
    """
    k = usable_folds(df, k, group)
    if k < 2:
        raise ValueError("cross-validation needs at least two groups")
    folds = group_folds(df, k, group).select(group, "fold")
    table = staged(df.join(folds, group).select("candidate_id", group, "fold", "label", *features), "ltr")
    out = None
    for fold in range(k):  # a handful of model fits, each a distributed job
        held_out = table.where(F.col("fold") == fold)
        model = fit_ranker(table.where(F.col("fold") != fold), features, params)
        scored = predict(model, held_out, features)
        by_model = mean_ndcg(scored, ks, group=group)
        random_order = held_out.withColumn("score", F.pmod(F.xxhash64("candidate_id"), F.lit(1 << 30)).cast("double"))
        chance = mean_ndcg(random_order, ks[:1], group=group).select(F.col(f"ndcg_at_{ks[0]}").alias("chance"))
        row = by_model.select(F.lit(fold).alias("fold"), "*").withColumn("random_ndcg", chance.scalar())
        out = row if out is None else out.unionByName(row)
    return out


def feature_importance(model: Model, features: list[str], spark) -> DataFrame:
    """L3: ``(feature, importance)`` of a fitted model; one value per feature column."""
    values = [(name, float(model.featureImportances[i])) for i, name in enumerate(features)]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(
        F.desc("importance"), F.asc("feature")
    )


# --- explanations ---------------------------------------------------------------------------


def linear_contributions(df: DataFrame, weights: dict[str, float], id_col: str = "candidate_id") -> DataFrame:
    """L4: exact contributions of a weighted sum, ``w * (value - mean)``, in long form."""
    names = list(weights)
    means = df.agg(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    centred = df.withColumn("_m", means).select(
        id_col, *[(F.lit(weights[n]) * (F.col(n) - F.col(f"_m.{n}"))).alias(n) for n in names]
    )
    return centred.unpivot(id_col, names, "feature", "contribution")


def mean_abs_contributions(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def permutation_importance(model: Model, df: DataFrame, features: list[str], k: int = 10, group: str = "group_id",
                           seed: int = 42, id_col: str = "candidate_id", exchange: list[str] | None = None) -> DataFrame:
    """L4 for trees: the loss of ranking quality when one feature is exchanged between rows.

    Values are exchanged between rows that land at the same position of two hash orders inside
    hash buckets of bounded size, so no global sort or single-task window is needed. ``exchange``
    limits the report to some of the features.
    """
    base = mean_ndcg(predict(model, df, features), (k,), group=group).select(f"ndcg_at_{k}").scalar()
    spark = df.sparkSession
    rows = df.agg(F.count("*").alias("n")).first()["n"]
    buckets = max(1, rows // 10_000)
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(buckets))
    out = None
    for i, name in enumerate(exchange or features):
        give = Window.partitionBy("_b").orderBy(F.xxhash64(F.col(id_col), F.lit(seed + 2 * i + 1)), F.col(id_col))
        take = Window.partitionBy("_b").orderBy(F.xxhash64(F.col(id_col), F.lit(seed + 2 * i + 2)), F.col(id_col))
        placed = df.withColumn("_b", bucket)
        given = placed.select("_b", F.row_number().over(give).alias("_p"), F.col(name).alias("_v"))
        mixed = (
            placed.withColumn("_p", F.row_number().over(take)).drop(name).join(given, ["_b", "_p"])
            .withColumnRenamed("_v", name).drop("_b", "_p")
        )
        score = mean_ndcg(predict(model, mixed, features), (k,), group=group).select(f"ndcg_at_{k}").scalar()
        row = spark.range(1).select(F.lit(name).alias("feature"), (base - score).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("importance"), F.asc("feature"))
