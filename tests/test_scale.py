"""Plans and results that must hold when one group has most of the rows."""

import pytest
from people import frame, person, skill
from pyspark.sql import functions as F

from shortlist.operators import ltr, normalise, positions, ranking, retrieval, screening
from shortlist.plans import catalog, pipeline
from shortlist.plans.warehouse import Warehouse, warehouse
from shortlist.session import spread, staged
from shortlist.sources import tables


def shown(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one id with most of the rows."""
    return spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 97).alias("group_id"),
        F.format_string("CAND_%07d", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))).alias("candidate_id"),
        (F.col("id") % 4).cast("int").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("score"),
        F.col("id").alias("input_pos"),
    )


def test_group_limits_come_before_the_shuffle(spark, skewed, capsys):
    for df in (ltr.ndcg(skewed), ranking.dedupe_best(skewed)):
        plan = shown(df, capsys)
        assert plan.index("WindowGroupLimit") > 0 and "Partial" in plan
    people = frame(spark, [person(1, skills=[skill("python")])])
    assert "WindowGroupLimit" in shown(retrieval.keyword_retrieve(people, ["python"], []), capsys)
    best = retrieval.best_per_query(skewed.withColumn("query_id", F.col("group_id")), "score", "candidate_id", 5)
    assert "WindowGroupLimit" in shown(best, capsys)


def test_hot_id_is_reduced_to_its_best_row(skewed):
    kept = ranking.dedupe_best(skewed)
    assert kept.count() == skewed.select("candidate_id").distinct().count()
    best = skewed.where("candidate_id = 'CAND_0000007'").orderBy(F.desc("score"), "input_pos").first()
    assert kept.where("candidate_id = 'CAND_0000007'").first()["input_pos"] == best["input_pos"]


def test_positions_do_not_depend_on_buckets(skewed):
    rows = skewed.where("input_pos < 3000")
    for size in (10, 700, 100000):
        numbered = ltr.row_index(rows, [F.floor(F.col("input_pos") / size)], [F.col("input_pos")])
        assert numbered.where("row_index <> input_pos").count() == 0


def test_positions_and_pages_of_ranges(spark, skewed):
    rows = skewed.select("candidate_id", "input_pos")
    order = [F.desc("candidate_id"), F.col("input_pos")]
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    placed = positions.with_positions(rows, order, parts=7).collect()
    assert [tuple(r)[:2] for r in sorted(placed, key=lambda r: r.position)] == want and {r.position for r in placed} == set(range(len(want)))
    stored = positions.ranged(rows, order, parts=16)
    for offset, limit in ((0, 10), (13331, 25), (19990, 50), (20000, 5), (0, 0), (5, 18000)):
        assert [tuple(r) for r in positions.page(stored, order, offset, limit).collect()] == want[offset : offset + limit]
    assert positions.page(positions.ranged(rows.limit(0), order), order, 0, 5).count() == 0


def test_a_deep_page_reads_two_ranges_at_most(spark, capsys):
    stored = positions.ranged(spark.range(100_000).select(F.col("id")), [F.col("id")], parts=32)
    plan = shown(positions.page(stored, [F.col("id")], 77_777, 50), capsys)
    numbers = plan.split("PartitionFilters: ")[1].splitlines()[0]
    assert numbers.count(",") <= 3 and "_range" in numbers
    assert [r.id for r in positions.page(stored, [F.col("id")], 77_777, 3).collect()] == [77_777, 77_778, 77_779]


def test_one_query_shuffles_only_term_counts(spark, small, capsys):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    plan = shown(retrieval.bm25_topk(docs, "the nation", 5, "doc_id"), capsys)
    assert plan.count("Scan parquet") <= 4 and "SortMergeJoin" not in plan and "TakeOrderedAndProject" in plan
    assert "hashpartitioning(doc_id" not in plan


def test_rules_read_no_descriptions(spark, small, capsys):
    scored = screening.with_fraud_scores(warehouse(spark, small).candidates, 2026)
    plan = shown(screening.fraud_gate(scored).select("candidate_id"), capsys)
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "career_history:array<struct<title:string" in schema
    assert "description" not in schema and "institution" not in schema and "headline" not in schema


def test_small_scans_are_spread_and_large_ones_left_alone(spark, small):
    scan = spark.read.parquet(f"{small}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert spread(scan, "doc_id").rdd.getNumPartitions() == cores
    many = scan.repartition(cores + 1)
    assert spread(many, "doc_id") is many


def test_staged_tables_lie_in_the_named_folder(spark):
    df = staged(spark.range(5), "probe")
    assert df.count() == 5
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in df.inputFiles())


def test_the_nested_record_does_not_reach_the_join_with_similarities(spark, small):
    # Skills, careers, signals and summaries stay where they are read.
    nested = set(pipeline.RECORD)
    assert not nested.intersection(catalog._listed(spark, small).columns)
    featured = catalog._featured(spark, small)
    assert nested.intersection(featured.columns) == {"profile"}
    assert featured.schema["profile"].dataType.names == ["location", "years_of_experience"]


def test_flat_tables_are_written_when_they_are_asked_for(spark, small):
    # a ranking reads the profiles' texts and none of the other five tables.
    store = Warehouse(spark, small)
    assert store.profiles.count() > 0
    assert tables.exists(spark, f"{store._store}/profiles")
    assert not any(tables.exists(spark, f"{store._store}/{name}") for name in ("skills", "career_history", "languages"))
    assert set(store.flat) == set(normalise.NORMALISERS)
