"""CSV and JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.numbers import fixed
from shortlist.operators import ranking
from shortlist.operators.stats import report_document
from shortlist.schemas import LABELS_DDL

_CSV = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file; extra trailing columns may be missing."""
    return spark.read.schema(LABELS_DDL).options(header=True, enforceSchema=False, **_CSV).csv(path)


def read_manual_labels(spark: SparkSession, path: str) -> DataFrame:
    """A hand-made label file, ``candidate_id,label`` by name, whatever else it holds."""
    return spark.read.options(header=True, **_CSV).csv(path).select(
        "candidate_id", F.expr("try_cast(label AS INT)").alias("label")
    )


def read_ranking(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, header problems)`` of ranked files; the header is read as data to be checked.

    Rows are numbered as in the file, the header being row 1. Blank rows are dropped. A ranked
    file is small by definition, so each file is read by one task and keeps its order.
    """
    raw = spark.read.options(header=False, columnNameOfCorruptRecord="_record", **_CSV).schema(
        "candidate_id string, rank string, score string, reasoning string, _record string"
    ).csv(path)
    cells = ["candidate_id", "rank", "score", "reasoning"]
    # The reader keeps the text of rows with more or fewer cells. A comma between quotes parts none.
    bare = F.regexp_replace("_record", r'"(?:[^"]|"")*"', "")
    columns = F.when(F.col("_record").isNull(), len(cells)).otherwise(F.length(F.regexp_replace(bare, "[^,]", "")) + 1)
    placed = raw.select(
        F.col("_metadata.file_name").alias("list_id"), F.monotonically_increasing_id().alias("_at"), *cells, columns.alias("columns"), "_record"
    )
    names = F.when(F.col("_record").isNull(), F.array(*cells)).otherwise(F.split("_record", ","))
    first = placed.groupBy("list_id").agg(F.min("_at").alias("_start"), F.min_by(names, "_at").alias("header"))
    problems = first.select("list_id", ranking.header_errors(F.col("header")).alias("message")).where(
        F.col("message").isNotNull()
    )
    blank = F.trim(F.concat_ws("", *cells)) == ""
    rows = (
        placed.join(first.select("list_id", "_start"), "list_id")
        .where((F.col("_at") > F.col("_start")) & ~blank)
        .select("list_id", (F.col("_at") - F.col("_start") + 1).cast("int").alias("row_num"), *cells, "columns")
    )
    return rows, problems


def _one_csv(df: DataFrame, path: str) -> None:
    """A single file with a header; for results that are small by definition."""
    df.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """K2: six columns; scores to 4, 2 and 2 places. Written in parallel."""
    columns = ["candidate_id", "label", "hybrid_score", "contradiction_score", "honeypot_score", "reason"]
    labels.select(*columns).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def format_ranking(rows: DataFrame) -> DataFrame:
    """K3: the four columns with the score as text with four places."""
    return rows.select(
        "candidate_id",
        F.col("rank").cast("int").alias("rank"),
        fixed(F.col("score"), 4).alias("score"),
        F.coalesce("reasoning", F.lit(vocab.DEFAULT_REASONING)).alias("reasoning"),
    )


def write_ranking(results: DataFrame, path: str, n: int = 100, position: str = "input_pos") -> DataFrame:
    """K3: dedupe, rank, check and write; returns the problems found (empty when all is well)."""
    rows = format_ranking(ranking.ranking_rows(results, n, position)).orderBy("rank")
    _one_csv(rows, path)
    written, header = read_ranking(results.sparkSession, path)
    found = ranking.validate_ranking(written, n)
    return found.select("list_id", "rule", "message").unionByName(
        header.select("list_id", F.lit("header").alias("rule"), "message")
    )


def write_search(found: DataFrame, path: str) -> None:
    """K8: the rows of a search as CSV, lists joined by ``|``; written in parallel."""
    columns = [F.array_join(c, "|").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in found.dtypes]
    found.select(*columns).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """K4."""
    scored.select("candidate_id", "label", "prediction_score").write.mode("overwrite").options(header=True).csv(path)


def write_importance(table: DataFrame, path: str, value: str = "importance") -> None:
    """K5: one row per feature, largest first."""
    _one_csv(table.orderBy(F.desc(value), F.asc("feature")), path)


def write_report(report: DataFrame, profiles: DataFrame, path: str) -> None:
    """K7: the statistics report as one JSON document."""
    report_document(report, profiles).coalesce(1).write.mode("overwrite").json(path)


def read_job_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """One description per text file, the file name as its id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("jd_id"), F.col("value").alias("text")
    )
