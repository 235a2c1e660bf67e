"""Stored tables: writing the six tables, loading once, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shortlist.operators.normalise import NORMALISERS
from shortlist.schemas import TABLES
from shortlist.session import staged
from shortlist.sources import ingest


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written completely; asks the table's own file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """S3: lazy scans; only the columns a query uses are read."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in (names or TABLES)}


def write_tables(candidates: DataFrame, folder: str, mode: str = "overwrite", names: list[str] | None = None) -> list[str]:
    """K1: the six tables or those of ``names``, Snappy-compressed, one folder each, types as declared.

    ``candidates`` is read once per table: give it a stored table, not a parse.
    """
    written = list(NORMALISERS) if names is None else names
    for name in written:
        NORMALISERS[name](candidates).write.mode(mode).option("compression", "snappy").parquet(f"{folder}/{name}")
    return written


def load(lines: DataFrame, folder: str, force: bool = False, signals_field: str = "signals") -> DataFrame:
    """Parse, check, split and store; returns the one-row load statistics.

    An earlier complete load is kept unless ``force`` is set, and then counts as all valid. The
    checked records are written once and the six tables, the quarantine and the statistics are
    made from that table, so the input is parsed a single time.
    """
    spark = lines.sparkSession
    if not force and all(exists(spark, f"{folder}/{name}") for name in TABLES):
        return ingest.load_stats(_as_valid(spark.read.parquet(f"{folder}/profiles")))
    checked = staged(ingest.parse_lines(lines, signals_field), "checked")
    write_tables(ingest.valid_candidates(checked), folder)
    ingest.quarantine(checked).write.mode("overwrite").parquet(f"{folder}/quarantine")
    return ingest.load_stats(checked)


def _as_valid(profiles: DataFrame) -> DataFrame:
    return profiles.selectExpr("'valid' AS status")


def write_features(features: DataFrame, path: str) -> None:
    """K6: one row per candidate."""
    features.write.mode("overwrite").parquet(path)
