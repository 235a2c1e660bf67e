"""Positions of rows in an order, and pages at any depth (P10, W6, W7), without sorting a table in one task.

Rows are dealt to ranges of the order's keys and written once with the number of their range. The counts of the ranges, one small
row each, are added up from the front: they say where each range begins. A row's position is its place within its range
plus that beginning, and a page needs only the ranges that overlap it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.session import scratch

PART = "_range"


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of ``order`` and stored under the number of the range. The order should end in a unique key."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
    path = scratch(spark, "ranges")
    if path is None:
        return dealt
    dealt.write.partitionBy(PART).parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def beginnings(stored: DataFrame) -> DataFrame:
    """``(range, rows, first)``: the rows of every range and the position of its first. One row per range meets in a window."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(PART).agg(F.count("*").alias("rows"))
    return counts.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def with_positions(df: DataFrame, order: list[Column], out: str = "position", parts: int | None = None) -> DataFrame:
    """Every row with its 0-based position in the order."""
    stored = ranged(df, order, parts)
    inside = Window.partitionBy(PART).orderBy(*order)
    placed = stored.withColumn(out, F.row_number().over(inside)).join(beginnings(stored).select(PART, "first"), PART)
    return placed.withColumn(out, F.col("first") + F.col(out) - 1).drop(PART, "first")


def page(stored: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """P10: the rows at positions ``offset`` to ``offset + limit - 1`` of a table stored by ``ranged`` with this order.

    Of the ranges only those that overlap the page are read and sorted: one or two, unless the page is longer than a range.
    """
    last = offset + limit
    needed = beginnings(stored).where((F.col("first") < last) & (F.col("first") + F.col("rows") > offset)).collect()
    if limit <= 0 or not needed:
        return stored.drop(PART).limit(0)
    own = stored.where(F.col(PART).isin([r[PART] for r in needed]))
    skip = max(0, offset - min(r["first"] for r in needed))
    return own.orderBy(*order).drop(PART).offset(skip).limit(limit)
