"""Vectors of query texts, kept between runs.

A text's vector is stored under a digest of the text and the encoder's version. A table of queries is looked up by
its digests, and the texts without a vector are encoded in one pass and added to the store. A run that meets known texts
only encodes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions.arrays import let
from shortlist.functions.text import tokens
from shortlist.functions.vectors import unit_length
from shortlist.operators.retrieval import Encoder, encode


def digest(text: Column, version: str) -> Column:
    return F.sha2(F.concat(F.lit(version), F.lit("\n"), F.coalesce(text, F.lit(""))), 256)


def stored_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, embedding)`` of all texts encoded so far; a store that does not exist yet is empty."""
    schema = "digest string, embedding array<float>"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # only a missing folder is no error
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def encoded_queries(queries: DataFrame, path: str, version: str, encoder: Encoder | None = None, query_id: str = "query_id",
                    query_text: str = "query_text", make=None, dim: int = 64) -> DataFrame:
    """``queries`` with ``query_vector``; texts that the store under ``path`` lacks are encoded and added to it.

    ``encoder`` works on batches as in ``retrieval.encode``; ``make`` instead builds the vector as a Column of the text.
    A null text counts as empty; equal texts share one vector. Two runs at a time may both add a text, with the
    same vector; it counts once.
    """
    spark = queries.sparkSession
    asked = queries.withColumn("_digest", digest(F.col(query_text), version))
    texts = asked.select(F.col("_digest").alias("digest"), F.coalesce(F.col(query_text), F.lit("")).alias("text")).dropDuplicates(["digest"])
    missing = texts.join(stored_queries(spark, path), "digest", "left_anti")
    if not missing.isEmpty():
        made = missing.select("digest", make(F.col("text")).alias("embedding")) if make else encode(missing, encoder, "digest", "text", dim)
        made.select("digest", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)
    known = stored_queries(spark, path).dropDuplicates(["digest"])
    return asked.join(known.withColumnsRenamed({"digest": "_digest", "embedding": "query_vector"}), "_digest", "left").drop("_digest")


def digest_bag(text: Column, dim: int = 64) -> Column:
    """An encoder without a model: words by the first eight digits of their MD5 digest, counted into ``dim`` slots, of length one."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))

    def counted(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda slot: F.size(F.filter(found, lambda s: s == slot)).cast("double"))

    return F.transform(unit_length(let(slots, counted)), lambda x: x.cast("float"))
