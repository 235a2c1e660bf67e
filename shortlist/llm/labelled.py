"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, learnable: Column, label: str, *, id_column: str, text: str, rows: int) -> DataFrame:
    """Texts and labels (``text``, ``label``) of the ``rows`` learnable ids with the smallest hash.

    Several labels of one id count by their mean, a null label counts as none. At most ``rows`` ids
    are broadcast; of documents that repeat an id, the smallest text teaches.
    """
    ids = labels.filter(learnable & F.col(label).isNotNull() & F.col(id_column).isNotNull())
    ids = ids.groupBy(F.col(id_column).alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).drop("id")
