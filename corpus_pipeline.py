"""A training corpus from ``documents``: language, exact and near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``, with the columns of
``documents``; the last returns the encoded documents. ``run`` writes every result to the shared
folder and reads it again as the next stage's documents.

Defined cases, besides those of the operators: an id is taken to name one document, so where rows
with different texts share one, the near-duplicate and benchmark stages treat them alike; of rows
that repeat an id and a text one passes the exact stage; a null text is an empty one, and has no letter, so
the language stage drops it; texts of any length are read whole; of ties every stage keeps what its operator
keeps; columns of any other name stay as they are; empty tables pass through as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm import decontaminate, exact, language, neardup, pieces
from shortlist.llm.common import Stage, ascii_lower, is_held_out, keep_rows, table, text_of
from shortlist.llm.queries import PIECES_FILE

#: Two guesses between two. A winner that loses to no other name has at least 0.5 in its family and 0.5 among families,
#: so only votes that run in a circle can fall below.
LEAST_CERTAINTY = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; those without go.

    This is no test of certainty: ``LEAST_CERTAINTY`` rejects nothing else but votes that run in a circle, so a text in a
    language that was not learned, or letters without meaning, passes as one of the learned languages.
    """
    model = language.learn(docs, ~is_held_out("doc_id", 4, 2))

    def setup():
        def accepts(text: str | None) -> bool:
            found, score = model.predict(text)
            return found != language.UNKNOWN and score >= LEAST_CERTAINTY

        return accepts

    return keep_rows(docs, "text", setup)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z and a-z are one), the row with the largest id."""
    kept = exact.deduplicate(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text"))
    own = fresh("text_digest", docs)
    rows = docs.withColumn(own, F.sha2(F.encode(ascii_lower(text_of()), "UTF-8"), 256))
    same = rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows[own] == kept["kept_text"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles, the document with the smallest id."""
    dropped = neardup.near_duplicates(docs, shingle_words=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"))
    return without(docs, dropped, "near")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("dropped_id"))
    return without(docs, found, "leaks")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    import public_tokenizers

    return pieces.digest_documents(docs, public_tokenizers.path(PIECES_FILE))


def without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the ids in ``dropped``. These are written first, so Spark knows their size when it plans the join."""
    ids = Stage(docs.sparkSession, "pipeline").write(dropped.distinct(), name)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["dropped_id"]), "left_anti")


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: Language models, paraphrase search and piece encoding are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "corpus")
    for number, (name, function) in enumerate(STAGES):
        docs = stage.write(function(spark, docs, sf_dir), name)
        if number:
            stage.drop(STAGES[number - 1][0])
    return docs
