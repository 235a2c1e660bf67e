"""A stored text index with block-max postings (T1b, J10): exact BM25 top-k that skips what can't reach it.

Documents are dealt to blocks of at most ``block_size`` in the order in which they are stored. A posting list is cut at
the same borders: one row per term and block with places in the block, ids, term frequencies and lengths. Beside it, in
columns that are read by themselves as the table ``blocks``, stands a small header with the block's last id and its impact, the
largest share any of its documents can add to a score for the term before the term's weight. Rows lie in one folder per
bucket of terms.

A query reads only the buckets of its terms, and of these first the headers. Impacts times weights add up to a bound for
every block of documents. The k blocks with the highest bounds are scored; they hold k documents at least, and the
k-th score among them is a threshold the whole list can't fall below. Every block whose bound stays below it
is left unread. The rest is scored in full, so the result is that of a scan over all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions.arrays import let
from shortlist.functions.text import tokens
from shortlist.operators.retrieval import B, K1, SCORE_DIGITS, _bucket, _idf, _saturation, query_terms, top_k

TABLES = ("documents", "postings", "terms", "corpus")
#: Columns of the stored postings that are read by themselves, as the table ``blocks``.
HEADER = ("size", "last_id", "impact")
#: Scores are sums in another order than bounds; a bound is raised by more than the difference can be.
SLACK = 1e-6
#: How tables are compressed: with the least effort, as time is shorter than disk.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: The most groups that buckets are dealt to, the character of the first one, and how many words of texts a task takes.
GROUPS, FIRST, TASK_WORDS = 32, ord("0"), 2_000_000


def _word_lists(words: str, groups: int) -> Column:
    """The different words of a text as one text for each group of buckets that has any: a character for the group, then words with spaces between.

    A word that occurs more than once has its count behind a colon; words hold neither spaces nor marks. Buckets of a group are equal
    modulo ``groups``. The words are sorted once, behind the characters of their groups; all else is linear in them.
    """
    mark = lambda w: F.chr(F.pmod(F.xxhash64(w), F.lit(groups)) + FIRST)

    def listed(marked: Column) -> Column:
        new = lambda i: ~F.get(marked, i).eqNullSafe(F.get(marked, i - 1))

        def joined(starts: Column) -> Column:
            def piece(i: Column, n: Column) -> Column:
                word, before = F.get(marked, i), F.get(marked, i - 1)
                apart = ~F.left(word, F.lit(1)).eqNullSafe(F.left(before, F.lit(1)))
                tf = F.coalesce(F.get(starts, n + 1), F.size(marked)) - i
                return F.concat(
                    F.when(apart, F.concat(F.lit("\n"), word)).otherwise(F.concat(F.lit(" "), F.substr(word, F.lit(2)))),
                    F.when(tf > 1, F.concat(F.lit(":"), tf.cast("string"))).otherwise(""),
                )

            return F.array_join(F.transform(starts, piece), "")

        return let(F.filter(F.sequence(F.lit(0), F.size(marked) - 1), new), joined)

    text = let(F.sort_array(F.transform(words, lambda w: F.concat(mark(w), w))), listed)
    return F.split(F.substr(text, F.lit(2)), "\n")


def _store(df: DataFrame, path: str, *folders: str) -> None:
    df.write.mode("overwrite").options(**STORED).partitionBy(*folders).parquet(path)


def write(docs: DataFrame, path: str, id_col: str = "candidate_id", text_col: str = "text", buckets: int = 64,
          block_size: int = 128, k1: float = K1, b: float = B) -> None:
    """Write the index of ``docs``. Texts are split into words once, into a forward index that all other tables are made of.

    Documents without words count for the corpus only; a null text has none. Rows of one id are documents of their own.
    Words move once, as one text per document and group of buckets, and postings are grouped where they arrive.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("number"), tokens(F.col(text_col)).alias("words"))
    # The high bits of a number name the partition, the low ones count its rows.
    part, row = F.shiftright("number", 33), F.col("number").bitwiseAND((1 << 33) - 1)
    block = F.shiftleft(part, 33) + F.floor(row / block_size)
    _store(texts.select("number", "doc_id", block.alias("block"), F.size("words").alias("length"), "words"), f"{path}/documents")
    forward = spark.read.parquet(f"{path}/documents")

    corpus = forward.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    settings = {"buckets": buckets, "k1": float(k1), "b": float(b)}
    _store(corpus.select("*", *[F.lit(v).alias(n) for n, v in settings.items()]), f"{path}/corpus")

    # A task takes the words of one group of buckets in a share of the blocks, so a common term is written by several tasks.
    n, mean = spark.read.parquet(f"{path}/corpus").select("n", F.coalesce("mean_length", F.lit(0.0))).first()
    groups = max(g for g in range(1, GROUPS + 1) if buckets % g == 0)
    shares = max(1, math.ceil(n * mean / groups / TASK_WORDS))
    place = F.pmod(row, F.lit(block_size)).cast("int").alias("place")
    lists = forward.where("length > 0").select("block", place, "doc_id", "length", F.explode(_word_lists("words", groups)).alias("list"))
    task = (F.ascii("list") - FIRST) * shares + F.pmod(F.xxhash64("block"), F.lit(shares))
    lists = lists.withColumn("task", task.cast("int")).repartitionById(groups * shares, "task")
    found = lists.select("task", "block", "place", "doc_id", "length", F.explode(F.split(F.substr("list", F.lit(2)), " ")).alias("found"))
    tf = F.when(F.contains("found", F.lit(":")), F.substring_index("found", ":", -1).cast("int")).otherwise(1)
    entries = found.select("task", "block", "place", "doc_id", "length", F.substring_index("found", ":", 1).alias("term"), tf.alias("tf"))
    postings = entries.groupBy("term", "block", "task").agg(
        F.sort_array(F.collect_list(F.struct("place", "doc_id", "tf", "length"))).alias("entries"),
        F.max(_saturation(F.col("tf").cast("double"), F.col("length"), F.lit(mean), k1, b)).alias("impact"),
    )
    heads = [F.size("entries").alias("size"), F.element_at("entries", -1)["doc_id"].alias("last_id"), "impact"]
    postings = postings.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "block", *heads, "entries")
    # Lists come from the sorting aggregation ordered by term and block; a stable sort by one small number keeps them so.
    _store(postings.sortWithinPartitions("bucket"), f"{path}/postings", "bucket")

    frequencies = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("size").alias("df"))
    _store(frequencies, f"{path}/terms")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    postings = found["postings"]
    return found | {"postings": postings.drop(*HEADER), "blocks": postings.drop("entries")}


class Search:
    """One query over a stored index: ``top()`` is its result, ``report()`` what it read and skipped."""

    def __init__(self, index: dict[str, DataFrame], query: str, k: int = 100, id_col: str = "candidate_id") -> None:
        self.index, self.k, self.id_col = index, k, id_col
        spark = index["corpus"].sparkSession
        self.settings = index["corpus"].first()
        # The words of one query: a bounded list, needed as literals so that only their files are read.
        number = _bucket(F.col("t"), self.settings["buckets"])
        words = spark.range(1).select(F.explode(query_terms(query)).alias("t")).select("t", number.alias("bucket")).collect()
        if words:
            self.chosen: Column = F.col("bucket").isin(sorted({w["bucket"] for w in words})) & F.col("term").isin([w["t"] for w in words])
        else:
            self.chosen = F.lit(False)
        weight = _idf(F.lit(float(self.settings["n"])), F.col("df").cast("double"))
        self.weights = index["terms"].where(self.chosen).select("term", weight.alias("weight"))
        self.bounds = self._bounds()

    def _bounds(self) -> DataFrame:
        """Per block of documents a score that none of them exceeds."""
        heads = self.index["blocks"].where(self.chosen).join(self.weights, "term")
        return heads.groupBy("block").agg((F.sum(F.col("impact") * F.col("weight")) + SLACK).alias("bound"))

    def _scores(self, blocks: DataFrame) -> DataFrame:
        rows = self.index["postings"].where(self.chosen).join(blocks.select("block"), "block", "left_semi").join(self.weights, "term")
        rows = rows.select("block", "weight", F.inline("entries"))
        part = F.col("weight") * _saturation(F.col("tf").cast("double"), F.col("length"), F.lit(self.settings["mean_length"]), self.settings["k1"], self.settings["b"])
        return rows.groupBy("block", "place", F.col("doc_id").alias(self.id_col)).agg(F.round(F.sum(part), SCORE_DIGITS).alias("bm25_score")).drop("block", "place")

    def needed(self) -> DataFrame:
        """The blocks that may hold one of the k best documents."""
        first = self.bounds.orderBy(F.desc("bound"), "block").limit(self.k)
        kth = top_k(self._scores(first), "bm25_score", self.id_col, self.k)
        # With fewer than k documents nothing may be skipped.
        threshold = kth.agg(F.when(F.count("*") >= self.k, F.min("bm25_score")).otherwise(0.0)).scalar()
        return self.bounds.withColumn("_least", threshold).where(F.col("bound") >= F.col("_least")).select("block")

    def top(self) -> DataFrame:
        """The k best documents that match, ties by id."""
        return top_k(self._scores(self.needed()), "bm25_score", self.id_col, self.k).where(F.col("bm25_score") > 0)

    def report(self) -> DataFrame:
        """One row: blocks and postings of the query's terms, and how many of them are read and skipped."""
        heads = self.index["blocks"].where(self.chosen).select("block", "size")
        read = heads.join(self.needed().withColumn("read", F.lit(True)), "block", "left").withColumn("read", F.coalesce("read", F.lit(False)))
        return read.agg(
            F.count("*").alias("blocks"), F.count_if("read").alias("blocks_read"), F.count_if(~F.col("read")).alias("blocks_skipped"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("postings"), F.coalesce(F.sum(F.when(F.col("read"), F.col("size"))), F.lit(0)).alias("postings_read"),
        )


def topk(index: dict[str, DataFrame], query: str, k: int = 100, id_col: str = "candidate_id") -> DataFrame:
    return Search(index, query, k, id_col).top()
