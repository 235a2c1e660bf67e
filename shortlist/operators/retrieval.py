"""Text, vector and hybrid retrieval.

One query: the documents are scanned with narrow projections, once for the statistics and once
for the scores. The statistics are a one-row scalar subquery over one row per query term, so
nothing else is shuffled, and the top-k is a per-task heap.

Many queries: the weights of the query terms are aggregated per document, and texts and vectors
are scored against a bounded block of queries inside each task, which hands on at most k rows
per query. No row is made per query and document.

Scores are rounded to ``SCORE_DIGITS`` before sorting, so that the order of additions cannot
decide between equal documents; ties go to the smaller id.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortlist.functions.text import tokens
from shortlist.functions.vectors import dot, hashed_bag
from shortlist.session import staged

# The functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1 = 1.5
B = 0.75
BM25_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
SCORE_DIGITS = 9

#: Queries handled by one pass over the documents; more queries take more passes.
QUERIES_PER_PASS = 1024
#: Query terms of a block, some tens of bytes each, that are sent to every task.
BROADCAST_TERMS = 500_000
#: Documents scored at a time inside a task.
ROWS_PER_PIECE = 2048


def top_k(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """O1: the k best rows, ties by id. Runs as a bounded heap per task and one merge."""
    return df.orderBy(F.desc(score), F.asc(id_col)).limit(k)


# --- BM25, one query ----------------------------------------------------------------------


def query_terms(query: str) -> Column:
    """Distinct tokens of a query; a repeated word counts once."""
    return F.array_distinct(tokens(F.lit(query)))


def _term_hits(docs: DataFrame, terms: Column, id_col: str, text_col: str) -> DataFrame:
    """``(id, length, hits)``: the document length and its occurrences of query terms."""
    return docs.select(F.col(id_col), tokens(F.col(text_col)).alias("_t")).select(
        id_col,
        F.size("_t").alias("length"),
        F.filter("_t", lambda t: F.array_contains(terms, t)).alias("hits"),
    )


def _idf(documents: Column, df: Column) -> Column:
    return F.ln((documents - df + 0.5) / (df + 0.5) + 1.0)


def _saturation(tf: Column, length: Column, mean_length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean_length))


def bm25_scores(
    docs: DataFrame, query: str, id_col: str = "candidate_id", text_col: str = "text", k1: float = K1, b: float = B
) -> DataFrame:
    """BM25 of every document for one query, zeros included: ``(id, bm25_score)``."""
    hits = _term_hits(docs, query_terms(query), id_col, text_col)
    # All statistics in one pass: a row without a term for every document, carrying its length,
    # and a row for each query term it contains. They collapse to one row per query term.
    marks = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("length").alias("length"))),
        F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("length"))),
    )
    counted = hits.select(F.inline(marks)).groupBy("term").agg(
        F.count("*").cast("double").alias("n"), F.sum("length").alias("total")
    )
    of_documents = F.col("term").isNull()
    stats = counted.agg(
        F.struct(
            F.max(F.when(of_documents, F.col("n"))).alias("n"),
            F.max(F.when(of_documents, F.col("total") / F.col("n"))).alias("mean_length"),
            F.map_from_entries(F.collect_list(F.when(~of_documents, F.struct("term", "n")))).alias("df"),
        )
    )
    scored = hits.select(id_col, "length", "hits", stats.scalar().alias("corpus"))
    parts = F.transform(
        F.array_distinct("hits"),
        lambda term: _idf(F.col("corpus.n"), F.try_element_at("corpus.df", term))
        * _saturation(
            F.size(F.filter("hits", lambda t: t == term)).cast("double"),
            F.col("length"), F.col("corpus.mean_length"), k1, b,
        ),
    )
    score = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(id_col, F.round(score, SCORE_DIGITS).alias("bm25_score"))


def bm25_topk(docs: DataFrame, query: str, k: int = 100, id_col: str = "candidate_id", text_col: str = "text",
              k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents; those that match nothing are dropped after the cut."""
    scores = bm25_scores(docs, query, id_col, text_col, k1, b)
    return top_k(scores, "bm25_score", id_col, k).where(F.col("bm25_score") > 0)


# --- BM25, stored index -------------------------------------------------------------------

INDEX_TABLES = ["postings", "documents", "terms", "corpus"]


def index_tables(docs: DataFrame, id_col: str = "candidate_id", text_col: str = "text") -> dict[str, DataFrame]:
    """A10: postings, document lengths, document frequencies and the corpus row."""
    tokenised = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("_t"))
    postings = (
        tokenised.select("doc_id", F.explode("_t").alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    documents = tokenised.select("doc_id", F.size("_t").alias("length"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    return {"postings": postings, "documents": documents, "terms": terms, "corpus": corpus}


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, id_col: str = "candidate_id", text_col: str = "text",
                buckets: int = 64) -> None:
    """Write the index. Postings carry the document length and are split by term bucket.

    Postings are spread over tasks by bucket and document, so a term that occurs in a large
    share of all documents is written by many tasks. Frequencies come from the written postings.
    """
    spark = docs.sparkSession
    tokenised = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("_t")).select(
        "doc_id", F.size("_t").alias("length"), "_t"
    )
    (
        tokenised.select("doc_id", "length", F.explode("_t").alias("term"))
        .groupBy("doc_id", "length", "term")
        .agg(F.count("*").alias("tf"))
        .withColumn("bucket", _bucket(F.col("term"), buckets))
        .repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    tokenised.select("doc_id", "length").write.mode("overwrite").parquet(f"{path}/documents")
    (
        spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
        .write.mode("overwrite").parquet(f"{path}/terms")
    )
    (
        spark.read.parquet(f"{path}/documents")
        .agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
        .withColumn("buckets", F.lit(buckets))
        .write.mode("overwrite").parquet(f"{path}/corpus")
    )


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES}


def indexed_topk(index: dict[str, DataFrame], query: str, k: int = 100, id_col: str = "candidate_id",
                 k1: float = K1, b: float = B) -> DataFrame:
    """T1 over a stored index: reads only the postings of the query's terms."""
    spark = index["postings"].sparkSession
    wanted = [row.term for row in spark.range(1).select(F.explode(query_terms(query)).alias("term")).collect()]
    # The words of one query: a bounded driver-side list, needed as literals for file pruning.
    buckets = index["corpus"].first()["buckets"]
    numbers = [row.b for row in spark.range(1).select(F.explode(_literal(wanted)).alias("t"))
               .select(_bucket(F.col("t"), buckets).alias("b")).distinct().collect()]
    chosen = F.col("bucket").isin(numbers) & F.col("term").isin(wanted)
    corpus = index["corpus"].select(F.struct("n", "mean_length")).scalar()
    contribution = _idf(F.col("corpus.n"), F.col("df").cast("double")) * _saturation(
        F.col("tf").cast("double"), F.col("length"), F.col("corpus.mean_length"), k1, b
    )
    scores = (
        index["postings"].where(chosen)
        .join(index["terms"].where(chosen).select("term", "df"), "term")
        .withColumn("corpus", corpus)
        .groupBy(F.col("doc_id").alias(id_col))
        .agg(F.round(F.sum(contribution), SCORE_DIGITS).alias("bm25_score"))
    )
    return top_k(scores, "bm25_score", id_col, k)


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# --- vectors, one query -------------------------------------------------------------------


def cosine_scores(vectors: DataFrame, query: Column, id_col: str = "candidate_id", vector_col: str = "embedding",
                  clamp: bool = False) -> DataFrame:
    """Similarity of every stored unit vector with one query vector.

    ``query`` is a Column that does not depend on the row, such as a literal array or a scalar
    subquery. ``clamp`` cuts the score to 0..1.
    """
    score = dot(F.col(vector_col), F.col("_q"))
    if clamp:
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return vectors.select(id_col, vector_col, query.alias("_q")).select(
        id_col, F.round(score, SCORE_DIGITS).alias("semantic_score")
    )


def cosine_topk(vectors: DataFrame, query: Column, k: int = 500, id_col: str = "candidate_id",
                vector_col: str = "embedding", clamp: bool = False) -> DataFrame:
    return top_k(cosine_scores(vectors, query, id_col, vector_col, clamp), "semantic_score", id_col, k)


def stored_vector(vectors: DataFrame, key, id_col: str = "candidate_id", vector_col: str = "embedding") -> Column:
    """The vector stored under ``key`` as a scalar; it is read once per query."""
    return vectors.where(F.col(id_col) == F.lit(key)).select(vector_col).limit(1).scalar()


# --- hybrid, one query --------------------------------------------------------------------


def hybrid_scores(
    docs: DataFrame, vectors: DataFrame, query: str, query_vector: Column, id_col: str = "candidate_id",
    text_col: str = "text", vector_col: str = "embedding", bm25_weight: float = BM25_WEIGHT,
    semantic_weight: float = SEMANTIC_WEIGHT, stage: bool = False,
) -> DataFrame:
    """Weighted sum of BM25, scaled to 0..1 over all documents, and unscaled similarity.

    The two sides meet on the id (J11). Vectors are reduced to one number before the join, so
    only ids and scores are shuffled. A vector without a text counts as matching nothing, a text
    without a vector as of similarity 0.
    ``stage`` writes ids and BM25 scores to the shared folder first, so that long texts are
    read twice (statistics, scores) instead of three times (range of the scores).
    """
    bm25 = bm25_scores(docs, query, id_col, text_col)
    if stage:
        bm25 = staged(bm25, "bm25")
    spread = bm25.agg(F.struct(F.min("bm25_score").alias("lo"), F.max("bm25_score").alias("hi")))
    semantic = cosine_scores(vectors, query_vector, id_col, vector_col)
    norm = F.when(
        F.col("s.hi") > F.col("s.lo"), (F.col("bm25_score") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo"))
    ).otherwise(0.0)
    return (
        semantic.join(bm25, id_col, "full_outer")
        .withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
        .withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
        .withColumn("s", spread.scalar())
        .withColumn("bm25_norm", norm)
        .select(
            id_col,
            F.round(bm25_weight * F.col("bm25_norm") + semantic_weight * F.col("semantic_score"), SCORE_DIGITS).alias(
                "hybrid_score"
            ),
            "bm25_norm",
            "semantic_score",
        )
    )


def hybrid_topk(docs: DataFrame, vectors: DataFrame, query: str, query_vector: Column, k: int = 500,
                id_col: str = "candidate_id", **options) -> DataFrame:
    return top_k(hybrid_scores(docs, vectors, query, query_vector, id_col, **options), "hybrid_score", id_col, k)


# --- many queries -------------------------------------------------------------------------


def best_per_query(df: DataFrame, score: str, id_col: str, k: int, query_id: str = "query_id") -> DataFrame:
    """The k best rows of every query with their rank; each task keeps only k rows per query."""
    order = Window.partitionBy(query_id).orderBy(F.desc(score), F.asc(id_col))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _term_weights(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, k1: float, b: float) -> DataFrame:
    """``(id, terms, weights)``: the BM25 weight of each query term in each document that holds one.

    ``terms`` is ``(term, no)``. Occurrences are counted per (document, term) with map-side
    combine; other words are dropped before that.
    """
    counted = docs.select(id_col, tokens(F.col(text_col)).alias("_t")).select(
        id_col, F.size("_t").alias("length"), "_t"
    )
    postings = (
        counted.select(id_col, "length", F.explode("_t").alias("term"))
        .join(terms, "term")
        .groupBy(id_col, "length", "no")
        .agg(F.count("*").cast("double").alias("tf"))
    )
    frequencies = postings.groupBy("no").agg(F.count("*").cast("double").alias("df"))
    corpus = counted.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean_length"))).scalar()
    weight = _idf(F.col("corpus.n"), F.col("df")) * _saturation(
        F.col("tf"), F.col("length"), F.col("corpus.mean_length"), k1, b
    )
    # At most one entry per query term of the block.
    return (
        postings.join(frequencies, "no")
        .withColumn("corpus", corpus)
        .groupBy(id_col)
        .agg(F.collect_list(F.struct("no", weight.alias("weight"))).alias("_w"))
        .select(id_col, F.col("_w.no").alias("_terms"), F.col("_w.weight").alias("_weights"))
    )


class _Block:
    """A bounded block of queries as arrays: which queries hold a term, and their vectors."""

    def __init__(self, rows: pd.DataFrame, query_id: str, query_vector: str) -> None:
        self.ids = rows[query_id].to_numpy()
        size = max((len(v) for v in rows[query_vector] if v is not None), default=0)
        none = np.zeros(size)  # a query without a vector is answered by its text alone
        self.matrix = np.stack([none if v is None else np.asarray(v, dtype="float64") for v in rows[query_vector]])
        self.terms = sorted({t for found in rows["_terms"] for t in found})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], q) for q, found in enumerate(rows["_terms"]) for t in found)
        self.queries = np.array([q for _, q in pairs], dtype="int64")
        self.starts = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1))

    def text_scores(self, terms: list, weights: list) -> np.ndarray:
        """Documents x queries: the sum of a document's term weights over the terms of each query."""
        sizes = [0 if t is None else len(t) for t in terms]
        shape = (len(terms), len(self.ids))
        if not sum(sizes):
            return np.zeros(shape)
        flat = np.concatenate([t for t in terms if t is not None]).astype("int64")
        values = np.concatenate([w for w in weights if w is not None]).astype("float64")
        first, count = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        query = self.queries[np.repeat(first, count) + inside]
        cell = np.repeat(np.repeat(np.arange(len(terms)), sizes), count) * shape[1] + query
        sums = np.bincount(cell, weights=np.repeat(values, count), minlength=shape[0] * shape[1])
        return np.round(sums.reshape(shape), SCORE_DIGITS)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Record batches cut to a size whose score matrix stays small."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_PER_PIECE):
            yield batch.iloc[start : start + ROWS_PER_PIECE]


def _spread_of(block: _Block) -> Callable:
    """Per task and query: the range of the scores above zero, and how many there are."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high = np.zeros(len(block.ids))
        low = np.full(len(block.ids), np.inf)
        matched = np.zeros(len(block.ids), dtype="int64")
        for piece in _pieces(batches):
            scores = block.text_scores(piece["_terms"].tolist(), piece["_weights"].tolist())
            high = np.maximum(high, scores.max(axis=0))
            low = np.minimum(low, np.where(scores > 0, scores, np.inf).min(axis=0))
            matched += (scores > 0).sum(axis=0)
        yield pd.DataFrame({"q": np.arange(len(block.ids)), "hi": high, "lo": low, "matched": matched})

    return measure


def _best_of(block: _Block, low: np.ndarray, high: np.ndarray, k: int, names: tuple[str, str, str],
             weights: tuple[float, float]) -> Callable:
    """Score pieces of documents against the block, keeping k rows per query and task."""
    query_id, id_col, vector_col = names
    width = np.where(high > low, high - low, 1.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for piece in _pieces(batches):
            none = np.zeros(block.matrix.shape[1])
            cosine = np.zeros((len(piece), len(block.ids)))
            if len(none):  # else no query of the block has a vector
                vectors = np.stack([none if v is None else v for v in piece[vector_col]]).astype("float64")
                cosine = np.round(vectors @ block.matrix.T, SCORE_DIGITS)
            text = block.text_scores(piece["_terms"].tolist(), piece["_weights"].tolist())
            norm = np.where(high > low, (text - low) / width, 0.0)
            hybrid = np.round(weights[0] * norm + weights[1] * cosine, SCORE_DIGITS)
            # Rows below the k-th best score of a query cannot be among its k best.
            cut = np.partition(hybrid, -k, axis=0)[-k] if len(hybrid) > k else hybrid.min(axis=0)
            row, column = np.nonzero(hybrid >= cut)
            fresh = pd.DataFrame(
                {
                    query_id: block.ids[column],
                    id_col: piece[id_col].to_numpy()[row],
                    "hybrid_score": hybrid[row, column],
                    "bm25_norm": norm[row, column],
                    "semantic_score": cosine[row, column],
                }
            )
            merged = fresh if kept is None else pd.concat([kept, fresh], ignore_index=True)
            merged = merged.sort_values([query_id, "hybrid_score", id_col], ascending=[True, False, True])
            kept = merged.groupby(query_id, sort=False).head(k)
        if kept is not None:
            yield kept

    return score


def hybrid_batch(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 500, id_col: str = "candidate_id",
    text_col: str = "text", vector_col: str = "embedding", query_id: str = "query_id",
    query_text: str = "query_text", query_vector: str = "query_vector", bm25_weight: float = BM25_WEIGHT,
    semantic_weight: float = SEMANTIC_WEIGHT, k1: float = K1, b: float = B,
) -> DataFrame:
    """T4: hybrid top-k for a table of queries, exact.

    No row is made per (query, document). Every document carries the weights of the query terms
    it holds; each task multiplies these and its vectors with a bounded block of queries, and
    hands on at most k rows per query. A query without a vector has similarity 0 to all. The term weights are written to the shared folder once
    per block, because the range of the scores is needed before they can be combined. Queries
    beyond one block take further passes.
    """
    asked = queries.select(
        query_id, query_vector, F.array_distinct(tokens(F.col(query_text))).alias("_terms")
    )
    documents = docs.agg(F.count("*").alias("n")).first()["n"]
    total, ids = queries.agg(F.count("*"), F.count_distinct(query_id)).first()
    if ids < total:
        raise ValueError("query ids must be unique and not null")
    # Hash parts of about half the block size. Only one bounded block is held at a time.
    parts = 1 if total <= QUERIES_PER_PASS else -(-2 * total // QUERIES_PER_PASS)
    part_of = F.pmod(F.xxhash64(query_id), F.lit(parts))
    spark = docs.sparkSession
    found = (
        f"{query_id} {queries.schema[query_id].dataType.simpleString()}, "
        f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, "
        "hybrid_score double, bm25_norm double, semantic_score double"
    )
    out = None
    for part in range(parts):
        rows = asked.where(part_of == part).limit(QUERIES_PER_PASS + 1).toPandas()
        if len(rows) > QUERIES_PER_PASS:
            raise ValueError("too many queries share a hash part; raise QUERIES_PER_PASS")
        if not len(rows):
            continue
        block = _Block(rows, query_id, query_vector)
        numbered = spark.createDataFrame(
            pd.DataFrame({"term": block.terms, "no": np.arange(len(block.terms))}), "term string, no int"
        )
        if len(block.terms) <= BROADCAST_TERMS:  # longer lists are joined by a shuffle
            numbered = F.broadcast(numbered)
        lists = staged(_term_weights(docs, numbered, id_col, text_col, k1, b), "term-weights")
        # One row per query: at most a block.
        spread = (
            lists.select("_terms", "_weights")
            .mapInPandas(_spread_of(block), "q bigint, hi double, lo double, matched bigint")
            .groupBy("q")
            .agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("matched").alias("matched"))
            .orderBy("q")
            .toPandas()
        )
        high = np.zeros(len(rows))
        low = np.zeros(len(rows))
        if len(spread):
            high = spread["hi"].to_numpy()
            # A query that some document does not match has 0 as its lowest score.
            low = np.where(spread["matched"] < documents, 0.0, spread["lo"].to_numpy())
        # Every text and every vector takes part, whether or not the other is there.
        known = docs.select(id_col).join(vectors.select(id_col, vector_col), id_col, "full_outer")
        local = known.join(lists, id_col, "left").mapInPandas(
            _best_of(block, low, high, k, (query_id, id_col, vector_col), (bm25_weight, semantic_weight)),
            found,
        )
        out = local if out is None else out.unionByName(local)
    if out is None:
        out = spark.createDataFrame([], found)
    return best_per_query(out, "hybrid_score", id_col, k, query_id)


# --- keyword filter and union retrieval ----------------------------------------------------


def keyword_retrieve(
    candidates: DataFrame, skills: list[str], titles: list[str], open_cap: int = 200, skill_cap: int = 100,
    title_cap: int = 80, max_skills: int = 8, max_titles: int = 4, id_col: str = "candidate_id",
) -> DataFrame:
    """ids that match one of the criteria, the first few of each in id order.

    The caps are part of the operator: open to work 200, each of 8 skills 100, each of 4 titles
    80. Every task passes on no more than the cap per criterion.
    """
    has_skill = lambda word: F.exists(
        F.col("skills"), lambda s: F.contains(F.lower(s["name"]), F.lit(word.lower()))
    )
    has_title = lambda word: F.contains(F.lower("profile.current_title"), F.lit(word.lower())) | F.exists(
        F.col("career_history"), lambda j: F.contains(F.lower(j["title"]), F.lit(word.lower()))
    )
    criteria = [("open", open_cap, F.coalesce("signals.open_to_work_flag", F.lit(False)))]
    criteria += [(f"skill:{s}", skill_cap, F.coalesce(has_skill(s), F.lit(False))) for s in skills[:max_skills]]
    criteria += [(f"title:{t}", title_cap, F.coalesce(has_title(t), F.lit(False))) for t in titles[:max_titles]]
    matched = F.array_compact(
        F.array(*[F.when(test, F.struct(F.lit(name).alias("criterion"), F.lit(cap).alias("cap")))
                  for name, cap, test in criteria])
    )
    order = Window.partitionBy("criterion").orderBy(id_col)
    largest = max(cap for _, cap, _ in criteria)
    return (
        candidates.select(id_col, F.explode(matched).alias("m"))
        .select(id_col, "m.criterion", "m.cap")
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= largest)
        .where(F.col("rn") <= F.col("cap"))
        .select(id_col)
        .distinct()
    )


def union_retrieve(candidates: DataFrame, vectors: DataFrame, query_vector: Column, skills: list[str],
                   titles: list[str], k: int = 500, id_col: str = "candidate_id",
                   vector_col: str = "embedding") -> DataFrame:
    """Nearest candidates and keyword matches together, each with its similarity.

    A candidate without a vector has similarity 0 and can still be found by keyword.
    """
    known = vectors.join(candidates.select(id_col), id_col, "left_semi")
    scores = cosine_scores(known, query_vector, id_col, vector_col, clamp=True)
    nearest = top_k(scores, "semantic_score", id_col, k)
    chosen = nearest.select(id_col).union(keyword_retrieve(candidates, skills, titles, id_col=id_col)).distinct()
    return chosen.join(scores, id_col, "left").withColumn(
        "semantic_score", F.coalesce("semantic_score", F.lit(0.0))
    )


# --- encoding new candidates ----------------------------------------------------------------

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def pending(candidates: DataFrame, stored: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Candidates without a stored vector, each id once."""
    return candidates.join(stored.select(id_col), id_col, "left_anti").dropDuplicates([id_col])


def encode(rows: DataFrame, encoder: Encoder | None = None, id_col: str = "candidate_id",
           text_col: str = "embedding_text", dim: int = 64) -> DataFrame:
    """``(id, embedding)`` for the given rows.

    ``encoder`` is a function over batches of ``(id, text)`` that yields ``(id, embedding)``,
    loaded once per task. Without one, a hashed bag of words is computed in plain expressions.
    """
    for column in (id_col, text_col):
        if column not in rows.columns:
            raise ValueError(f"input needs the column '{column}'")
    if encoder is None:
        return rows.select(id_col, hashed_bag(F.col(text_col), dim).alias("embedding"))
    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInPandas(encoder, f"{id_col} {id_type}, embedding array<float>")


def embed_new(candidates: DataFrame, stored: DataFrame | None, encoder: Encoder | None = None,
              id_col: str = "candidate_id", text_col: str = "embedding_text", dim: int = 64) -> DataFrame:
    """Vectors for new ids only; append the result to the stored table."""
    todo = candidates.dropDuplicates([id_col]) if stored is None else pending(candidates, stored, id_col)
    return encode(todo, encoder, id_col, text_col, dim)


def updated_store(candidates: DataFrame, stored: DataFrame, encoder: Encoder | None = None,
                  id_col: str = "candidate_id", text_col: str = "embedding_text", dim: int = 64) -> DataFrame:
    """The stored vectors together with those of new ids.

    A store that holds an id twice no longer fits its ids: it is dropped, and every given
    candidate is encoded again. The check is part of the plan.
    """
    broken = stored.groupBy(id_col).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.max("n") > 1, F.lit(False))
    ).scalar()
    kept = stored.select(id_col, "embedding").where(~broken)
    return kept.unionByName(embed_new(candidates, kept, encoder, id_col, text_col, dim))
