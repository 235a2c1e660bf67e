"""Text, vector and hybrid retrieval against literal cases and brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from people import frame, job, person, skill
from pyspark.sql import functions as F

from shortlist.functions import text, vectors
from shortlist.operators import encoded, features, retrieval, textindex
from shortlist.plans import derived, pipeline
from shortlist.plans.catalog import QUERIES

CORPUS = [
    ("CAND_1", "Senior Software Engineer Python Django AWS Docker"),
    ("CAND_2", "Data Scientist Machine Learning Python PyTorch SQL"),
    ("CAND_3", "Frontend Developer React Next.js Tailwind CSS HTML"),
]


def brute_bm25(docs: dict, query: str, k1=1.5, b=0.75) -> dict:
    words = {d: re.findall(r"(?u)\b\w+\b", t.lower()) for d, t in docs.items()}
    counts = {d: Counter(w) for d, w in words.items()}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    out = dict.fromkeys(docs, 0.0)
    for term in set(re.findall(r"(?u)\b\w+\b", query.lower())):
        df = sum(term in c for c in counts.values())
        if not df:
            continue
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1.0)
        for d, c in counts.items():
            if term in c:
                out[d] += idf * c[term] * (k1 + 1) / (c[term] + k1 * (1 - b + b * len(words[d]) / mean))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "candidate_id string, text string")


@pytest.fixture(scope="module")
def documents(spark, small):
    df = derived.table(spark, small, "documents").select("doc_id", "text")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


def ids(df) -> list:
    return [r[0] for r in df.collect()]


def test_tokens(spark):
    df = spark.createDataFrame([("Ünïcode_1 a-b, C++ x2!",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["ünïcode_1", "a", "b", "c", "x2"], []]


def test_small_corpus(corpus):
    assert ids(retrieval.bm25_topk(corpus, "Python AWS", 2)) == ["CAND_1", "CAND_2"]
    assert ids(retrieval.bm25_topk(corpus, "PyTorch")) == ["CAND_2"]
    assert retrieval.bm25_topk(corpus, "nothing here at all").count() == 0
    once, twice = (retrieval.bm25_topk(corpus, q).collect() for q in ("python", "python Python PYTHON"))
    assert once == twice


def test_bm25_equals_brute_force(spark, documents):
    df, texts = documents
    query = "the data of the nation and reading"
    expected = brute_bm25(texts, query)
    got = {r["doc_id"]: r["bm25_score"] for r in retrieval.bm25_scores(df, query, "doc_id").collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[d] - expected[d]) for d in got) < 1e-8


def test_stored_index_gives_the_same(spark, documents, tmp_path):
    df, _ = documents
    path = str(tmp_path / "index")
    retrieval.write_index(df, path, "doc_id", buckets=8)
    index = retrieval.read_index(spark, path)
    query = "the data of the nation and reading"
    direct = retrieval.bm25_topk(df, query, 50, "doc_id").collect()
    stored = retrieval.indexed_topk(index, query, 50, "doc_id")
    assert [tuple(r) for r in stored.collect()] == [tuple(r) for r in direct]
    assert retrieval.indexed_topk(index, "zzzzunknownzzz", 5, "doc_id").count() == 0
    tables = retrieval.index_tables(df, "doc_id")
    assert tables["terms"].exceptAll(index["terms"].select("term", "df")).count() == 0
    assert tables["corpus"].first()["n"] == index["corpus"].first()["n"]


@pytest.fixture(scope="module")
def block_index(spark, tmp_path_factory):
    """Documents of which few are rich in rare words, as an index with small blocks; repeated ids, texts without words."""
    draw = np.random.default_rng(4)
    common, rows = [f"w{i}" for i in range(40)], []
    for i in range(1500):
        words = list(draw.choice(common, int(draw.integers(1, 60))))
        if i % 300 == 7:
            words = ["rare", "gold"] * int(draw.integers(1, 4))
        rows.append((i if i % 100 else 5, " ".join(words)))
    rows += [(9001, None), (9002, " .,")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    path = str(tmp_path_factory.mktemp("index"))
    textindex.write(df, path, "doc_id", buckets=8, block_size=16)
    return df, textindex.read(spark, path)


@pytest.mark.parametrize("k", [1, 3, 20, 400, 3000])
@pytest.mark.parametrize("query", ["rare", "rare w1 w2", "w3 w3 W4 w5 gold", "unknown rare", "unknown", "", "w1 w2 w3 w4 w5 w6 w7"])
def test_block_max_search_equals_a_scan(block_index, query, k):
    df, index = block_index
    want = [tuple(r) for r in retrieval.bm25_topk(df, query, k, "doc_id").collect()]
    assert [tuple(r) for r in textindex.topk(index, query, k, "doc_id").collect()] == want


def test_block_max_search_skips(block_index):
    _, index = block_index
    few = textindex.Search(index, "rare w1 w2", 3, "doc_id").report().first()
    assert few.blocks_read < few.blocks / 2 and few.blocks_read + few.blocks_skipped == few.blocks and few.postings_read < few.postings / 2
    every = textindex.Search(index, "rare w1 w2", 5000, "doc_id").report().first()
    assert every.blocks_skipped == 0 and every.postings_read == every.postings


def test_block_headers(block_index):
    df, index = block_index
    n, mean = (index["corpus"].first()[c] for c in ("n", "mean_length"))
    assert n == df.count()
    forward = index["documents"].collect()
    assert max(Counter(r.block for r in forward).values()) <= 16
    best: dict = {}
    for r in forward:
        for term, tf in Counter(r.words).items():
            share = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * r.length / mean))
            size, last, impact = best.get((term, r.block), (0, (-1, None), 0.0))
            best[term, r.block] = (size + 1, max(last, (r.number, r.doc_id)), max(impact, share))
    heads = {(r.term, r.block): r for r in index["blocks"].collect()}
    assert heads.keys() == best.keys()
    assert all((heads[x].size, heads[x].last_id) == (s, last[1]) and heads[x].impact == pytest.approx(i) for x, (s, last, i) in best.items())


@pytest.mark.parametrize("buckets", [1, 7, 40, 64])
def test_postings_of_any_number_of_tasks(spark, tmp_path, monkeypatch, buckets):
    # words move as texts; counts, places and headers must come out of them whole.
    monkeypatch.setattr(textindex, "TASK_WORDS", 20)
    texts = ["a a:a_1 B b", "", None, "x " * 3000, "a 10 10 10 ünï b", "9:9 a\nb", *[f"w{i % 7} w{i % 5} a" for i in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartitionByRange(3, "doc_id")
    textindex.write(df, str(tmp_path), "doc_id", buckets=buckets, block_size=4)
    index = textindex.read(spark, str(tmp_path))
    want = {(t, r.block, r.doc_id, n, r.length) for r in index["documents"].collect() for t, n in Counter(r.words).items()}
    rows = index["postings"].collect()
    found = [(r.term, r.block, e.doc_id, e.tf, e.length) for r in rows for e in r.entries]
    assert len(found) == len(want) and set(found) == want and len({(r.term, r.block) for r in rows}) == len(rows)
    assert all([e.place for e in r.entries] == sorted({e.place for e in r.entries}) and r.bucket < buckets for r in rows)
    assert {(r.term, r.df) for r in index["terms"].collect()} == {(t, n) for t, n in Counter(t for t, *_ in want).items()}
    assert textindex.topk(index, "A 10 unknown", 50, "doc_id").collect() == retrieval.bm25_topk(df, "A 10 unknown", 50, "doc_id").collect()


def test_the_index_moves_words_once(spark, tmp_path):
    # tables and shuffles are bounded by the size of the stored texts, also where most words are rare.
    draw = np.random.default_rng(9)
    stems = ["".join(draw.choice(list("aeinrst"), 5 + i % 4)) for i in range(40000)]
    rows = [(i, " ".join(draw.choice(stems, 150))) for i in range(2000)]
    source = str(tmp_path / "texts")
    spark.createDataFrame(rows, "doc_id int, text string").repartition(8).write.parquet(source)
    files = lambda: {f.getName(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    textindex.write(spark.read.parquet(source), str(tmp_path / "index"), "doc_id")
    moved = sum(size for name, size in files().items() if name not in before and name.startswith("shuffle_"))
    stored, given = (sum(f.stat().st_size for f in (tmp_path / d).rglob("*.parquet")) for d in ("index", "texts"))
    assert stored < 3 * given and moved < 3 * given


def test_block_max_search_reads_only_its_buckets(block_index, capsys):
    _, index = block_index
    textindex.topk(index, "rare gold", 3, "doc_id").explain("formatted")
    plan = capsys.readouterr().out
    scans = [part for part in plan.split("Scan parquet")[1:] if "postings" in part.split("ReadSchema")[0]]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in p or "bucket#" in p.split("PushedFilters")[0] for p in scans)
    assert all("In(term" in p or "EqualTo(term" in p for p in scans) and "CartesianProduct" not in plan


def test_cosine_order_and_clamp(spark):
    stored = spark.createDataFrame(
        [("C1", [0.9, 0.1]), ("C2", [0.1, 0.9]), ("C3", [0.5, 0.5]), ("C4", [-1.0, 0.0])], "candidate_id string, embedding array<float>"
    )
    query = F.array(F.lit(1.0), F.lit(0.0))
    rows = retrieval.cosine_topk(stored, query, 4).collect()
    assert [r[0] for r in rows] == ["C1", "C3", "C2", "C4"]
    assert [round(r[1], 6) for r in rows] == [0.9, 0.5, 0.1, -1.0]
    clamped = retrieval.cosine_topk(stored, query, 4, clamp=True).collect()
    assert clamped[-1][1] == 0.0


def test_hybrid_equals_brute_force(spark, documents, small):
    df, texts = documents
    stored = derived.table(spark, small, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    matrix = {r["doc_id"]: np.array(r["embedding"], dtype="float64") for r in stored.collect()}
    query = "the data of the nation"
    scores = brute_bm25(texts, query)
    lo, hi = min(scores.values()), max(scores.values())
    expected = {
        d: 0.4 * (scores.get(d, 0.0) - lo) / (hi - lo) + 0.6 * float(v @ matrix[3]) for d, v in matrix.items()
    }
    best = sorted(expected, key=lambda d: (-round(expected[d], 9), d))[:40]
    vector = retrieval.stored_vector(stored, 3, "doc_id")
    for stage in (False, True):
        got = retrieval.hybrid_topk(df, stored, query, vector, 40, "doc_id", stage=stage).collect()
        assert [r["doc_id"] for r in got] == best
        assert max(abs(r["hybrid_score"] - expected[r["doc_id"]]) for r in got) < 1e-7


def test_no_word_in_common_leaves_only_similarity(spark, documents, small):
    df, _ = documents
    stored = derived.table(spark, small, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    vector = retrieval.stored_vector(stored, 3, "doc_id")
    rows = retrieval.hybrid_topk(df, stored, "qqqqzzzz", vector, 5, "doc_id").collect()
    assert all(r["bm25_norm"] == 0.0 for r in rows) and rows[0]["doc_id"] == 3


@pytest.mark.parametrize("block", [4096, 7])
def test_many_queries_equal_single_queries(spark, documents, small, block, monkeypatch):
    """Also when the queries take several passes and a task sees several record batches."""
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", block)
    df, texts = documents
    stored = derived.table(spark, small, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = {i: texts[i][:200] for i in (0, 3, 8, 11, 40, 41, 42, 43)}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query_text string").join(
        stored.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = retrieval.hybrid_batch(df, stored, queries, 6, "doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in (0, 11, 43):
        single = retrieval.hybrid_topk(df, stored, asked[q], retrieval.stored_vector(stored, q, "doc_id"), 6, "doc_id")
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in mine] == ids(single)
        assert [round(r["hybrid_score"], 6) for r in mine] == [round(r["hybrid_score"], 6) for r in single.collect()]


def test_keyword_caps_and_union(spark):
    people = frame(spark, [
        person(i, signals__open_to_work_flag=i % 2 == 0, skills=[skill("Python")] if i % 3 == 0 else [skill("Go")],
               profile__current_title="Chef", career_history=[job(title="Data Scientist" if i % 5 == 0 else "Cook")])
        for i in range(1, 61)
    ])
    found = retrieval.keyword_retrieve(people, ["python"], ["data scientist"], open_cap=4, skill_cap=3, title_cap=2)
    numbers = sorted(int(i[5:]) for i in ids(found))
    assert numbers == sorted({2, 4, 6, 8} | {3, 6, 9} | {5, 10})
    stored = spark.createDataFrame([("CAND_0000059", [1.0, 0.0]), ("CAND_0000001", [0.0, 1.0]), ("OTHER", [1.0, 0.0])],
                                   "candidate_id string, embedding array<float>")
    both = retrieval.union_retrieve(people, stored, F.array(F.lit(1.0), F.lit(0.0)), [], [], 1)
    scores = {r["candidate_id"]: r["semantic_score"] for r in both.collect()}
    assert scores["CAND_0000059"] == 1.0 and scores["CAND_0000002"] == 0.0 and "OTHER" not in scores


def test_built_in_encoder(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", "X, y. x!")], "candidate_id string, embedding_text string")
    rows = {r[0]: r[1] for r in retrieval.encode(df).collect()}
    assert len(rows["a"]) == 64 and sum(v * v for v in rows["a"]) == pytest.approx(1.0, abs=1e-6)
    assert rows["a"] == rows["c"] and set(rows["b"]) == {0.0}


def test_only_new_candidates_are_encoded_by_a_given_encoder(spark):
    import pandas as pd

    def encoder(batches):
        for batch in batches:
            yield pd.DataFrame({"candidate_id": batch["candidate_id"], "embedding": [[float(len(t))] for t in batch["embedding_text"]]})

    stored = spark.createDataFrame([(f"C{i}", [1.0]) for i in (1, 2, 3)], "candidate_id string, embedding array<float>")
    arriving = spark.createDataFrame([(f"C{i}", "ab" * i) for i in (2, 3, 4, 5, 5)], "candidate_id string, embedding_text string")
    new = retrieval.embed_new(arriving, stored, encoder)
    assert sorted((r[0], r[1]) for r in new.collect()) == [("C4", [8.0]), ("C5", [10.0])]
    assert retrieval.embed_new(arriving.where("false"), stored, encoder).count() == 0
    with pytest.raises(ValueError):
        retrieval.embed_new(arriving.drop("embedding_text"), stored)


def test_store_grows_or_is_rebuilt(spark):
    texts = spark.createDataFrame([(f"C{i}", f"text {i}") for i in (2, 3, 4, 5)], "candidate_id string, embedding_text string")
    first = retrieval.encode(spark.createDataFrame([(f"C{i}", f"text {i}") for i in (1, 2, 3)], texts.schema))
    assert sorted(ids(retrieval.updated_store(texts, first))) == ["C1", "C2", "C3", "C4", "C5"]
    broken = first.unionByName(first.where("candidate_id = 'C1'"))
    assert sorted(ids(retrieval.updated_store(texts, broken))) == ["C2", "C3", "C4", "C5"]
    assert sorted(ids(retrieval.updated_store(texts, first.where("false")))) == ["C2", "C3", "C4", "C5"]


def test_audit_of_stored_vectors(spark):
    people = spark.createDataFrame([(f"C{i}",) for i in range(5)], "candidate_id string")
    stored = spark.createDataFrame([("C1",), ("C2",), ("C2",), ("X",)], "candidate_id string")
    assert pipeline.embedding_audit(people, stored).first().asDict() == {
        "candidates": 5, "stored": 3, "pending": 3, "orphaned": 1, "duplicated": 1, "reset": True,
    }
    fine = pipeline.embedding_audit(people, stored.where("candidate_id = 'C1'")).first()
    assert fine["reset"] is False and fine["pending"] == 4


def test_unit_length(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.unit_length(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_texts_without_a_vector_and_vectors_without_a_text_are_found(spark):
    docs = spark.createDataFrame([("a", "rust"), ("b", "python search"), ("c", "cooking")], "candidate_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("d", [0.6, 0.8])], "candidate_id string, embedding array<double>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    got = [(r.candidate_id, r.bm25_norm, r.semantic_score) for r in retrieval.hybrid_topk(docs, vectors, "python", query, 4).collect()]
    assert got == [("a", 0.0, 1.0), ("b", 1.0, 0.0), ("d", 0.0, 0.6), ("c", 0.0, 0.0)]
    queries = spark.createDataFrame([(1, "python", [1.0, 0.0])], "query_id int, query_text string, query_vector array<double>")
    many = retrieval.hybrid_batch(docs, vectors, queries, k=4).orderBy("rank").collect()
    assert [(r.candidate_id, r.bm25_norm, r.semantic_score) for r in many] == got


def test_queries_without_vectors_are_answered_by_their_text(spark, tmp_path):
    texts = [(1, "red apple"), (2, "green pear pear"), (3, "blue plum")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    stored.write.parquet(f"{tmp_path}/embeddings.parquet")
    items = spark.createDataFrame([(2, "apple"), (50, "pear")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    best = {r.query_id: r for r in QUERIES["hybrid_batch"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert best[2].semantic_score == 1.0 and best[2].doc_id == 2
    assert best[50].doc_id == 2 and (best[50].bm25_norm, best[50].semantic_score, best[50].hybrid_score) == (1.0, 0.0, 0.4)
    vectors = stored.withColumnRenamed("vec_id", "doc_id")
    alone = spark.createDataFrame([(7, "plum", None)], "query_id long, query_text string, query_vector array<float>")
    found = retrieval.hybrid_batch(docs, vectors, alone, k=1, id_col="doc_id").first()
    assert (found.doc_id, found.semantic_score) == (3, 0.0)


# --- tables of queries and jobs ---------------------------------------------------------------


def test_batch_of_no_queries_and_repeated_ids(spark, corpus):
    vectors = corpus.select("candidate_id", F.array(F.lit(1.0)).alias("embedding"))
    kind = "query_id long, query_text string, query_vector array<double>"
    empty = retrieval.hybrid_batch(corpus, vectors, spark.createDataFrame([], kind))
    assert empty.count() == 0 and "rank" in empty.columns
    with pytest.raises(ValueError, match="unique"):
        retrieval.hybrid_batch(corpus, vectors, spark.createDataFrame([(1, "a", [1.0]), (1, "b", [1.0])], kind))


def test_batch_answers_queries_without_a_vector(spark, corpus):
    vectors = corpus.select("candidate_id", F.array(F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, "python aws", None), (2, "react", [1.0])], "query_id long, query_text string, query_vector array<double>")
    got = {(r.query_id, r["rank"]): (r.candidate_id, r.semantic_score) for r in retrieval.hybrid_batch(corpus, vectors, asked, k=1).collect()}
    assert got == {(1, 1): ("CAND_1", 0.0), (2, 1): ("CAND_3", 1.0)}


def test_query_vectors_are_made_once(spark, tmp_path):
    path = str(tmp_path / "store")
    queries = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None)], "query_id long, query_text string")
    made = {r.query_id: r.query_vector for r in encoded.encoded_queries(queries, path, "v1", make=encoded.digest_bag).collect()}
    assert made[1] == made[3] != made[2] and len(made[4]) == 64 and math.isclose(sum(x * x for x in made[2]), 1, rel_tol=1e-6)
    assert encoded.stored_queries(spark, path).count() == 3

    def failing(text):
        raise AssertionError("nothing is left to encode")

    again = encoded.encoded_queries(queries, path, "v1", make=failing)
    assert {r.query_id: r.query_vector for r in again.collect()} == made
    more = queries.union(spark.createDataFrame([(5, "d")], queries.schema))
    encoded.encoded_queries(more, path, "v1", make=encoded.digest_bag)
    assert encoded.stored_queries(spark, path).count() == 4
    encoded.encoded_queries(queries, path, "v2", make=encoded.digest_bag)
    assert encoded.stored_queries(spark, path).count() == 7


def test_ranking_of_many_jobs_equals_one_at_a_time(spark):
    people = frame(spark, [person(i, skills=[skill("python")] if i % 2 else [skill("java")], profile__years_of_experience=float(i)) for i in range(1, 9)])
    texts = people.select("candidate_id", F.concat_ws(" ", "profile.headline", F.array_join("skills.name", " ")).alias("embedding_text"))
    known = texts.select("candidate_id", encoded.digest_bag(F.col("embedding_text")).alias("embedding"))
    jobs = spark.createDataFrame(
        [(1, ["python"], 2.0, 5.0, "mid", "python engineer"), (2, ["java", "spring"], None, None, "senior", "java")],
        "jd_id long, must_have_skills array<string>, required_experience_min double, required_experience_max double, seniority_level string, summary_for_embedding string",
    ).withColumn("query_vector", encoded.digest_bag(F.col("summary_for_embedding")))
    settings = pipeline.Settings(as_of_year=2026, retrieve=6, top=4)
    got = pipeline.rank_jobs(people, texts, known, jobs, settings).collect()
    assert got
    for asked in jobs.collect():
        role = features.Role.of(asked.must_have_skills, asked.required_experience_min, asked.required_experience_max, asked.seniority_level)
        query = F.array(*[F.lit(x) for x in asked.query_vector])
        one = pipeline.rank_candidates(people, texts, known, asked.summary_for_embedding, query, role, settings).collect()
        mine = sorted((r for r in got if r.jd_id == asked.jd_id), key=lambda r: r["rank"])
        assert [(r["rank"], r.candidate_id, r.score, r.feature_breakdown) for r in mine] == [(r["rank"], r.candidate_id, r.score, r.feature_breakdown) for r in one]
