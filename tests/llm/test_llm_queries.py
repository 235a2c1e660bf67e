"""The registered queries: SQL equality, contract columns, and the pipeline stage by stage."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from brute_llm import brute_components, brute_removed

import corpus_pipeline
from shortlist.llm import decontaminate
from shortlist.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op2_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op3_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op4_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_decontamination": {"doc_id", "item_id"},
    "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11_neural": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op12_spelling": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_once(spark, small, name):
    frame = QUERIES[name](spark, small)
    assert COLUMNS[name] <= set(frame.columns)
    if name not in ("op5_decontamination", "op12_spelling", "op13_collocations"):
        source = "pages" if name == "op9_warc" else "documents"
        assert frame.count() == spark.read.parquet(f"{small}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, small, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = base.sql(ORACLE[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, small).select(columns)
    assert Counter(map(tuple, got.collect())) == Counter(base.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())


def test_repeated_strings_of_the_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, small).collect()}
    assert [got[r.doc_id] for r in rows] == brute_removed([r.text for r in rows], 400)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    extra = spark.createDataFrame([(900001, "123 456", None, "s", 7), (900002, None, None, "s", 0), (900003, texts[0].upper(), "en", "s", 1)], docs.schema)
    docs, kept = docs.union(extra), []
    texts |= {900001: "123 456", 900002: None, 900003: texts[0].upper()}
    for _, function in corpus_pipeline.STAGES[:4]:
        docs = docs.sparkSession.createDataFrame(function(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    told, single, apart, clean = kept
    assert {900001, 900002}.isdisjoint(told) and len(told) >= 0.98 * len(texts) - 2
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    largest = {lower(texts[i]): i for i in sorted(told)}
    assert single == set(largest.values())
    assert apart == {i for i, (size, root) in brute_components([(i, texts[i]) for i in single], 5).items() if root == i}
    items = [" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    holds = {i for i in apart if any(f" {item} " in f" {' '.join(decontaminate.words_of(texts[i]))} " for item in items)}
    assert clean == apart - holds
    done = corpus_pipeline.STAGES[4][1](spark, docs, small)
    assert {r.doc_id for r in done.collect()} == clean


def test_pipeline_stages_keep_clashing_columns(spark, small):
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 3), (2, "ONE two three", "en", "s", 3), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int")
    names = ["_text", "text_digest", "Text_digest_", "kept_id", "kept_text", "dropped_id", "id", "key", "class", "kept", "component_id"]
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    for _, function in corpus_pipeline.STAGES[1:4]:
        kept = function(spark, docs, small)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[name] == name for r in rows for name in names)
        assert function(spark, docs.limit(0), small).count() == 0


def test_pipeline_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
