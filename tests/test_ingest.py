"""Ingest, validation, the six tables, load-once and streaming."""

import json
import os
import time
from pathlib import Path

import pytest
from people import frame, job, lines, person, skill
from pyspark.sql import functions as F

from shortlist.operators import encoded, normalise, retrieval
from shortlist.plans import catalog, derived
from shortlist.plans.warehouse import warehouse
from shortlist.sources import ingest, tables
from shortlist.streaming import encoding
from shortlist.streaming import ingest as streaming

CASES = {
    "bad id": (person(candidate_id="CAND_12"), "candidate_id:pattern"),
    "years": (person(profile__years_of_experience=51.0), "profile.years_of_experience:range"),
    "no career": (person(career_history=[]), "career_history:length"),
    "long career": (person(career_history=[job()] * 11), "career_history:length"),
    "many schools": (person(education=person()["education"] * 6), "education:length"),
    "work mode": (person(signals__preferred_work_mode="moon"), "signals.preferred_work_mode:enum"),
    "rate": (person(signals__recruiter_response_rate=1.2), "signals.recruiter_response_rate:range"),
    "assessment": (person(signals__skill_assessment_scores={"a": 101.0}), "signals.skill_assessment_scores:range"),
    "endorsements": (person(skills=[skill("a"), skill("b", endorsements=-1)]), "skills[1].endorsements:range"),
    "no profile": ({k: v for k, v in person().items() if k != "profile"}, "profile:required"),
    "text for number": (person(signals__connection_count="7"), "signals.connection_count:required"),
    "school year": (person(education=[{**person()["education"][0], "start_year": 1950}]), "education[0].start_year:range"),
    "language level": (person(languages=[{"language": "x", "proficiency": "good"}]), "languages[0].proficiency:enum"),
}


def test_each_broken_constraint_is_named(spark):
    checked = ingest.parse_lines(lines(spark, [record for record, _ in CASES.values()]))
    found = {r["line_id"]: r for r in checked.collect()}
    for i, (name, (_, code)) in enumerate(CASES.items()):
        assert found[i]["violations"] == [code], name
        assert found[i]["status"] == "skipped", name


def test_malformed_and_blank_lines(spark):
    rows = [person(1), '{"candidate_id": "CAND_', "", "   ", person(2), "{'candidate_id': 'x'}"]
    checked = ingest.parse_lines(lines(spark, rows))
    assert ingest.load_stats(checked).first().asDict() == {
        "total_lines": 6, "valid_records": 2, "skipped_records": 2, "success_rate": 0.3333,
    }
    log = ingest.quarantine(checked, keep=200).collect()
    assert [(r["line_id"], r["reason"]) for r in log] == [(1, "JSON parse error"), (5, "JSON parse error")]


def test_error_count_and_empty_input(spark):
    checked = ingest.parse_lines(lines(spark, [person(skills=[skill("a", endorsements=-1)] * 3, profile__headline=None)]))
    assert ingest.quarantine(checked).first()["reason"] == "Validation error: 4 errors"
    assert ingest.load_stats(checked.where("false")).first()["success_rate"] == 0.0


def test_defaults_of_optional_fields(spark):
    record = person()
    for key in ("certifications", "languages"):
        del record[key]
    del record["skills"][0]["duration_months"]
    del record["education"][0]["tier"]
    row = ingest.valid_candidates(ingest.parse_lines(lines(spark, [record]))).first()
    assert row["certifications"] == [] and row["languages"] == []
    assert row["skills"][0]["duration_months"] == 0 and row["education"][0]["tier"] == "unknown"


def test_other_name_of_the_signals(spark):
    record = person()
    record["behaviour"] = record.pop("signals")
    checked = ingest.parse_lines(lines(spark, [record]), signals_field="behaviour")
    assert checked.first()["status"] == "valid"


def test_json_array_and_line_files_agree(spark, tmp_path):
    records = [person(i) for i in range(1, 6)] + [person(6, profile__years_of_experience=99.0)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    array = ingest.read_json_array(spark, str(tmp_path / "a.json"))
    by_line = ingest.parse_lines(ingest.read_lines(spark, str(tmp_path / "a.jsonl")))
    ids = lambda df: sorted(r[0] for r in ingest.valid_candidates(df).select("candidate_id").collect())
    assert ids(array) == ids(by_line) == [f"CAND_{i:07d}" for i in range(1, 6)]
    assert ingest.load_stats(by_line).first()["total_lines"] == 7


def test_six_tables(spark):
    flat = normalise.six_tables(frame(spark, [person(skills=[skill("Java"), skill("java")])]))
    assert len(flat["profiles"].columns) == 38
    assert [(r["skill_name"], r["assessment_score"]) for r in flat["skills"].collect()] == [("Java", 80.0), ("java", -1.0)]
    assert flat["education"].first()["grade"] == "" and flat["career_history"].first()["end_date"] == ""
    assert flat["profiles"].first()["avg_assessment_score"] == 80.0
    empty = person(signals__skill_assessment_scores={})
    assert normalise.profiles(frame(spark, [empty])).first()["avg_assessment_score"] == -1.0


def test_retrieval_text_cuts_and_skips(spark):
    record = person(
        profile__summary="s" * 600, profile__headline="", skills=[skill(f"k{i}") for i in range(30)],
        career_history=[{**job(), "description": d} for d in ("one", "two", "three")],
    )
    text = frame(spark, [record]).select(normalise.retrieval_text()).first()[0]
    names = " ".join(f"k{i}" for i in range(20))
    assert text == f"{'s' * 500} Backend Engineer Software {names} one two"
    long = person(skills=[skill("x" * 400) for _ in range(20)])
    assert len(frame(spark, [long]).select(normalise.retrieval_text()).first()[0]) == 2000


def test_whole_texts_are_found_behind_every_cut(spark):
    record = person(
        profile__summary="s" * 2500 + " behind", skills=[skill(f"k{i}") for i in range(30)],
        career_history=[{**job(), "description": d} for d in ("one", "two", "three")],
    )
    people = frame(spark, [record, person(2), person(3)])
    texts = normalise.whole_texts(people)
    first = texts.where("candidate_id = 'CAND_0000001'").first()["embedding_text"]
    names = " ".join(f"k{i}" for i in range(30))
    assert first == f"Engineer at X {'s' * 2500} behind Backend Engineer Software {names} one two three"
    for word in ("behind", "k29", "three"):
        found = retrieval.bm25_topk(texts, word, 5, text_col="embedding_text").collect()
        assert [r["candidate_id"] for r in found] == ["CAND_0000001"]


def test_load_is_done_once_unless_forced(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = tables.load(lines(spark, [person(1), person(2), "broken"]), folder).first()
    assert (first["valid_records"], first["skipped_records"]) == (2, 1)
    again = tables.load(lines(spark, [person(3)]), folder).first()
    assert (again["valid_records"], again["total_lines"]) == (2, 2)
    forced = tables.load(lines(spark, [person(3)]), folder, force=True).first()
    assert forced["valid_records"] == 1
    stored = tables.read_tables(spark, folder)
    assert stored["profiles"].first()["candidate_id"] == "CAND_0000003"
    assert stored["skills"].dtypes == normalise.skills(frame(spark, [person()])).dtypes


def test_stream_equals_batch(spark, tmp_path, small):
    source, store, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    text = derived.raw_lines(warehouse(spark, small).candidates)
    text.select("value").repartition(5).write.text(source)
    streaming.load_stream(spark, source, store, state, files_per_batch=2).awaitTermination()
    checked = ingest.parse_lines(text)
    for name, build in normalise.NORMALISERS.items():
        batch = build(ingest.valid_candidates(checked))
        streamed = spark.read.parquet(f"{store}/{name}").select(*batch.columns)
        assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0, name
    total = streaming.progress(spark, store).orderBy(F.desc("batch_id")).first()
    stats = ingest.load_stats(checked).first()
    assert (total["lines_so_far"], total["valid_so_far"], total["skipped_so_far"]) == (
        stats["total_lines"], stats["valid_records"], stats["skipped_records"],
    )
    before = spark.read.parquet(f"{store}/profiles").count()
    streaming.load_stream(spark, source, store, state).awaitTermination()  # nothing new
    assert spark.read.parquet(f"{store}/profiles").count() == before
    assert streaming.percent_done(50, 100) == 50.0 and streaming.percent_done(100, 100) == 99.0


def test_stream_keeps_no_copies(spark, tmp_path):
    # the copy of a batch goes when the batch is stored, and what has been loaded goes where the caller says so.
    source, store, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("batch-*"))
    for first in (1, 21, 41):
        lines(spark, [person(n) for n in range(first, first + 20)] + ["broken"]).select("value").coalesce(1).write.mode("append").text(source, compression="gzip")
    arrived = set((tmp_path / "in").glob("part-*"))
    streaming.load_stream(spark, source, store, state).awaitTermination()
    assert set(shared.glob("batch-*")) == before and set((tmp_path / "in").glob("part-*")) == arrived
    streaming.load_stream(spark, source, f"{store}2", f"{state}2", delete_loaded=True).awaitTermination()
    assert set(shared.glob("batch-*")) == before
    for _ in range(100):  # files are deleted beside the stream; those of the last batch may stay
        if len(set((tmp_path / "in").glob("part-*"))) <= 1:
            break
        time.sleep(0.1)
    assert len(set((tmp_path / "in").glob("part-*"))) <= 1
    for out in (store, f"{store}2"):
        assert spark.read.parquet(f"{out}/profiles").count() == 60 and spark.read.parquet(f"{out}/quarantine").count() == 3


def test_stream_query_needs_little_disk(spark, small):
    # the lines of the query are stored compressed, and less stays than the text of the lines.
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.iterdir())
    assert {r["name"]: r["n"] for r in catalog.stream_ingest(spark, small).collect()}["profiles"] > 0
    made = [d for d in set(shared.iterdir()) - before if not d.name.startswith("warehouse")]
    text = derived.raw_lines(warehouse(spark, small).candidates).agg(F.sum(F.length("value"))).first()[0]
    assert sum(f.stat().st_size for d in made for f in d.rglob("*") if f.is_file()) < text


def test_embedding_stream_encodes_an_id_once(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    schema = "candidate_id string, embedding_text string"

    def arrive(name, ids):
        spark.createDataFrame([(i, f"text {i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        arrivals = spark.readStream.schema(schema).parquet(source)
        streaming.embed_stream(arrivals, store, state).awaitTermination()

    arrive("a", ["C1", "C2", "C3", "C1"])
    run()
    arrive("b", ["C2", "C3", "C4", "C5"])
    run()
    rows = spark.read.parquet(store).select("candidate_id", "batch_id").collect()
    assert sorted((r[0], r[1]) for r in rows) == [("C1", 0), ("C2", 0), ("C3", 0), ("C4", 1), ("C5", 1)]
    assert os.path.isdir(state)


# --- line numbers and conversion ----------------------------------------------------------------


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_are_numbered_across_pieces(spark, tmp_path, end):
    want = {}
    for name, count in (("a.jsonl", 4000), ("b.jsonl", 3), ("c.jsonl", 0)):
        lines = ["" if i % 7 == 3 else f"{name} {i} " + "x" * (i % 90) for i in range(count)]
        (tmp_path / name).write_bytes("".join(line + end for line in lines).encode())
        want |= {(name, i + 1): line for i, line in enumerate(lines)}
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        frame = ingest.read_lines(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 4
        rows = frame.collect()
    finally:
        spark.conf.set(key, before)
    assert {(r.file, r.line_id): r.value for r in rows} == want and len(rows) == len(want)


FORMS = [  # JSON value, as a whole number, as a number, as a truth value
    ("7", 7, 7.0, None), ('"7"', 7, 7.0, None), ("1.0", 1, 1.0, True), ('" 12.00 "', 12, 12.0, None), ("1.5", None, 1.5, None), ('"-3"', -3, -3.0, None),
    ('"1e3"', None, 1000.0, None), ('"abc"', None, None, None), ('""', None, None, None), ("true", 1, 1.0, True), ("false", 0, 0.0, False), ('"Yes"', None, None, True),
    ('"off"', None, None, False), ("0", 0, 0.0, False), ("99999999999", None, 99999999999.0, None), ('"1,000"', None, None, None), ("null", None, None, None), ('".5"', None, 0.5, None),
]


def test_forms_that_convert(spark):
    kinds = ("int", "double", "boolean")
    schema = ", ".join(f"{k[0]} {k}" for k in kinds)
    typed = spark.createDataFrame([], schema).schema
    rows = spark.createDataFrame([(i, "{" + ", ".join(f'"{k[0]}": {form}' for k in kinds) + "}") for i, (form, *_) in enumerate(FORMS)], "n int, value string")
    text = rows.select("n", F.from_json("value", ingest.loose(typed)).alias("t"))
    found = text.select("n", ingest.converted(F.col("t"), typed).alias("c"), ingest.unconverted(F.col("t"), typed, "").alias("bad")).collect()
    for r in sorted(found, key=lambda r: r.n):
        form, *want = FORMS[r.n]
        assert (r.c.i, r.c.d, r.c.b) == tuple(want), form
        assert r.bad == ([] if form == "null" else [f"{k[0]}:type" for k, w in zip(kinds, want) if w is None]), form


def test_both_modes_on_records(spark):
    other = person(signals__connection_count="12", signals__verified_email="yes", skills=[skill("a", endorsements=3.0)])
    broken = person(signals__connection_count="many", skills=[skill("a", endorsements=3.5)])
    found = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate((person(), other, broken))], "line_id int, value string")
    for mode, states in (("strict", ["valid", "skipped", "skipped"]), ("convert", ["valid", "valid", "skipped"])):
        rows = ingest.parse_lines(found, numbers=mode).orderBy("line_id").collect()
        assert [r.status for r in rows] == states
    assert (rows[1].signals.connection_count, rows[1].skills[0].endorsements, rows[1].signals.verified_email) == (12, 3, True)
    assert {"signals.connection_count:type", "skills[0].endorsements:type"} <= set(rows[2].violations)
    with pytest.raises(ValueError):
        ingest.parse_lines(found, numbers="loose")


# --- encoding with state in the stream ----------------------------------------------------------


def test_state_in_the_stream_and_progress(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kind = "candidate_id string, embedding_text string"

    def deliver(rows, name):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{source}/{name}")

    known = spark.createDataFrame([("OLD", "x")], kind)
    log = encoding.ProgressLog()
    spark.streams.addListener(log)
    try:
        for number, rows in enumerate(([("A", "one"), ("A", "one"), ("OLD", "two"), (None, "x")], [("A", "three"), ("B", "four"), ("B", "four")], [("B", "x"), ("OLD", "y")])):
            deliver(rows, f"part{number}")
            arrivals = spark.readStream.schema(kind).parquet(f"{source}/*")
            query = encoding.embed_stream(arrivals, store, state, known, make=encoded.digest_bag)
            log.follow(query)
            query.awaitTermination()
            assert log.ended.wait(30)
    finally:
        spark.streams.removeListener(log)
    found = spark.read.parquet(store)
    assert sorted(r.candidate_id for r in found.collect()) == ["A", "B"]
    one = spark.createDataFrame([("A", "one")], kind).select(encoded.digest_bag(F.col("embedding_text"))).first()[0]
    assert found.where("candidate_id = 'A'").first().embedding == one
    seen = log.frame(spark).groupBy("run").agg(F.sum("arrived").alias("arrived"), F.sum("ids").alias("ids"), F.max("ids_in_state").alias("held")).collect()
    assert sorted((r.arrived, r.ids, r.held) for r in seen) == [(2, 0, 2), (3, 1, 1), (3, 1, 2)]
