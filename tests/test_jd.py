"""Job descriptions: every extraction on literal texts."""

import jd_texts
import pytest
from pyspark.sql import functions as F

from shortlist.functions import text
from shortlist.operators import jd, phrases
from shortlist.plans import derived


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(list(jd_texts.ALL.items()), "jd_id string, text string")
    return {r["jd_id"]: r.asDict(True) for r in jd.parse_jds(df).collect()}


def test_clean_text(spark):
    raw = "a–b—c ‘x’ y  \r\n\r\n\r\n\r\n• z\t\rend \n "
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalised(F.col("t"))).first()[0] == "a-b-c 'x' y\n\n•  z\nend"


def test_sentences(spark):
    body = "First one. Second one! third stays.\n- bullet item\n1. numbered item\n* x\nNo. 5"
    df = spark.createDataFrame([(body,)], "t string")
    assert df.select(text.sentences(F.col("t"))).first()[0] == [
        "First one.", "Second one! third stays.", "bullet item", "numbered item", "x\nNo. 5",
    ]


def test_sections(spark):
    body = "Intro\nRequirements:\n- a\n\nMandatory\nb\nPreferred\nPerks\n\nc\n" + "x" * 90 + " required"
    df = spark.createDataFrame([(body,), ("no headers here\nat all",), ("Requirements",)], "t string")
    got = [r[0] for r in df.select(text.sections(F.col("t"))).collect()]
    assert got[0] == {"requirements": "- a\nb", "perks": "c\n" + "x" * 90 + " required"}
    assert got[1] == {"full_text": "no headers here\nat all"} and got[2] == {"full_text": "Requirements"}


def test_sections_of_a_description(parsed):
    assert set(parsed["senior_ml"]["sections"]) == {"about_company", "requirements", "preferred", "responsibilities", "perks"}


def test_skills(parsed):
    senior = parsed["senior_ml"]
    assert {"Python", "PyTorch", "SQL", "RAG", "Docker", "Kubernetes", "Fine-tuning"} <= set(senior["must_have_skills"])
    assert {"LangChain", "LlamaIndex", "MLflow", "Weights & Biases"} <= set(senior["nice_to_have_skills"])
    for row in parsed.values():
        assert not set(row["must_have_skills"]) & set(row["nice_to_have_skills"])
        assert len(row["all_skills"]) == len(set(row["all_skills"]))
        assert len(row["must_have"]) <= 30
        order = [(m["context"] != "must_have", -m["confidence"]) for m in row["must_have"]]
        assert order == sorted(order)
    assert {"BERT", "Hugging Face"} <= set(parsed["fintech_nlp"]["all_skills"])
    # Without its own section the whole text is searched for must-haves, which leaves nothing nice to have.
    assert parsed["minimal"]["nice_to_have_skills"] == [] and parsed["empty"]["must_have"] == []


def test_context_and_confidence(spark):
    body = "Words to begin with.\n- Kafka is required and mandatory\n- Redis would be great, a plus\n- Django without experience required\n- Flask here"
    df = spark.createDataFrame([("j", body)], "jd_id string, text string")
    row = jd.parse_jds(df).first()
    got = {m["name"]: (m["context"], round(m["confidence"], 2)) for m in row["must_have"]}
    assert got["Kafka"] == ("must_have", 0.85) and got["Flask"] == ("must_have", 0.65)
    assert got["Redis"] == ("nice_to_have", 0.85) and got["Django"] == ("nice_to_have", 0.55)


def test_a_lone_r_ranks_by_the_length_of_its_pattern(spark):
    df = spark.createDataFrame([("j", "Python, Java and R required")], "jd_id string, text string")
    found = jd.parse_jds(df).first()["must_have_skills"]
    assert [name for name in found if name in ("Python", "R", "Java")] == ["Python", "R", "Java"]


def test_whole_word_matching(spark):
    body = "Requirements\nGood react, Python. Rest of the argument in Go, C++ and node.js"
    df = spark.createDataFrame([("j", body)], "jd_id string, text string")
    by_part = set(jd.parse_jds(df).first()["must_have_skills"])
    whole = set(jd.parse_jds(df, match="word").first()["must_have_skills"])
    assert "R" in by_part and "Git" not in whole
    assert whole == {"React", "Python", "REST API", "Go", "C++", "Node.js"}
    own = jd.parse_jds(df, skills={"Argument": ["quarrel"]}).first()
    assert own["must_have_skills"] == ["Argument", "R"] or own["must_have_skills"] == ["Argument"]


@pytest.mark.parametrize("name,low,high", [
    ("senior_ml", 6.0, 9.0), ("junior_data", 0.0, 1.0), ("director", 14.0, None), ("fintech_nlp", 4.0, 8.0),
    ("minimal", 3.0, 7.0), ("caps", 6.0, None),
])
def test_experience(parsed, name, low, high):
    assert (parsed[name]["experience"]["min"], parsed[name]["experience"]["max"]) == (low, high)
    assert parsed[name]["experience"]["raw"]


def test_experience_forms(spark):
    texts = ["10 to 15 yrs", "8-5 years", "at least 4.5 years", "experience of 6 years", "2 years relevant exp", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(jd.experience(F.col("t")).alias("e"))
    got = [(r["e"]["min"], r["e"]["max"]) if r["e"] else None for r in df.collect()]
    assert got == [(10.0, 15.0), (5.0, 8.0), (4.5, 8.5), (6.0, 10.0), (2.0, 6.0), None]
    middle = spark.range(1).select(jd.midpoint(F.lit(5.0), F.lit(8.0)), jd.midpoint(F.lit(5.0), F.lit(None).cast("double")))
    assert tuple(middle.first()) == (6.5, 5.0)


@pytest.mark.parametrize("name,level", [
    ("senior_ml", "senior"), ("junior_data", "junior"), ("director", "director"), ("minimal", "mid"), ("empty", "unknown"),
])
def test_seniority(parsed, name, level):
    assert parsed[name]["seniority"]["level"] == level
    assert parsed[name]["is_senior_role"] == (level in ("senior", "director"))


def test_seniority_details(spark):
    cases = [("vector work", None, None), ("cto wanted", None, None), ("senior role", 1.0, 2.0), ("a role", 0.0, 0.0),
             ("a role", 13.0, None), ("a role", 9.0, 9.0), ("senior lead", None, None)]
    df = spark.createDataFrame(cases, "t string, lo double, hi double")
    out = df.select(jd.reconciled_seniority(jd.stated_seniority(F.col("t")), F.col("lo"), F.col("hi")).alias("s"))
    assert [(r["s"]["level"], r["s"]["confidence"]) for r in out.collect()] == [
        ("unknown", 0.0), ("executive", 0.95), ("senior", 0.8), ("intern", 0.55), ("principal", 0.55), ("lead", 0.55),
        ("senior", 0.9),
    ]


def test_place_and_mode(parsed, spark):
    place = {n: parsed[n]["location"] for n in parsed}
    assert (place["senior_ml"]["city"], place["senior_ml"]["country"], place["senior_ml"]["work_mode"]) == (
        "Pune", "India", "hybrid")
    assert place["junior_data"]["work_mode"] == "onsite" and place["minimal"]["work_mode"] == "remote"
    assert place["fintech_nlp"]["visa_sponsorship"] and place["unicode"]["city"] == "Bangalore"
    df = spark.createDataFrame([("based in new delhi",), ("somewhere in the uk",)], "t string")
    plain = [r[0] for r in df.select(jd.location(F.col("t"))).collect()]
    assert (plain[0]["city"], plain[1]["city"], plain[1]["country"]) == ("Delhi", None, "UK")
    assert df.select(jd.location(F.col("t"), longest_match=True)).first()[0]["city"] == "New Delhi"


def test_startup(parsed):
    found = parsed["senior_ml"]["startup"]
    assert found["is_startup"] and found["funding_stage"] == "series_b" and found["fast_paced"]
    assert found["ownership_culture"] and found["equity_mentioned"] and "series b" in found["signals"]
    assert not parsed["director"]["startup"]["is_startup"]


def test_leadership(parsed):
    senior, director = parsed["senior_ml"]["leadership"], parsed["director"]["leadership"]
    assert senior["requires_management"] and (senior["min_direct_reports"], senior["max_direct_reports"]) == (3, 5)
    assert director["strategy_ownership"] and director["hiring_manager"] and director["cross_functional"]
    assert (director["min_direct_reports"], director["max_direct_reports"]) == (6, 9)
    assert not parsed["junior_data"]["leadership"]["requires_management"] and senior["signals"]


def test_negative(parsed):
    assert [(n["signal"], n["category"]) for n in parsed["junior_data"]["negatives"]] == [("No remote work", "availability")]


def test_salary(parsed, spark):
    assert parsed["senior_ml"]["salary"] == {"min": 35.0, "max": 70.0}
    assert parsed["fintech_nlp"]["salary"] == {"min": 20.0, "max": 38.0}
    assert parsed["unicode"]["salary"] == {"min": 20.0, "max": 35.0} and parsed["minimal"]["salary"] is None
    one = spark.createDataFrame([("Rs. 30 LPA",)], "t string").select(jd.salary(F.col("t"))).first()[0]
    assert (one["min"], one["max"]) == (30.0, 45.0)


def test_titles(parsed, spark):
    assert parsed["senior_ml"]["titles"][0] == "Senior Ranking Engineer - Pune (Hybrid)"
    assert any("NLP" in t for t in parsed["fintech_nlp"]["titles"])
    body = "Role: Data Engineer\nWe are hiring a Platform Wizard, now. data engineer"
    df = spark.createDataFrame([(body,)], "t string")
    titles = df.select(jd.target_titles(F.col("t"), F.lower("t"))).first()[0]
    assert titles == ["Role: Data Engineer", "Platform Wizard", "Data Engineer"]


def test_industries(parsed):
    assert "FinTech / Finance" in parsed["fintech_nlp"]["industries"]


def test_summary_and_flags(parsed, spark):
    summary = parsed["senior_ml"]["summary_for_embedding"]
    assert 50 < len(summary) <= 2000 and "Python" in summary and "Seniority: senior" in summary
    for name, row in parsed.items():
        assert row["char_count"] == len(row["clean"]), name
    df = spark.createDataFrame(list(jd_texts.ALL.items()), "jd_id string, text string")
    wanted = {r["jd_id"]: r for r in jd.requirements(jd.parse_jds(df)).collect()}
    assert wanted["senior_ml"]["production_ml_requirements"] and not wanted["minimal"]["production_ml_requirements"]
    assert wanted["senior_ml"]["leadership_requirements"]["requires_management"]
    assert wanted["senior_ml"]["preferred_skills"] == wanted["senior_ml"]["nice_to_have_skills"]
    assert wanted["junior_data"]["negative_signals"] == ["No remote work"]


def test_a_table_of_descriptions_is_parsed_without_a_shuffle(spark, small, capsys):
    plan = jd.parse_jds(derived.table(spark, small, "documents").selectExpr("doc_id AS jd_id", "text"))
    plan.explain("formatted")
    shown = capsys.readouterr().out
    assert "Scan parquet" in shown and "Exchange" not in shown and "EvalPython" not in shown


def test_uncapped_description_keeps_everything(spark):
    skills = {f"Tool{i}x": [f"tool{i}x"] for i in range(40)}
    named = ", ".join(skills)
    body = "\n".join([
        "Alpha", "Beta", "Gamma", "Late Engineer",
        *[f"Role: {letter * 5} Engineer" for letter in "ABCDEFGHI"],
        "You will lead a team and mentor engineers. " * 20,
        "Requirements", f"- {named}", "Preferred", f"- {named} wanted, " + "y" * 600,
    ])
    df = spark.createDataFrame([("a", body)], "jd_id string, text string")
    cut = jd.parse_jds(df, skills=skills).first()
    whole = jd.parse_jds(df, skills=skills, caps=jd.UNCAPPED).first()
    assert (len(cut["must_have"]), len(whole["must_have"])) == (30, 40)
    assert len(cut["titles"]) == 8 and "Late Engineer" not in cut["titles"]
    assert len(whole["titles"]) > 9 and "Late Engineer" in whole["titles"]
    assert max(len(v) for v in cut["sections"].values()) == 500 < max(len(v) for v in whole["sections"].values())
    assert len(cut["summary_for_embedding"]) <= 2000 < len(whole["summary_for_embedding"])
    assert whole["clean"] in whole["summary_for_embedding"] and ", ".join(whole["must_have_skills"]) in whole["summary_for_embedding"]
    assert ", ".join(whole["titles"]) in whole["summary_for_embedding"]


def test_uncapped_snippets(spark, monkeypatch):
    monkeypatch.setattr(jd.vocab, "LEADERSHIP_PATTERNS", [(f"lead{i} .*", "technical_lead") for i in range(12)])
    monkeypatch.setattr(jd, "_LEADERSHIP_WORDS", [["lead"]] * 12)
    monkeypatch.setattr(jd.vocab, "NEGATIVE_PATTERNS", [("no freshers.*", "experience", "no freshers")])
    monkeypatch.setattr(jd, "_NEGATIVE_WORDS", [["fresher"]])
    body = "\n".join([*[f"lead{i} " + "z" * 90 for i in range(12)], "No freshers " + "q" * 150])
    df = spark.createDataFrame([(body,)], "t string")
    for caps, count, chars, raw in ((jd.CAPS, 10, 60, 100), (jd.UNCAPPED, 12, 97, 162)):
        row = df.select(jd.leadership_signals(F.col("t"), caps).alias("s"), jd.negative_signals(F.col("t"), caps).alias("n")).first()
        assert len(row["s"]["signals"]) == count and max(map(len, row["s"]["signals"])) == chars
        assert [len(n["raw"]) for n in row["n"]] == [raw]


# --- mentions by a phrase join -----------------------------------------------------------------


@pytest.mark.parametrize("caps", [jd.CAPS, jd.UNCAPPED])
def test_phrase_join_finds_what_word_search_finds(spark, small, caps):
    jds = derived.job_descriptions(spark, small)
    extra = spark.createDataFrame([
        (-1, None), (-2, ""), (-3, "Machine. Learning and machine learning! No C++, but R. R"), (-4, "Requirements:\nPython, c#, node.js. sql\nPreferred:\nNot required: Docker"),
        (-5, "python " * 3000),
    ], "jd_id long, text string")
    parsed = jd.with_clean_text(jds.unionByName(extra))
    want = sorted((r.jd_id, m.section, m.name, m.context, round(m.confidence, 6)) for r in jd.with_skills(parsed, match="word", caps=caps).collect() for m in r.must_have + r.nice_to_have)
    got = phrases.word_mentions(parsed, caps=caps).collect()
    assert sorted((r.jd_id, r.section, r.name, r.context, round(r.confidence, 6)) for r in got) == want
    assert {-3, -4, -5} <= {r.jd_id for r in got} and any(" " in r.name for r in got)


def test_phrase_join_takes_a_table_of_any_size(spark, capsys):
    """The list is joined, not written into the expression: ten thousand more spellings leave the projection as it is."""
    parsed = jd.with_clean_text(spark.createDataFrame([(1, "We need zeta 9999 and alpha 12.")], "jd_id long, text string"))
    table = spark.range(10_000).select(F.concat(F.lit("zeta "), F.col("id")).alias("phrase"), F.concat(F.lit("Z"), F.col("id")).alias("name"), F.col("id").cast("int").alias("rank"))
    found = phrases.word_mentions(parsed, phrases=table)
    assert [(r.name, r.section) for r in found.collect()] == [("Z9999", "requirements")]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_runs_of_words_are_not_shuffled_to_the_spellings(spark, capsys):
    texts = spark.createDataFrame([(1, "Requirements\n- Python and R, machine learning required\nPreferred\n- Docker")], "jd_id long, text string")
    found = phrases.word_mentions(jd.with_clean_text(texts))
    assert {(r["name"], r["section"]) for r in found.collect()} >= {("Python", "requirements"), ("R", "requirements"), ("Docker", "preferred")}
    found.explain("simple")
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Scan ExistingRDD") <= 3  # the texts are parsed once, beside two literal lists


def test_a_part_is_cut_into_sentences_once_and_the_whole_text_once(spark):
    found = jd.with_skills(jd.with_clean_text(spark.createDataFrame([(1, "Python")], "jd_id long, text string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 3  # the text, its requirements and its preferred section


def test_spellings_of_several_words_are_found_within_and_across_lines(spark):
    skills = {"Deep": ["very deep thing"], "Broken": ["broken\nline"], "Part": ["ast.thi"], "Absent": ["thing very"]}
    text = "About\nA broken\nline of very deep\n\nRequirements\n- must have a very deep thing\n- last.thing\n"
    rows = spark.createDataFrame([(1, text), (2, "A broken\nline. A very deep thing."), (3, None)], "jd_id long, text string")
    found = jd.with_skills(jd.with_clean_text(rows), skills=skills)
    all_skills = {r["jd_id"]: set(r["all_skills"]) for r in found.collect()}
    assert all_skills == {1: {"Deep", "Broken", "Part"}, 2: {"Broken", "Deep"}, 3: set()}
