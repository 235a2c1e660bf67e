"""Contradictions, honeypots, negative signals and features on literal records."""

import pytest
from people import by_id, frame, job, person, skill
from pyspark.sql import functions as F

from shortlist.operators import features as feat
from shortlist.operators import screening


def contradictions(spark, *records):
    return by_id(screening.with_contradictions(frame(spark, list(records))))


def test_contradiction_rules(spark):
    clean = dict(career_history=[job(60)], skills=[skill("Java", "advanced", 60)])
    cases = {
        1: person(1, profile__current_title="Marketing Manager", skills=[skill("PyTorch", "advanced", 30)]),
        2: person(2, profile__years_of_experience=15.0, career_history=[job(24)]),
        3: person(3, skills=[skill("LangChain", duration=60), skill("langchain", duration=40)]),
        4: person(4, education=[{**person()["education"][0], "start_year": 2020, "end_year": 2018}], **clean),
        5: person(5, profile__current_title="Senior AI Engineer",
                  skills=[skill("Python", "beginner", 6), skill("PyTorch", "beginner", 12)]),
        6: person(6, profile__current_title="Senior Data Scientist", career_history=[job(36), job(24)],
                  skills=[skill("Python", "advanced", 60), skill("PyTorch", "advanced", 48)]),
        7: person(7, profile__current_title="Marketing Manager", skills=[skill("PyTorch", "expert", 30)]),
        8: person(8, career_history=[job(60, start="2021-05-01", end="2020-01-01"), job(0, start="bad", end="2019-01-01")]),
        9: person(9, skills=[skill("HR"), skill("LLM")]),
        10: person(10, profile__current_title="AI Lead", career_history=[job(60, title="Chef")],
                   skills=[skill("x", "advanced", 40)]),
        11: person(11, skills=[skill(f"k{i}", "advanced", 40) for i in range(61)]),
        12: person(12, profile__summary="A software engineer", profile__current_title="Recruiter"),
    }
    found = contradictions(spark, *cases.values())
    codes = {n: found[f"CAND_{n:07d}"]["contradiction_codes"] for n in cases}
    assert codes[1] == ["C1"] and codes[2] == ["C3"] and codes[3] == ["C4", "C4"] and codes[4] == ["C7"]
    assert codes[5] == ["C10"] and codes[6] == [] and codes[7] == [] and codes[8] == ["C8"] and codes[9] == ["C9"]
    assert codes[10] == ["C2"] and codes[11] == ["C6"] and codes[12] == ["C5"]
    assert found["CAND_0000003"]["contradiction_score"] == 1.0
    assert found["CAND_0000002"]["contradiction_reasons"] == [
        "Unrealistic experience claim: Stated 15.0 YoE but career history adds up to 2.0 YoE."
    ]
    assert "Education anomaly: Start year 2020 is after end year 2018." in found["CAND_0000004"]["contradiction_reasons"]


def test_missing_parts_take_defaults(spark):
    row = contradictions(spark, {"candidate_id": "CAND_0000001"})["CAND_0000001"]
    assert row["contradiction_score"] == 0.0 and row["contradiction_reasons"] == []
    honey = by_id(screening.with_honeypots(frame(spark, [{"candidate_id": "CAND_0000001"}]), 2026))
    assert honey["CAND_0000001"]["honeypot_probability"] == 0.0


def test_honeypot_rules(spark):
    cases = {
        1: person(1, skills=[skill("LangChain", duration=72), skill("Java")]),
        2: person(2, profile__current_title="Frontend Developer", skills=[skill("Java"), skill("Spring"), skill("Docker")]),
        3: person(3, profile__years_of_experience=3.0, skills=[skill(f"k{i}") for i in range(77)] + [skill("java")]),
        4: person(4, skills=[skill("LangChain"), skill("ChatGPT"), skill("Prompt Engineering"), skill("java")]),
        5: person(5, skills=[skill("Java"), skill("Spring"), skill("Docker")]),
        6: person(6, skills=[skill("PyTorch Kubernetes", duration=160), skill("java")]),
        7: person(7, profile__years_of_experience=20.0),
        8: person(8, skills=[skill(n) for n in ("aws", "gcp", "pytorch", "keras", "react", "vue", "redis", "mongodb", "java")]),
        9: person(9, signals__recruiter_response_rate=1.0, signals__profile_views_received_30d=1001,
                  skills=[skill(f"k{i}") for i in range(50)] + [skill("java")]),
    }
    found = by_id(screening.with_honeypots(frame(spark, list(cases.values())), 2026))
    codes = {n: found[f"CAND_{n:07d}"]["honeypot_codes"] for n in cases}
    assert codes[1] == ["H1"] and codes[2] == ["H2"] and codes[3] == ["H4", "H5"] and codes[4] == ["H9"]
    assert codes[5] == [] and codes[6] == ["H1", "H1"] and codes[7] == ["H8"] and codes[8] == ["H7"] and codes[9] == ["H6"]
    assert "Impossible profile: Claimed 6.0 years in langchain, which only released in 2022." in found[
        "CAND_0000001"]["honeypot_reasons"]
    without_views = by_id(screening.with_honeypots(frame(spark, [cases[9]]), 2026, views_field=""))
    assert without_views["CAND_0000009"]["honeypot_codes"] == []


def test_negative_signals(spark):
    cases = {
        1: person(1, skills=[skill(f"k{i}", "expert", endorsements=0) for i in range(16)],
                  signals__skill_assessment_scores={}),
        2: person(2, signals__profile_completeness_score=10.0, signals__open_to_work_flag=False,
                  signals__notice_period_days=150, career_history=[job(3)] * 5),
        3: person(3),
    }
    found = by_id(screening.with_negative_signals(frame(spark, list(cases.values()))))
    assert found["CAND_0000001"]["negative_codes"] == ["N1", "N2"]
    assert found["CAND_0000001"]["negative_reasons"] == [
        "Possible keyword stuffing: 16 skills, avg endorsements=0.0", "16 unverified 'expert' skills",
    ]
    assert found["CAND_0000002"]["negative_reasons"] == [
        "Very low profile completeness: 10%", "Not marked as open to work", "Long notice period: 150 days",
        "High job hopping: avg tenure 3 months",
    ]
    assert found["CAND_0000002"]["penalty"] == pytest.approx(0.15)
    assert found["CAND_0000003"]["penalty"] == 0.0


def test_gate(spark):
    people = frame(spark, [person(1), person(2, profile__current_title="Marketing Manager",
                                             skills=[skill("PyTorch", "advanced", 36)])])
    kept = screening.fraud_gate(screening.with_fraud_scores(people, 2026))
    assert [r["candidate_id"] for r in kept.collect()] == ["CAND_0000001"]


def test_feature_row(spark):
    record = person(
        profile__current_title="Senior Machine Learning Engineer", profile__summary="Worked at a startup doing AI.",
        skills=[skill(n) for n in ("Python", "PyTorch", "Docker", "Pinecone", "BM25")],
        career_history=[job(24), job(36)], signals__github_activity_score=0.9, signals__notice_period_days=15,
    )
    role = feat.Role.of(["Python", "PyTorch", "Kubernetes"], 3.0, 7.0, "senior")
    row = feat.with_features_31(frame(spark, [record]), role, F.lit(0.8), F.lit(0.9)).first()
    assert row["skill_overlap_score"] == pytest.approx(2 / 3)
    ones = ["years_experience_score", "production_ml_score", "startup_score", "vector_db_score", "retrieval_score",
            "python_score", "open_source_score", "india_score", "open_to_work_score", "notice_period_score",
            "career_growth_score", "title_progression_score", "seniority_score", "hybrid_score", "relocation_score"]
    assert [n for n in ones if row[n] != 1.0] == []
    assert (row["average_tenure"], row["job_hops"], row["bm25_score"], row["embedding_similarity"]) == (2.5, 2.0, 0.8, 0.9)


def test_empty_candidate_and_job(spark):
    df = frame(spark, [{"candidate_id": "CAND_0000001"}])
    row = feat.with_features_31(df, feat.Role.of([], None, None, "unknown")).first()
    assert row["years_experience_score"] == 1.0 and row["skill_overlap_score"] == 1.0
    assert row["profile_completeness_score"] == 0.8 and row["notice_period_score"] == 0.5
    assert row["seniority_score"] == pytest.approx(0.8) and row["average_tenure"] == 0.0


def test_strict_signal_names_keep_three_features_constant(spark):
    df = frame(spark, [person()])
    row = feat.with_features_31(df, feat.Role.of([], None, None, "mid"), signals=feat.SignalNames.strict()).first()
    assert (row["open_to_work_score"], row["profile_views_score"], row["hybrid_score"]) == (0.0, 0.0, 0.0)


def test_years_score_outside_the_range(spark):
    people = frame(spark, [person(1, profile__years_of_experience=2.0), person(2, profile__years_of_experience=9.0)])
    rows = by_id(feat.with_features_31(people, feat.Role.of(["x"], 4.0, 8.0, "lead")))
    assert rows["CAND_0000001"]["years_experience_score"] == 0.5 and rows["CAND_0000002"]["years_experience_score"] == 0.8


def test_second_feature_set(spark):
    record = person(
        profile__current_title="Senior Engineer", skills=[skill("Research"), skill("python"), skill("Llama")],
        career_history=[job(1, "A", "Google"), job(1, "B", "Google"), job(1, "B", "Google"), job(1, "C", "Other")],
    )
    row = feat.with_features_26(frame(spark, [record])).first()
    assert row["promotions"] == 1.0 and row["title_progression"] == 1.0 and row["company_quality"] == 1.0
    assert row["retrieval_score"] == 1.0 and row["llm_score"] == 1.0  # fragments: "search" in "research"
    assert row["average_tenure"] == 1.25 and row["recent_activity"] == 0.5 and row["keyword_stuffing_score"] == 0.03
    assert len(feat.FEATURES_26) == 26 and len(feat.FEATURES_31) == 31
