"""Scores, labels, explanations, the ranked output and the whole ranking."""

import pytest
from people import by_id, frame, job, person, skill
from pyspark.sql import functions as F

from shortlist.operators import features as feat
from shortlist.operators import ranking, scoring, screening
from shortlist.plans import pipeline
from shortlist.sources import files



def role():
    return feat.Role.of(["Python", "Docker"], 3.0, 8.0, "senior")


SETTINGS = pipeline.Settings(as_of_year=2026)


def featured(spark, *records, semantic=0.0):
    people = screening.with_fraud_scores(frame(spark, list(records)), 2026)
    return feat.with_features_31(people, role(), F.lit(0.0), F.lit(semantic))


def test_weights():
    assert scoring.Weights().semantic_match == 30.0
    with pytest.raises(ValueError, match="sum to exactly 100"):
        scoring.Weights(semantic_match=31.0)
    with pytest.raises(ValueError, match="between 0 and 100"):
        scoring.Weights(semantic_match=150.0, experience=-100.0)


def test_weights_file_with_fallback(spark, tmp_path):
    path = str(tmp_path / "weights")
    assert scoring.read_weights(spark, path) == scoring.Weights()
    chosen = scoring.Weights(semantic_match=40.0, experience=10.0)
    scoring.write_weights(spark, chosen, path)
    assert scoring.read_weights(spark, path) == chosen
    bad = tmp_path / "bad.json"
    bad.write_text('{"semantic_match": 99.0}')
    assert scoring.read_weights(spark, str(bad)) == scoring.Weights()


def test_labels_on_every_branch(spark):
    strong = [skill(n, duration=24) for n in ("Python", "Docker", "BM25", "Pinecone")]
    cases = {
        1: (person(1, skills=[skill("LangChain", duration=80), skill("python")]), 0),
        2: (person(2, skills=strong, career_history=[job(72)], profile__years_of_experience=6.0), 3),
        3: (person(3, skills=[skill("Python"), skill("Docker")], career_history=[job(48)], profile__years_of_experience=4.0,
                   profile__current_title="Engineer"), 2),
        4: (person(4, skills=[skill("Python")], career_history=[job(24)], profile__years_of_experience=2.0,
                   profile__current_title="Engineer"), 1),
        5: (person(5, skills=[skill("HTML"), skill("CSS")], profile__current_title="Engineer"), 0),
    }
    frame31 = featured(spark, *[r for r, _ in cases.values()], semantic=0.6).withColumn("hybrid_score", F.lit(0.98765))
    labels = by_id(scoring.pseudo_labels(frame31, semantic="embedding_similarity"))
    assert {n: labels[f"CAND_{n:07d}"]["label"] for n in cases} == {n: want for n, (_, want) in cases.items()}
    assert labels["CAND_0000001"]["honeypot_score"] >= 0.4 and labels["CAND_0000002"]["hybrid_score"] == 0.9877
    # Without a similarity the top label cannot be reached.
    plain = by_id(scoring.pseudo_labels(frame31))
    assert plain["CAND_0000002"]["label"] == 2


def test_no_years_and_production_skills_give_one(spark):
    record = person(1, skills=[skill(n) for n in ("Docker", "Kubernetes", "Python")], profile__current_title="Engineer")
    del record["profile"]["years_of_experience"]
    frame31 = featured(spark, record).withColumn("hybrid_score", F.lit(0.95))
    assert scoring.pseudo_labels(frame31).first()["label"] == 1


def test_top_skills_order(spark):
    skills = [skill("a", "expert", endorsements=1), skill("b", "advanced", endorsements=9), skill("c", "expert", endorsements=5),
              skill("d", "odd", endorsements=99), skill("e", "expert", endorsements=1), skill("f", "beginner"), skill("g", None)]
    assert frame(spark, [person(skills=skills)]).select(scoring.top_skills(F.col("skills"))).first()[0] == ["c", "a", "e", "b", "f"]


def test_explanations(spark):
    df = spark.createDataFrame(
        [("C1", 0.625, 0.5, 1.0, 0.5, None, 0.5, 0.1)],
        "candidate_id string, skill_score double, semantic_score double, experience_score double, signal_score double, "
        "education_score double, engagement_score double, penalty double",
    )
    row = df.select(
        scoring.top_factors().alias("factors"), scoring.candidate_importance().alias("items"),
        F.round(scoring.penalised_score(), 6).alias("score"),
    ).first()
    assert row["factors"] == ["Experience (0.20)", "Semantic Match (0.15)", "Production Experience (0.12)"]
    assert [(i["feature"], i["importance"], i["direction"]) for i in row["items"]][:4] == [
        ("Experience", 0.2, "positive"), ("Semantic Match", 0.15, "positive"), ("Production Experience", 0.125, "positive"),
        ("Penalty", 0.1, "negative"),
    ]
    assert row["score"] == pytest.approx((0.125 + 0.15 + 0.2 + 0.075 + 0.025) * 0.9)
    assert scoring.global_importance(df).first()["feature"] == "Experience"
    assert scoring.global_importance(df.where("false")).count() == 0


def test_reason_text(spark):
    df = spark.createDataFrame(
        [("ML Engineer", 6.4, 4, 0.88, True, ["Long notice period: 150 days and something more than forty"]),
         ("HR Manager", 6.1, 9, 0.76, False, [])],
        "title string, years double, matched int, rate double, open boolean, flags array<string>",
    )
    texts = [r[0] for r in df.select(scoring.reasoning_text(*[F.col(c) for c in df.columns])).collect()]
    assert texts == [
        "ML Engineer with 6.4 yrs; 4 core skills matched; response rate 0.88; open to work; flags: "
        "Long notice period: 150 days and somethi.",
        "HR Manager with 6.1 yrs; 9 core skills matched; response rate 0.76.",
    ]


def results(spark, rows):
    return spark.createDataFrame(rows, "candidate_id string, score double, reasoning string, input_pos int")


def test_duplicates_and_ranks(spark):
    df = results(spark, [("C2", 8.0, "b", 0), ("C1", 9.0, "first", 1), ("C1", 9.0, "second", 2), ("C3", 7.0, None, 3)])
    rows = ranking.ranking_rows(df).orderBy("rank").collect()
    assert [(r["candidate_id"], r["rank"], r["reasoning"]) for r in rows] == [
        ("C1", 1, "first"), ("C2", 2, "b"), ("C3", 3, "Strong semantic match."),
    ]
    many = spark.range(150).select(
        F.format_string("CAND_%07d", "id").alias("candidate_id"), (F.col("id") % 5).cast("double").alias("score"),
        F.lit("r").alias("reasoning"), F.col("id").alias("input_pos"),
    )
    top = ranking.ranking_rows(many).collect()
    assert len(top) == 100 and sorted(r["rank"] for r in top) == list(range(1, 101))
    assert top[0]["candidate_id"] == "CAND_0000004"


def test_rows_with_other_numbers_of_cells(spark, tmp_path):
    lines = ["candidate_id,rank,score,reasoning", 'CAND_0000001,1,0.9,"a, ""b"""', "CAND_0000002,2,0.8", "CAND_0000003,3,0.7,x,y,", 'CAND_0000004,4,0.6,"one, two",more']
    (tmp_path / "odd.csv").write_text("\n".join(lines) + "\n")
    rows, header = files.read_ranking(spark, str(tmp_path / "odd.csv"))
    assert header.count() == 0 and {r.row_num: r.columns for r in rows.collect()} == {2: 4, 3: 3, 4: 6, 5: 5}
    found = {(r.rule, r.row_num): r.message for r in ranking.validate_ranking(rows, 4).collect()}
    assert found["column_count", 4] == "Row 4: expected 4 columns (candidate_id,rank,score,reasoning), got 6."
    assert {rule for rule, _ in found} == {"column_count", "rank_missing"} and ("column_count", 5) in found
    (tmp_path / "wide.csv").write_text("candidate_id,rank,score,reasoning,extra\nCAND_0000001,1,0.9,a\n")
    _, header = files.read_ranking(spark, str(tmp_path / "wide.csv"))
    assert header.first().message.endswith("found: candidate_id,rank,score,reasoning,extra")


def test_ranked_file_round_trip(spark, tmp_path):
    good = spark.range(120).select(
        F.format_string("CAND_%07d", "id").alias("candidate_id"), (1 - F.col("id") / 1000).alias("score"),
        F.lit('says "hi", twice').alias("reasoning"), F.col("id").alias("input_pos"),
    )
    assert files.write_ranking(good, str(tmp_path / "good")).count() == 0
    text = next((tmp_path / "good").glob("*.csv")).read_text().splitlines()
    assert text[0] == "candidate_id,rank,score,reasoning"
    assert text[1] == 'CAND_0000000,1,1.0000,"says ""hi"", twice"' and len(text) == 101
    short = files.write_ranking(good.limit(99), str(tmp_path / "short"))
    assert sorted(r["rule"] for r in short.collect()) == ["rank_missing", "row_count"]


def test_every_output_rule(spark, tmp_path):
    def row(i, cid=None, rank=None, score=None):
        return f"{cid if cid is not None else f'CAND_{i:07d}'},{rank or i},{score or f'{1 - i / 1000:.4f}'},why"

    def rules(name, rows, header="candidate_id,rank,score,reasoning"):
        (tmp_path / name).write_text("\n".join([header, *rows, "", " , , , "]) + "\n")
        cells, head = files.read_ranking(spark, str(tmp_path / name))
        found = ranking.validate_ranking(cells).select("rule", "row_num", "message").collect()
        return {(r["rule"], r["row_num"]) for r in found}, head.count(), {r["message"] for r in found}

    whole = [row(i) for i in range(1, 101)]
    assert rules("ok.csv", whole)[:2] == (set(), 0)
    assert rules("header.csv", whole, "id,rank,score,reasoning")[1] == 1
    found, _, messages = rules("bad.csv", [
        row(1, "CAND_12"), row(2), row(3, "CAND_0000002"), row(4, ""), row(5, rank="05"), row(6, rank="106"), row(7, rank="2"),
        row(8, score="x"), row(9, score="2.0"), *[row(i) for i in range(10, 20)],
        row(20, "CAND_0000099", score="0.5"), row(21, "CAND_0000098", score="0.5"), *[row(i, score="0.4") for i in range(22, 98)],
        *[row(i, score="0.4") for i in (100,)],
    ])
    assert {("id_pattern", 2), ("id_duplicate", 4), ("id_required", 5), ("rank_integer", 6), ("rank_range", 7),
            ("rank_duplicate", 8), ("score_number", 9), ("row_count", None), ("rank_missing", None),
            ("tie_break", 21)} <= found
    assert any(m.startswith("score must be non-increasing by rank: rank 4") or "rank 9" in m for m in messages)
    assert "Each rank 1–100 must appear exactly once; missing: [5, 6, 7, 98, 99]" in messages
    assert "Row 6: rank must be an integer (1–100)." in messages


def test_neighbours_are_compared_across_buckets(spark):
    rows = spark.range(1, 101).select(
        F.lit("l").alias("list_id"), (F.col("id") + 1).cast("int").alias("row_num"),
        F.format_string("CAND_%07d", "id").alias("candidate_id"), F.col("id").cast("string").alias("rank"),
        F.when(F.col("id") == 10, "0.99").otherwise(F.format_string("%.3f", 0.9 - F.col("id") / 1000)).alias("score"),
    )
    for bucket in (10, 3, 1000):
        found = ranking.validate_ranking(rows, bucket=bucket).collect()
        assert [(r["rule"], r["row_num"]) for r in found] == [("score_order", 10)]


def pool(spark):
    records = [
        person(1, profile__current_title="Engineer", skills=[skill("Python", duration=60)]),
        person(2, profile__current_title="Marketing Manager", profile__years_of_experience=3.0,
               skills=[skill("PyTorch", "advanced", 36)], career_history=[job(36)]),
        person(3, profile__current_title="Engineer", skills=[skill("Docker", duration=60)], profile__summary="a startup"),
    ]
    people = frame(spark, records)
    texts = spark.createDataFrame(
        [("CAND_0000001", "python engineer"), ("CAND_0000002", "python marketing"), ("CAND_0000003", "docker engineer")],
        "candidate_id string, embedding_text string")
    vectors = spark.createDataFrame(
        [("CAND_0000001", [1.0, 0.0]), ("CAND_0000002", [0.9, 0.1]), ("CAND_0000003", [0.0, 1.0]), ("CAND_0000009", [1.0, 0.0])],
        "candidate_id string, embedding array<float>")
    return people, texts, vectors


def test_whole_ranking_drops_fraud_and_unknown_ids(spark):
    people, texts, vectors = pool(spark)
    query = F.array(F.lit(1.0), F.lit(0.0))
    for stage in (False, True):
        settings = pipeline.Settings(as_of_year=2026, stage_text_scores=stage)
        rows = pipeline.rank_candidates(people, texts, vectors, "python", query, role(), settings).collect()
        assert [(r["candidate_id"], r["rank"]) for r in rows] == [("CAND_0000001", 1), ("CAND_0000003", 2)]
        assert rows[0]["feature_breakdown"]["python_score"] == 1.0
        assert rows[0]["feature_breakdown"]["bm25_score"] == 1.0
        assert len(rows[0]["feature_breakdown"]) == 31
    assert pipeline.rank_candidates(people.where("false"), texts, vectors, "python", query, role(), SETTINGS).count() == 0


def test_component_ranking(spark):
    people, _, _ = pool(spark)
    parts = pipeline.components(feat.with_features_31(people, role())).withColumn(
        "matched", scoring.matched_skills(F.col("skill_overlap_score"), F.lit(2)))
    rows = pipeline.rank_with_components(parts, n=2).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["score"] >= rows[1]["score"]
    assert "core skills matched" in rows[0]["reasoning"] and len(rows[0]["factors"]) == 3
    assert rows[0]["breakdown"]["total_score"] == rows[0]["score"]
