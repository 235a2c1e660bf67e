"""Search, detail, statistics and file output."""

import json

import pytest
from people import frame, person, skill
from pyspark.sql import functions as F

from shortlist.operators import normalise, search, stats
from shortlist.plans.warehouse import warehouse
from shortlist.sources import files, ingest, tables


@pytest.fixture(scope="module")
def flat(spark):
    records = [
        person(1, profile__years_of_experience=1.0, profile__country="india"),
        person(2, profile__years_of_experience=2.0, profile__headline="C++ (lead)", skills=[skill("PyTorch"), skill("Torchvision")]),
        person(3, profile__years_of_experience=15.0, signals__open_to_work_flag=False, profile__country="Peru",
               signals__preferred_work_mode="remote"),
    ]
    return normalise.six_tables(frame(spark, records))


def found(df):
    return sorted(r["candidate_id"][-1] for r in df.collect())


def test_search_filters(flat):
    s = lambda **k: found(search.search_candidates(flat["profiles"], flat["skills"], **k))
    assert s() == ["1", "2", "3"] and s(min_yoe=2.0, max_yoe=15.0) == ["2", "3"]
    assert s(country="INDIA") == ["1", "2"] and s(open_to_work=False) == ["3"] and s(work_mode="remote") == ["3"]
    assert s(skill="torch") == ["2"] and s(q="c++ (LEAD") == ["2"] and s(q="c.. .lead", regex=True) == ["2"]
    assert s(q="backend", skill="java", country="peru") == ["3"]
    with pytest.raises(ValueError):
        search.search_candidates(flat["profiles"], skill="x")
    assert len(search.search_candidates(flat["profiles"]).columns) == 12


def test_filters_reach_the_scan(spark, flat, tmp_path, capsys):
    flat["profiles"].write.parquet(str(tmp_path / "p"))
    df = search.search_candidates(spark.read.parquet(str(tmp_path / "p")), min_yoe=2.0, open_to_work=True)
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(years_of_experience,2.0)" in plan and "embedding_text" not in plan


def test_page_and_total(flat):
    assert found(search.page(flat["profiles"], ["candidate_id"], 1, 1)) == ["2"]
    assert search.page(flat["profiles"], ["candidate_id"], 9, 5).count() == 0
    assert search.total_rows(flat["profiles"]).first()["total"] == 3


def test_detail_of_one_candidate(flat):
    row = search.candidate_detail(flat, "CAND_0000002").first()
    assert [s["skill_name"] for s in row["skills"]] == ["PyTorch", "Torchvision"] and "embedding_text" not in row.asDict()
    assert len(row["career_history"]) == 1 and row["languages"][0]["language"] == "English"
    assert search.candidate_detail(flat, "CAND_9999999").count() == 0


def test_presentation(spark):
    df = spark.createDataFrame([("Ada  Lovelace", 0.9, 0.41), ("X", 0.7, 0.4), ("", 0.1, None)], "n string, s double, p double")
    rows = df.select(search.masked_name(F.col("n")), search.score_tier(F.col("s")), search.fraud_flag(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("A** L*******", "Top Match", True), ("X", "Strong", False), ("", "Moderate", False)]


def test_ranked_pool_search_and_pair(spark):
    df = spark.createDataFrame(
        [("C1", 1, 0.9, "Ann", "Chef", ["Go"], 3.0), ("C2", 2, 0.8, "Bob", "Data lead", ["Java"], 9.0), ("C3", 3, 0.7, "Cy", "Cook", ["BigData"], 1.0)],
        "candidate_id string, rank int, score double, name string, title string, skill_names array<string>, years_of_experience double")
    assert [r["candidate_id"] for r in search.search_ranked(df, "DATA").collect()] == ["C2", "C3"]
    assert [r["candidate_id"] for r in search.search_ranked(df, "", "years_of_experience").collect()] == ["C2", "C1", "C3"]
    pair = {r["attribute"]: (r["a"], r["b"]) for r in search.compare_pair(df, ["name", "title"]).collect()}
    assert pair == {"name": ("Ann", "Bob"), "title": ("Chef", "Data lead")}


def test_bands_and_histogram_edges(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (0, 1.99, 2, 5, 9.9, 10, 15, 20)], "x double, same double")
    assert {r["band"]: r["n"] for r in stats.band_counts(df, "x").collect()} == {"0-2": 2, "2-5": 1, "5-10": 2, "10-15": 1, "15+": 2}
    bins = {(r["metric"], r["bin"]): r["n"] for r in stats.histograms(df, ["x", "same"]).collect()}
    assert bins[("x", 19)] == 1 and bins[("x", 0)] == 1 and bins[("same", 10)] == 8
    assert sum(n for (m, _), n in bins.items() if m == "x") == 8


def test_stats_of_nothing(flat):
    row = stats.dataset_stats(flat["profiles"].where("false")).first()
    assert row["total_candidates"] == 0 and row["open_to_work_pct"] == 0.0
    kpis = stats.pool_kpis(flat["profiles"].where("false").selectExpr("1.0D AS score", "0.5D AS honeypot_probability")).first()
    assert kpis["pool"] == 0 and kpis["mean_score"] == 0.0


def test_unnamed_skills_count_as_unknown(spark):
    people = frame(spark, [person(1, skills=[skill(None), skill("a")], certifications=None)])
    counts = {(r["section"], r["key"]): r["n"] for r in stats.nested_counts(people).collect()}
    assert counts[("skills", "Unknown")] == 1 and counts[("company_sizes", "51-200")] == 1


def test_report_file(spark, small, tmp_path):
    w = warehouse(spark, small)
    files.write_report(stats.dataset_report(w.candidates), w.profiles, str(tmp_path / "report"))
    report = json.loads(next((tmp_path / "report").glob("*.json")).read_text())
    assert report["total_candidates"] == w.profiles.count() and len(report["top_100_skills"]) == 100
    assert sum(report["notice_periods"].values()) == report["total_candidates"]


def test_label_files(spark, tmp_path):
    labels = spark.createDataFrame([("C1", 2, 0.5, 0.1, 0.2, 'a "quoted", reason')],
                                   "candidate_id string, label int, hybrid_score double, contradiction_score double, honeypot_score double, reason string")
    files.write_labels(labels, str(tmp_path / "labels"))
    assert files.read_labels(spark, str(tmp_path / "labels")).collect() == labels.collect()
    (tmp_path / "manual.csv").write_text("who,candidate_id,label\nme,C9,3\nme,C8,x\n")
    assert [tuple(r) for r in files.read_manual_labels(spark, str(tmp_path / "manual.csv")).collect()] == [("C9", 3), ("C8", None)]


def test_features_table_and_sizes(spark, flat, tmp_path):
    tables.write_features(flat["profiles"].select("candidate_id"), str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).count() == 3
    size = stats.table_sizes({"features": str(tmp_path / "features")}, spark).first()
    assert size["size_bytes"] == sum(f.stat().st_size for f in (tmp_path / "features").glob("*.parquet"))
    catalog = {r["name"]: r["row_count"] for r in stats.table_catalog(flat).collect()}
    assert catalog["profiles"] == 3 and catalog["skills"] == 6


def test_descriptions_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Python\nneeded")
    row = files.read_job_descriptions(spark, str(tmp_path)).first()
    assert (row["jd_id"], row["text"]) == ("a.txt", "Python\nneeded")


def test_rules_are_evaluated_once_behind_a_filter(spark, small, capsys):
    """A filter on the status must not copy the parsing below itself."""
    from shortlist.plans import derived

    checked = ingest.parse_lines(derived.raw_lines(warehouse(spark, small).candidates), longest_career=None)
    ingest.valid_candidates(checked).explain("formatted")
    assert capsys.readouterr().out.count("from_json") == 1


def test_keys_above_ten_million_stay_apart(spark):
    from shortlist.plans import derived

    keys = spark.createDataFrame([(7,), (12345678,), (12345679,), (123456789012,)], "k long")
    ids = [r[0] for r in keys.select(derived.candidate_id(F.col("k"))).collect()]
    assert ids == ["CAND_0000007", "CAND_12345678", "CAND_12345679", "CAND_123456789012"]


def test_every_order_is_a_job(spark, small):
    from shortlist.plans import derived

    jobs = derived.candidates(spark, small).select(F.sum(F.size("career_history"))).first()[0]
    assert jobs == spark.read.parquet(f"{small}/orders.parquet").count()
