"""What moves between tasks while profiles are built from the star-schema tables."""

from __future__ import annotations

import datetime

from shortlist.plans import derived


def _tables(spark):
    day = datetime.datetime(2020, 1, 2)
    orders = spark.createDataFrame(
        [(10, 1, day, "1-URGENT"), (97, 1, day, "5-LOW"), (3, 2, day, "5-LOW"), (4, None, day, "5-LOW")],
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
    )
    items = spark.createDataFrame(
        [(10, 7, 3.0), (10, 247, 9.0), (97, 7, 5.0), (3, 130, 1.0), (3, None, 2.0)], "l_orderkey long, l_partkey long, l_quantity double"
    )
    return orders, items


def test_orders_and_line_items_move_as_they_are_stored(spark, capsys):
    orders, items = _tables(spark)
    derived._careers(orders).explain("simple")
    careers = capsys.readouterr().out
    assert careers.count("Exchange") == 1 and "Handled" not in careers
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        derived._skills(orders, items).explain("simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    skills = capsys.readouterr().out
    assert skills.count("Exchange") == 3  # two sides of the join, then its result once


def test_jobs_and_skills_are_worded_after_the_move(spark):
    orders, items = _tables(spark)
    careers = derived._careers(orders).where("c_custkey = 1")
    jobs = careers.select(derived._jobs("ordered", careers["c_custkey"]).alias("jobs")).first()["jobs"]
    assert [(j["company"], j["description"], j["is_current"]) for j in jobs] == [
        ("ORG0", "Handled 1-URGENT work", True), ("Amazon Retail", "Handled 5-LOW work", False)
    ]
    listed = derived._skills(orders, items)
    rows = listed.select("c_custkey", derived._named_skills("listed").alias("s"), derived._skill_scores("listed").alias("scores")).collect()
    found = {r["c_custkey"]: ([(s["name"], s["endorsements"]) for s in r["s"]], r["scores"]) for r in rows}
    # Parts 7 and 247 have different names only where the list of names is not a divisor of 240.
    names = {derived.SKILLS[7]: 5, derived.SKILLS[247 % len(derived.SKILLS)]: 9}
    assert dict(found[1][0]) == names and found[1][1] == {derived.SKILLS[7]: 7.0}
    assert found[2][0] == [(None, 2), ("skill_130", 1)] and found[2][1] == {}
