"""Every registered query against its SQL counterpart on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from oracle.sql import ORACLE
from shortlist.plans.catalog import QUERIES

TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def test_only_model_fits_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"ltr_cv", "lambda_cv"} and set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, small, name, capsys):
    df = QUERIES[name](spark, small)
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if bad in plan]
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["jd_id", "rank", "candidate_id", "score"] and df.count() > 0


def test_scores_stay_in_their_range(spark, small):
    rules = QUERIES["negative_signals"](spark, small).selectExpr("min(penalty)", "max(penalty)").first()
    assert 0.0 <= rules[0] and rules[1] <= 0.35
    for name, column in (("contradictions", "contradiction_score"), ("honeypots", "honeypot_probability")):
        low, high = QUERIES[name](spark, small).selectExpr(f"min({column})", f"max({column})").first()
        assert 0.0 <= low and high <= 1.0
    assert QUERIES["bm25_topk"](spark, small).where("bm25_score <= 0").count() == 0
