"""Shared parts of the comparison SQL: the derived profiles as flat relations.

``people``, ``job``, ``sk``, ``edu``, ``cert`` and ``lang`` are computed from the given tables
alone, row by row, without any nested value. Only vocabularies are shared with the package.
"""

from __future__ import annotations

from shortlist import vocab
from shortlist.plans import derived


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"list_extract({lst(values)}, ({index}) % {len(values)} + 1)"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def contains_any(column: str, values) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(v)})" for v in values) + ")"


def rows(values: list[tuple], columns: str) -> str:
    """A VALUES list as a named relation."""
    def lit(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in values)
    name, _, cols = columns.partition("(")
    return f"{name.strip()}({cols} AS (VALUES {body})"


def exact(expr: str, digits: int) -> str:
    """Rounding of the stored binary value, as printing does it."""
    return f"printf('%.{digits}f', ({expr})::DOUBLE)::DOUBLE"


CID = "'CAND_' || lpad({k}::VARCHAR, greatest(7, length({k}::VARCHAR))::INTEGER, '0')"

BASE = f"""
ev AS (
  SELECT user_id % 150 AS slot, count(*) FILTER (WHERE event_type = 'view') AS views,
    count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
    count(*) FILTER (WHERE event_type = 'error') AS errors, max(ts) AS last_seen
  FROM events GROUP BY 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
job AS (
  SELECT o_custkey AS k, {CID.format(k='o_custkey')} AS cid, rn - 1 AS pos,
    CASE WHEN o_orderkey % 97 = 0 THEN 'Amazon Retail' ELSE 'ORG' || (o_orderkey % 5) END AS company,
    CASE WHEN o_custkey % 4 = 0 THEN {pick(['Marketing Manager', 'Sales Lead'], 'o_orderkey')}
      ELSE {pick(derived.TITLES, 'o_orderkey')} END AS title,
    strftime(o_orderdate, '%Y-%m-%d') AS start_date,
    CASE WHEN o_orderkey % 10 <> 0
      THEN strftime(o_orderdate::DATE + ((o_orderkey % 900) - 30)::INTEGER, '%Y-%m-%d') END AS end_date,
    (o_orderkey % 25)::INTEGER AS duration_months, o_orderkey % 10 = 0 AS is_current,
    {pick(['Finance', 'Retail', 'Energy'], 'o_orderkey')} AS industry,
    {pick(vocab.COMPANY_SIZES, 'o_orderkey')} AS company_size,
    'Handled ' || o_orderpriority || ' work' AS description
  FROM numbered),
bought AS (
  SELECT o_custkey, l_partkey, l_quantity,
    CASE WHEN l_partkey % 240 < 120 THEN {pick(derived.SKILLS, 'l_partkey')}
      ELSE 'skill_' || (l_partkey % 2000) END AS name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sk0 AS (SELECT o_custkey, name, min(l_partkey) AS pk, max(l_quantity) AS quantity FROM bought GROUP BY 1, 2),
sk AS (
  SELECT s.o_custkey AS k, {CID.format(k='s.o_custkey')} AS cid,
    row_number() OVER (PARTITION BY s.o_custkey ORDER BY pk, name) - 1 AS pos, name, lower(name) AS lname,
    {pick(vocab.PROFICIENCIES, 'pk')} AS proficiency, quantity::INTEGER AS endorsements,
    ((pk * 13) % 140)::INTEGER AS duration_months,
    CASE WHEN pk % 7 = 0 THEN (pk % 101)::DOUBLE END AS score
  FROM sk0 s SEMI JOIN job j ON s.o_custkey = j.k),
keys AS (SELECT c_custkey AS k FROM customer SEMI JOIN job ON c_custkey = job.k),
edu AS (
  SELECT k, {CID.format(k='k')} AS cid, i AS pos, 'Institute ' || (k % 30) AS institution, 'BSc' AS degree,
    'Science' AS field_of_study, (2000 + (k + i) % 20)::INTEGER AS start_year,
    (2000 + (k + i) % 20 + k % 6 - 1 + i)::INTEGER AS end_year,
    CASE WHEN k % 4 <> 0 THEN 'A' END AS grade, {pick(vocab.EDUCATION_TIERS, 'k + i')} AS tier
  FROM keys, (VALUES (0), (1)) t(i) WHERE i < k % 3),
cert AS (
  SELECT k, {CID.format(k='k')} AS cid, i AS pos, 'Cert ' || ((k + i * 5) % 12) AS cert_name,
    'Issuer ' || ((k + i * 5) % 4) AS issuer, (2010 + (k + i * 5) % 12)::INTEGER AS year
  FROM keys, (VALUES (0), (1)) t(i) WHERE i < k % 3),
lang AS (
  SELECT k, {CID.format(k='k')} AS cid, i AS pos, {pick(derived.LANGUAGES, 'k + i')} AS language,
    {pick(vocab.LANGUAGE_LEVELS, 'k + i')} AS proficiency
  FROM keys, (VALUES (0), (1)) t(i) WHERE i < k % 2 + 1),
assessed AS (SELECT k, avg(score) AS mean_score, count(score) AS scored FROM sk GROUP BY k),
people AS (
  SELECT c.c_custkey AS k, {CID.format(k='c.c_custkey')} AS cid, c.c_mktsegment || ' ' || c.c_name AS name,
    {pick(derived.TITLES, 'c.c_custkey')} AS title, 'ORG' || (c.c_custkey % 50) AS company,
    {pick(derived.TITLES, 'c.c_custkey')} || ' at ORG' || (c.c_custkey % 50) AS headline,
    coalesce(d.text, '') || {pick(derived.SUMMARY_ENDINGS, 'c.c_custkey')} AS summary,
    n.n_name || ' City' AS location, CASE WHEN c.c_custkey % 3 = 0 THEN 'India' ELSE n.n_name END AS country,
    ((c.c_custkey * 7) % 150) / 10.0 AS years, {pick(vocab.COMPANY_SIZES, 'c.c_custkey')} AS company_size,
    c.c_mktsegment AS industry, ((c.c_custkey * 11) % 101)::DOUBLE AS completeness,
    strftime(DATE '2020-01-01' + (c.c_custkey % 1000)::INTEGER, '%Y-%m-%d') AS signup_date,
    coalesce(strftime(ev.last_seen, '%Y-%m-%d'), '2024-01-01') AS last_active_date,
    c.c_custkey % 3 <> 0 AS open_to_work, ((coalesce(ev.views, 0) * 97) % 1500)::INTEGER AS views,
    coalesce(ev.clicks, 0)::INTEGER AS applications,
    CASE WHEN c.c_custkey % 9 = 0 THEN 1.0
      WHEN coalesce(ev.purchases, 0) + coalesce(ev.errors, 0) = 0 THEN 0.0
      ELSE round(ev.purchases / (ev.purchases + ev.errors)::DOUBLE, 2) END AS response_rate,
    (c.c_custkey % 72) / 2.0 AS response_hours, (c.c_custkey % 500)::INTEGER AS connections,
    ((c.c_custkey * 3) % 200)::INTEGER AS endorsements_received, ((c.c_custkey * 17) % 181)::INTEGER AS notice,
    (c.c_custkey % 40 + 5)::DOUBLE AS salary_min, (c.c_custkey % 40 + 5 + c.c_custkey % 15)::DOUBLE AS salary_max,
    {pick(vocab.WORK_MODES, 'c.c_custkey')} AS work_mode, c.c_custkey % 2 = 0 AS relocate,
    CASE WHEN c.c_custkey % 8 = 0 THEN -1.0 ELSE ((c.c_custkey * 7) % 101)::DOUBLE END AS github,
    (c.c_custkey % 300)::INTEGER AS appearances, (c.c_custkey % 40)::INTEGER AS saved,
    (c.c_custkey % 101) / 100.0 AS interview_rate,
    CASE WHEN c.c_custkey % 6 = 0 THEN -1.0 ELSE (c.c_custkey % 11) / 10.0 END AS offer_rate,
    c.c_custkey % 5 <> 0 AS verified_email, c.c_custkey % 7 <> 0 AS verified_phone,
    c.c_custkey % 2 = 1 AS linkedin
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN ev ON c.c_custkey % 150 = ev.slot LEFT JOIN documents d ON d.doc_id = c.c_custkey
  WHERE c.c_custkey IN (SELECT k FROM job)),
career AS (SELECT k, count(*) AS jobs, sum(duration_months)::DOUBLE AS months FROM job GROUP BY k),
skillset AS (SELECT k, count(*) AS n, list(lname) AS names FROM sk GROUP BY k),
full_text AS (
  SELECT p.k, p.cid, substr(concat_ws(' ', p.headline, nullif(substr(p.summary, 1, 500), ''), p.title, p.industry,
      s.listed, j.described), 1, 2000) AS text
  FROM people p
    LEFT JOIN (SELECT k, string_agg(name, ' ' ORDER BY pos) AS listed FROM sk WHERE pos < 20 GROUP BY k) s USING (k)
    LEFT JOIN (SELECT k, string_agg(description, ' ' ORDER BY pos) AS described FROM job WHERE pos < 2 GROUP BY k) j
      USING (k)),
"""

WORD = r"[\p{L}\p{N}_]+"


def tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


def with_base(tail: str, *ctes: str) -> str:
    """``tail`` over the base relations and further ones."""
    extra = ",\n".join(c.strip().rstrip(",") for c in ctes)
    return "WITH " + BASE.strip().rstrip(",") + (",\n" + extra if extra else "") + "\n" + tail
