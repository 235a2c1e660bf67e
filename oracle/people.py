"""Comparison SQL for ingest, tables, search and statistics."""

from __future__ import annotations

from oracle.base import CID, q, with_base
from shortlist.plans import derived
from shortlist.plans.quality_inputs import LIST_SIZE

BROKEN = derived.BROKEN_EVERY
SQL: dict[str, str] = {}

VALID = f"(k % {BROKEN} NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 9))"

SQL["ingest_jsonl"] = with_base(f"""
SELECT p.cid AS candidate_id, p.headline, length(p.summary) AS summary_length, round(p.years::DOUBLE, 6) AS years,
  coalesce(s.n, 0) AS skill_count, c.jobs AS job_count, p.k % 3 AS school_count, p.k % 3 AS cert_count,
  p.k % 2 + 1 AS language_count, p.last_active_date, round(p.response_rate::DOUBLE, 6) AS response_rate
FROM people p LEFT JOIN skillset s USING (k) JOIN career c USING (k) WHERE {VALID}""")

SQL["validate_records"] = with_base(f"""
SELECT p.k * 2 AS line_id, CASE WHEN {VALID} THEN 'valid' ELSE 'skipped' END AS status,
  CASE p.k % {BROKEN} WHEN 5 THEN coalesce(s.n, 0) WHEN 7 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1
    WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 1 WHEN 9 THEN 1 ELSE 0 END AS violation_count,
  CASE p.k % {BROKEN} WHEN 0 THEN 'candidate_id:pattern' WHEN 1 THEN 'profile.years_of_experience:range'
    WHEN 2 THEN 'career_history:length' WHEN 3 THEN 'signals.preferred_work_mode:enum'
    WHEN 4 THEN 'signals.recruiter_response_rate:range' WHEN 5 THEN 'skills[0].endorsements:range'
    WHEN 6 THEN 'profile:required' WHEN 7 THEN 'JSON parse error' WHEN 9 THEN 'signals.connection_count:required'
    ELSE '' END AS first_violation
FROM people p LEFT JOIN skillset s USING (k)""")

SQL["convert_records"] = with_base(f"""
SELECT p.k * 2 AS line_id, CASE WHEN {VALID} OR p.k % {BROKEN} = 9 THEN 'valid' ELSE 'skipped' END AS status,
  CASE p.k % {BROKEN} WHEN 5 THEN coalesce(s.n, 0) WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1
    WHEN 6 THEN 1 ELSE 0 END AS violation_count,
  CASE WHEN p.k % {BROKEN} <> 7 THEN p.connections END AS connections,
  round(CASE p.k % {BROKEN} WHEN 7 THEN NULL WHEN 4 THEN 1.2 ELSE p.response_rate END::DOUBLE, 6) AS response_rate
FROM people p LEFT JOIN skillset s USING (k)""")

SQL["line_numbers"] = "SELECT doc_id, true AS same FROM documents"

SQL["quarantine_log"] = with_base(f"""
SELECT p.k * 2 AS line_id, CASE p.k % {BROKEN} WHEN 7 THEN 'JSON parse error'
  WHEN 5 THEN 'Validation error: ' || s.n || ' errors' ELSE 'Validation error: 1 errors' END AS reason
FROM people p LEFT JOIN skillset s USING (k) WHERE NOT {VALID}""")

SQL["load_stats"] = with_base(f"""
SELECT count(*) + count(*) FILTER (WHERE k % {BROKEN} = 8) AS total_lines, count(*) FILTER (WHERE {VALID}) AS valid_records,
  count(*) FILTER (WHERE NOT {VALID}) AS skipped_records,
  printf('%.4f', count(*) FILTER (WHERE {VALID}) / (count(*) + count(*) FILTER (WHERE k % {BROKEN} = 8))::DOUBLE)::DOUBLE AS success_rate
FROM people""")

SQL["stream_ingest"] = with_base(" UNION ALL ".join(
    f"SELECT {q(name)} AS name, count(*) AS n FROM {relation} WHERE {condition}"
    for name, relation, condition in (
        ("profiles", "people", VALID), ("skills", "sk", VALID), ("education", "edu", VALID),
        ("career_history", "job", VALID), ("certifications", "cert", VALID), ("languages", "lang", VALID),
        ("quarantine", "people", f"NOT {VALID}"),
    )
))

_COLUMNS = {
    "benchmark": "item_id,text",
    "conversations": "conv_id,turn,role,text",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "events": "event_id,ts,user_id,event_type,value,props",
    "labels": "doc_id,quality,toxic",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
    "l_returnflag,l_linestatus,l_shipdate",
    "nation": "n_nationkey,n_name,n_regionkey",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "pages": "page_id,url,html",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "region": "r_regionkey,r_name",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
}
SQL["table_catalog"] = " UNION ALL ".join(
    f"SELECT {q(name)} AS name, count(*) AS row_count, {columns.count(',') + 1} AS column_count, {q(columns)} AS columns "
    f"FROM {name}"
    for name, columns in _COLUMNS.items()
)

_LIST = f"""
src AS (SELECT c_custkey AS k, c_custkey // {LIST_SIZE} AS no, c_custkey % {LIST_SIZE} + 1 AS place FROM customer),
cells AS (
  SELECT 'list_' || no AS list_id, (place + 1)::INTEGER AS row_num,
    CASE WHEN k % 37 = 0 THEN 'BAD_' || k WHEN k % 53 = 0 THEN 'CAND_0000001' WHEN k % 59 = 0 THEN ''
      ELSE {CID.format(k='(CASE WHEN no % 2 = 0 THEN no * 60 + 59 - k % 60 ELSE k END)::BIGINT')} END AS cid,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 47 = 0 AND place > 1 THEN place - 1
      WHEN k % 61 = 0 THEN place + {LIST_SIZE} ELSE place END AS rank,
    CASE WHEN k % 43 = 0 THEN NULL ELSE (100 - place + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END
      + CASE WHEN k % 31 = 0 THEN 50 ELSE 0 END) / 100.0 END AS score
  FROM src),
seq AS (
  SELECT *, lead(rank) OVER w AS rank2, lead(score) OVER w AS score2, lead(cid) OVER w AS cid2
  FROM cells WHERE rank IS NOT NULL AND score IS NOT NULL AND cid <> ''
  WINDOW w AS (PARTITION BY list_id ORDER BY rank, row_num)),
idrep AS (
  SELECT *, row_number() OVER (PARTITION BY list_id, cid ORDER BY row_num) AS nth FROM cells
  WHERE regexp_full_match(cid, 'CAND_[0-9]{{7,}}')),
rankrep AS (
  SELECT *, row_number() OVER (PARTITION BY list_id, rank ORDER BY row_num) AS nth FROM cells
  WHERE rank BETWEEN 1 AND {LIST_SIZE}),
lists AS (SELECT list_id, count(*) AS c FROM cells GROUP BY 1),
gaps AS (
  SELECT l.list_id, string_agg(r::VARCHAR, ', ' ORDER BY r) AS missing
  FROM lists l, range(1, {LIST_SIZE + 1}) t(r)
  WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.list_id = l.list_id AND c.rank = r) GROUP BY 1)
"""
SQL["validate_ranking"] = "WITH " + _LIST.strip() + f"""
SELECT list_id, 'id_required' AS rule, row_num, 'Row ' || row_num || ': candidate_id is required.' AS message
  FROM cells WHERE cid = ''
UNION ALL SELECT list_id, 'id_pattern', row_num, 'Row ' || row_num || ': candidate_id must be CAND_XXXXXXX (7 digits).'
  FROM cells WHERE cid <> '' AND NOT regexp_full_match(cid, 'CAND_[0-9]{{7,}}')
UNION ALL SELECT list_id, 'rank_integer', row_num, 'Row ' || row_num || ': rank must be an integer (1–{LIST_SIZE}).'
  FROM cells WHERE rank IS NULL
UNION ALL SELECT list_id, 'rank_range', row_num, 'Row ' || row_num || ': rank must be between 1 and {LIST_SIZE}.'
  FROM cells WHERE rank NOT BETWEEN 1 AND {LIST_SIZE}
UNION ALL SELECT list_id, 'score_number', row_num, 'Row ' || row_num || ': score must be a float.'
  FROM cells WHERE score IS NULL
UNION ALL SELECT list_id, 'id_duplicate', row_num, 'Row ' || row_num || ': duplicate candidate_id ''' || cid || '''.'
  FROM idrep WHERE nth > 1
UNION ALL SELECT list_id, 'rank_duplicate', row_num, 'Row ' || row_num || ': duplicate rank ' || rank || '.'
  FROM rankrep WHERE nth > 1
UNION ALL SELECT list_id, 'row_count', 0, 'there must be exactly {LIST_SIZE} data rows; found ' || c || '.'
  FROM lists WHERE c <> {LIST_SIZE}
UNION ALL SELECT list_id, 'rank_missing', 0, 'Each rank 1–{LIST_SIZE} must appear exactly once; missing: [' || missing || ']'
  FROM gaps
UNION ALL SELECT list_id, 'score_order', row_num,
    'score must be non-increasing by rank: rank ' || rank || ' < rank ' || rank2 || '.' FROM seq WHERE score < score2
UNION ALL SELECT list_id, 'tie_break', row_num,
    'Equal scores at ranks ' || rank || ' and ' || rank2 || ': tie-break requires candidate_id ascending.'
  FROM seq WHERE score = score2 AND cid > cid2"""

SQL["weights_check"] = """
WITH w AS (
  SELECT p_partkey AS k, (p_partkey % 50)::DOUBLE AS a, CASE WHEN p_partkey % 11 = 0 THEN 120.0 ELSE 20.0 END AS b,
    50.0 - p_partkey % 50 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_partkey % 7 END AS c FROM part),
t AS (SELECT k, a + b + c + 30.0 AS total, a BETWEEN 0 AND 100 AND b BETWEEN 0 AND 100 AND c BETWEEN 0 AND 100 AS fits FROM w)
SELECT k AS weights_id, round(total::DOUBLE, 6) AS total,
  CASE WHEN NOT fits THEN 'range' WHEN abs(total - 100) > 1e-3 THEN 'sum' ELSE '' END AS problem,
  fits AND abs(total - 100) <= 1e-3 AS ok FROM t"""

SQL["embedding_audit"] = with_base(f"""
SELECT (SELECT count(*) FROM people) AS candidates, (SELECT count(*) FROM embeddings) AS stored,
  (SELECT count(*) FROM people WHERE k NOT IN (SELECT vec_id FROM embeddings)) AS pending,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT k FROM people)) AS orphaned,
  0 AS duplicated, false AS reset""")

# --- normalised tables ------------------------------------------------------------------------

SQL["norm_profiles"] = with_base("""
SELECT p.cid AS candidate_id, p.name AS anonymized_name, p.headline, p.location, p.country,
  round(p.years::DOUBLE, 6) AS years_of_experience, p.title AS current_title, p.company AS current_company,
  p.company_size AS current_company_size, p.industry AS current_industry, (p.k % 3)::INTEGER AS cert_count,
  coalesce(s.n, 0)::INTEGER AS skill_count, p.completeness AS profile_completeness_score, p.signup_date,
  p.last_active_date, p.open_to_work AS open_to_work_flag, p.views AS profile_views_received_30d,
  p.applications AS applications_submitted_30d, round(p.response_rate::DOUBLE, 6) AS recruiter_response_rate,
  p.response_hours::DOUBLE AS avg_response_time_hours, p.connections AS connection_count, p.endorsements_received,
  p.notice AS notice_period_days, p.salary_min AS salary_min_lpa, p.salary_max AS salary_max_lpa,
  p.work_mode AS preferred_work_mode, p.relocate AS willing_to_relocate, p.github::DOUBLE AS github_activity_score,
  p.appearances AS search_appearance_30d, p.saved AS saved_by_recruiters_30d,
  round(p.interview_rate::DOUBLE, 6) AS interview_completion_rate, round(p.offer_rate::DOUBLE, 6) AS offer_acceptance_rate,
  p.verified_email, p.verified_phone, p.linkedin AS linkedin_connected,
  round(coalesce(a.mean_score, -1.0), 6) AS avg_assessment_score
FROM people p LEFT JOIN skillset s USING (k) LEFT JOIN assessed a USING (k)""")

SQL["norm_skills"] = with_base("""
SELECT cid AS candidate_id, name AS skill_name, proficiency, endorsements, duration_months,
  coalesce(score, -1.0) AS assessment_score FROM sk""")
SQL["norm_education"] = with_base("""
SELECT cid AS candidate_id, institution, degree, field_of_study, start_year, end_year, coalesce(grade, '') AS grade, tier
FROM edu""")
SQL["norm_career"] = with_base("""
SELECT cid AS candidate_id, company, title, start_date, coalesce(end_date, '') AS end_date, duration_months, is_current,
  industry, company_size, description, pos::INTEGER AS job_order FROM job""")
SQL["norm_certifications"] = with_base("SELECT cid AS candidate_id, cert_name, issuer, year FROM cert")
SQL["norm_languages"] = with_base("SELECT cid AS candidate_id, language, proficiency FROM lang")
SQL["retrieval_text"] = with_base("SELECT cid AS candidate_id, text FROM full_text")

# --- search ---------------------------------------------------------------------------------

SQL["search_candidates"] = with_base("""
SELECT p.cid AS candidate_id, p.name AS anonymized_name, p.headline, p.title AS current_title,
  p.company AS current_company, p.years::DOUBLE AS years_of_experience, p.location, p.country,
  p.open_to_work AS open_to_work_flag, p.completeness AS profile_completeness_score, p.work_mode AS preferred_work_mode,
  coalesce(s.n, 0)::INTEGER AS skill_count
FROM people p LEFT JOIN skillset s USING (k)
WHERE p.open_to_work AND p.years BETWEEN 2 AND 14
  AND (contains(lower(p.title), 'engineer') OR contains(lower(p.headline), 'engineer') OR contains(lower(p.summary), 'engineer'))
  AND p.k IN (SELECT k FROM sk WHERE contains(lname, 'python'))""")
SQL["search_by_skill"] = with_base("""
SELECT cid AS candidate_id, title AS current_title, country FROM people
WHERE k IN (SELECT k FROM sk WHERE contains(lname, 'learning'))""")
SQL["page_rows"] = with_base("""
SELECT cid AS candidate_id, headline, (SELECT count(*) FROM people WHERE work_mode = 'remote') AS total
FROM people WHERE work_mode = 'remote' ORDER BY cid LIMIT 20 OFFSET 40""")
SQL["deep_page"] = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice::DOUBLE, 6) AS price FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 5400"""
SQL["mask_names"] = with_base("""
SELECT cid AS candidate_id,
  list_aggregate(list_transform(string_split(name, ' '), lambda w: w[1] || repeat('*', length(w) - 1)), 'string_agg', ' ') AS masked
FROM people""")
SQL["candidate_detail"] = with_base("""
SELECT p.cid AS candidate_id, p.headline, coalesce(s.x, '') AS skills, coalesce(e.x, '') AS education,
  coalesce(j.x, '') AS career_history, coalesce(c.x, '') AS certifications, coalesce(l.x, '') AS languages
FROM people p
  LEFT JOIN (SELECT k, string_agg(name, '|' ORDER BY name) AS x FROM sk GROUP BY k) s USING (k)
  LEFT JOIN (SELECT k, string_agg(institution, '|' ORDER BY pos) AS x FROM edu GROUP BY k) e USING (k)
  LEFT JOIN (SELECT k, string_agg(company, '|' ORDER BY pos) AS x FROM job GROUP BY k) j USING (k)
  LEFT JOIN (SELECT k, string_agg(cert_name, '|' ORDER BY cert_name) AS x FROM cert GROUP BY k) c USING (k)
  LEFT JOIN (SELECT k, string_agg(language, '|' ORDER BY language) AS x FROM lang GROUP BY k) l USING (k)""")

# --- statistics -------------------------------------------------------------------------------

SQL["dataset_stats"] = with_base("""
SELECT count(*) AS total_candidates, count(*) FILTER (WHERE open_to_work) AS open_to_work,
  round(count(*) FILTER (WHERE open_to_work) * 100.0 / greatest(count(*), 1), 4)::DOUBLE AS open_to_work_pct,
  printf('%.2f', avg(years)::DOUBLE)::DOUBLE AS avg_years_experience, printf('%.2f', avg(completeness)::DOUBLE)::DOUBLE AS avg_profile_completeness,
  count(*) FILTER (WHERE relocate) AS willing_to_relocate, count(*) FILTER (WHERE verified_email) AS verified_email,
  count(*) FILTER (WHERE verified_phone) AS verified_phone, count(*) FILTER (WHERE linkedin) AS linkedin_connected,
  printf('%.1f', avg(notice)::DOUBLE)::DOUBLE AS avg_notice_period_days, printf('%.3f', avg(response_rate)::DOUBLE)::DOUBLE AS avg_recruiter_response_rate,
  printf('%.3f', avg(interview_rate)::DOUBLE)::DOUBLE AS avg_interview_completion_rate FROM people""")
SQL["top_countries"] = with_base(
    "SELECT country, count(*) AS n FROM people GROUP BY 1 ORDER BY n DESC, country LIMIT 10")
SQL["top_skills"] = with_base(
    "SELECT name AS skill_name, count(*) AS n FROM sk GROUP BY 1 ORDER BY n DESC, skill_name LIMIT 20")
SQL["facet_counts"] = with_base(" UNION ALL ".join(
    f"SELECT {q(facet)} AS facet, {column}::VARCHAR AS value, count(*) AS n FROM {relation} WHERE {column}::VARCHAR <> '' GROUP BY 2"
    for facet, column, relation in (
        ("preferred_work_mode", "work_mode", "people"), ("current_title", "title", "people"),
        ("current_industry", "industry", "people"), ("country", "country", "people"),
        ("notice_period_days", "notice", "people"), ("proficiency", "proficiency", "sk"),
    )
))
SQL["experience_bands"] = with_base(" UNION ALL ".join(
    f"SELECT {q(name)} AS band, count(*) FILTER (WHERE years >= {low} AND years < {high}) AS n FROM people"
    for name, low, high in (("0-2", -1, 2), ("2-5", 2, 5), ("5-10", 5, 10), ("10-15", 10, 15), ("15+", 15, 1000))
))
_NESTED = """
SELECT 'skills' AS section, name AS key, count(*) AS n FROM sk GROUP BY 2
UNION ALL SELECT 'certifications', cert_name, count(*) FROM cert GROUP BY 2
UNION ALL SELECT 'company_sizes', company_size, count(*) FROM job GROUP BY 2"""
SQL["nested_counts"] = with_base(_NESTED)
SQL["active_by_month"] = with_base(
    "SELECT substr(last_active_date, 1, 7) AS month, count(*) AS n FROM people GROUP BY 1")
SQL["histogram20"] = with_base(
    """SELECT metric, least(floor((v - lo) * 20 / (hi - lo)), 19)::INTEGER AS bin, count(*) AS n
FROM (SELECT *, min(v) OVER (PARTITION BY metric) AS lo, max(v) OVER (PARTITION BY metric) AS hi FROM long)
GROUP BY 1, 2""",
    "long AS (" + " UNION ALL ".join(
        f"SELECT {q(m)} AS metric, {c}::DOUBLE AS v FROM people"
        for m, c in (
            ("years_of_experience", "years"), ("github_activity_score", "github"),
            ("recruiter_response_rate", "response_rate"), ("interview_completion_rate", "interview_rate"),
            ("saved_by_recruiters_30d", "saved"),
        )
    ) + ")",
)


def _sections(parts: list[tuple[str, str, str, int | None]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT {q(section)} AS section, {column}::VARCHAR AS key, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) AS rank FROM {relation} GROUP BY {column}){f" WHERE rank <= {size}" if size else ""}"""
        for section, column, relation, size in parts
    )


SQL["dataset_report"] = with_base(_sections([
    ("top_100_skills", "name", "sk", 100), ("top_titles", "title", "people", 20),
    ("top_industries", "industry", "people", 20), ("top_countries", "country", "people", 20),
    ("top_certifications", "cert_name", "cert", 20), ("company_sizes", "company_size", "job", None),
    ("notice_periods", "notice", "people", None),
]))
SQL["dataset_summary"] = with_base(_sections([
    ("industry", "industry", "people", 5), ("country", "country", "people", 5), ("skill", "name", "sk", 10),
]))

# --- lookups that need no profile -----------------------------------------------------------------

SQL["dedupe_ranked"] = f"""
SELECT candidate_id, score, input_pos FROM (
  SELECT {CID.format(k='o_custkey')} AS candidate_id, floor(o_totalprice / 1000)::BIGINT AS score, o_orderkey AS input_pos,
    row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1"""
SQL["ltr_groups"] = with_base(
    "SELECT cid AS candidate_id, ((row_number() OVER (ORDER BY cid) - 1) // 100)::BIGINT AS group_id FROM people")
SQL["group_kfold"] = """
WITH RECURSIVE sizes AS (
  SELECT o_custkey AS group_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS i FROM orders GROUP BY 1),
dealt AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS group_id, 0::BIGINT AS size, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT i, group_id, size, pick - 1, list_transform(loads, lambda load, pos: load + CASE WHEN pos = pick THEN size ELSE 0 END)
  FROM (SELECT s.i, s.group_id, s.size, loads, list_position(loads, list_min(loads)) AS pick FROM dealt d JOIN sizes s ON s.i = d.i + 1))
SELECT group_id, size, fold::INTEGER AS fold FROM dealt WHERE i > 0"""
