"""Comparison SQL for retrieval, rules, features, scoring and training."""

from __future__ import annotations

from oracle.base import contains_any, exact, inlist, lst, q, rows, tokens, with_base
from shortlist import vocab
from shortlist.operators.features import FEATURES_26, FEATURES_31
from shortlist.plans import derived
from shortlist.plans.catalog import AS_OF_YEAR, TEXT_QUERY

SQL: dict[str, str] = {}
ROLE = derived.ROLE
ASKED = [s.lower() for s in ROLE["must_have_skills"]]

# --- retrieval ------------------------------------------------------------------------------


def bm25(corpus: str, id_col: str, text_col: str, query: str) -> str:
    """Relations ``toks``, ``dl``, ``corpus``, ``score`` for one query; documents without a match are absent."""
    return f"""
toks AS (SELECT {id_col} AS id, unnest({tokens(text_col)}) AS term FROM {corpus}),
dl AS (SELECT {id_col} AS id, len({tokens(text_col)}) AS length FROM {corpus}),
corpus AS (SELECT count(*) AS n, avg(length) AS mean_length FROM dl),
terms AS (SELECT DISTINCT unnest({tokens(q(query))}) AS term),
tf AS (SELECT id, term, count(*) AS tf FROM toks SEMI JOIN terms USING (term) GROUP BY 1, 2),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM (
  SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
score AS (
  SELECT id, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 9) AS bm25_score
  FROM tf JOIN idf USING (term) JOIN dl USING (id), corpus GROUP BY 1)"""


def cosine(vectors: str, id_col: str, query: str, clamp: bool = False) -> str:
    """Relation ``cos``: similarity of every vector with the one under ``query``."""
    dot = "list_dot_product(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"
    if clamp:
        dot = f"least(1.0, greatest(0.0, {dot}))"
    return f"cos AS (SELECT {id_col} AS id, round({dot}, 9) AS semantic_score FROM {vectors} v)"


HYBRID = """
spread AS (
  SELECT max(s) AS hi, min(s) AS lo FROM (SELECT coalesce(bm25_score, 0.0) AS s FROM dl LEFT JOIN score USING (id))),
normed AS (
  SELECT id, CASE WHEN hi > lo THEN (coalesce(bm25_score, 0.0) - lo) / (hi - lo) ELSE 0.0 END AS bm25_norm,
    coalesce(semantic_score, 0.0) AS semantic_score
  FROM (SELECT id FROM dl UNION SELECT id FROM cos) LEFT JOIN cos USING (id) LEFT JOIN score USING (id), spread),
hybrid AS (SELECT *, round(0.4 * bm25_norm + 0.6 * semantic_score, 9) AS hybrid_score FROM normed)"""

SQL["tokenize"] = f"""
WITH t AS (SELECT doc_id, {tokens('text')} AS t FROM documents)
SELECT doc_id, len(t)::INTEGER AS tokens, len(list_distinct(t))::INTEGER AS distinct_tokens,
  coalesce(list_min(t), '') AS first_token, coalesce(list_max(t), '') AS last_token FROM t"""
SQL["bm25_topk"] = f"""
WITH {bm25('documents', 'doc_id', 'text', TEXT_QUERY)}
SELECT id AS doc_id, round(bm25_score, 6) AS bm25_score FROM score ORDER BY score.bm25_score DESC, id LIMIT 100"""
SQL["index_topk"] = SQL["bm25_topk"]
SQL["bm25_stats"] = f"""
WITH toks AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM toks GROUP BY 1)
SELECT count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS highest_df,
  count(*) FILTER (WHERE df = 1) AS single_document_terms, (SELECT count(*) FROM documents) AS documents,
  (SELECT round(avg(len({tokens('text')})), 6) FROM documents) AS mean_length FROM df"""
SQL["stream_embed"] = f"""
SELECT doc_id, 64 AS dim, CASE WHEN len({tokens('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents"""
SQL["cosine_topk"] = f"""
WITH {cosine('embeddings', 'vec_id', '7')}
SELECT id AS doc_id, round(semantic_score, 6) AS semantic_score FROM cos ORDER BY cos.semantic_score DESC, id LIMIT 200"""
SQL["hybrid_topk"] = f"""
WITH {bm25('documents', 'doc_id', 'text', TEXT_QUERY)}, {cosine('embeddings', 'vec_id', '7')}, {HYBRID}
SELECT id AS doc_id, round(hybrid_score, 6) AS hybrid_score, round(bm25_norm, 6) AS bm25_norm,
  round(semantic_score, 6) AS semantic_score FROM hybrid ORDER BY hybrid.hybrid_score DESC, id LIMIT 200"""
SQL["hybrid_batch"] = f"""
WITH qs AS (SELECT item_id AS query_id, b.text, e.embedding::DOUBLE[] AS vec FROM benchmark b LEFT JOIN embeddings e ON vec_id = item_id),
toks AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents),
dl AS (SELECT doc_id, len({tokens('text')}) AS length FROM documents),
corpus AS (SELECT count(*) AS n, avg(length) AS mean_length FROM dl),
qt AS (SELECT DISTINCT query_id, unnest({tokens('text')}) AS term FROM qs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks SEMI JOIN qt USING (term) GROUP BY 1, 2),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus),
score AS (
  SELECT query_id, doc_id, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 9) AS s
  FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), corpus GROUP BY 1, 2),
spread AS (
  SELECT query_id, max(coalesce(s, 0.0)) AS hi, min(coalesce(s, 0.0)) AS lo
  FROM (SELECT query_id, doc_id FROM qs, dl) LEFT JOIN score USING (query_id, doc_id) GROUP BY 1),
whole AS (
  SELECT query_id, doc_id, coalesce(s, 0.0) AS s
  FROM (SELECT query_id, doc_id FROM qs, (SELECT doc_id FROM dl UNION SELECT vec_id FROM embeddings)) LEFT JOIN score USING (query_id, doc_id)),
pairs AS (
  SELECT w.query_id, w.doc_id, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0.0 END AS bm25_norm,
    coalesce(round(list_dot_product(e.embedding::DOUBLE[], qs.vec), 9), 0.0) AS semantic_score
  FROM whole w JOIN spread USING (query_id) JOIN qs USING (query_id) LEFT JOIN embeddings e ON e.vec_id = w.doc_id),
ranked AS (
  SELECT *, round(0.4 * bm25_norm + 0.6 * semantic_score, 9) AS h FROM pairs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, doc_id) AS rank FROM ranked)
SELECT query_id, rank, doc_id, round(h, 6) AS hybrid_score, round(bm25_norm, 6) AS bm25_norm,
  round(semantic_score, 6) AS semantic_score FROM numbered WHERE rank <= 10"""

_TITLES = ["data scientist", "backend engineer"]
KEYWORD = "kw AS (" + " UNION ".join(
    ["(SELECT k FROM people WHERE open_to_work ORDER BY k LIMIT 200)"]
    + [f"(SELECT DISTINCT k FROM sk WHERE contains(lname, {q(s)}) ORDER BY k LIMIT 100)" for s in ASKED]
    + [
        f"(SELECT k FROM people p WHERE contains(lower(title), {q(t)}) OR EXISTS (SELECT 1 FROM job j WHERE j.k = p.k "
        f"AND contains(lower(j.title), {q(t)})) ORDER BY k LIMIT 80)"
        for t in _TITLES
    ]
) + ")"
SQL["keyword_retrieve"] = with_base("SELECT cid AS candidate_id FROM people JOIN kw USING (k)", KEYWORD)
SQL["union_retrieve"] = with_base(
    """SELECT cid AS candidate_id, round(coalesce(semantic_score, 0.0), 6) AS semantic_score
FROM people LEFT JOIN cos ON cos.id = people.k
WHERE k IN (SELECT k FROM kw UNION (SELECT id FROM cos SEMI JOIN people ON id = k ORDER BY cos.semantic_score DESC, id LIMIT 200))""",
    KEYWORD, cosine("embeddings", "vec_id", "7", clamp=True))
SQL["embed_pending"] = with_base(
    "SELECT cid AS candidate_id, 64 AS dim, 1.0::DOUBLE AS norm FROM people WHERE k NOT IN (SELECT vec_id FROM embeddings)")

# --- rules --------------------------------------------------------------------------------------

_SENIOR = contains_any("t", vocab.SENIOR_TITLE_WORDS)
SHAPE = f"""
shape AS (
  SELECT p.*, lower(p.title) AS t, lower(p.summary) AS s, coalesce(c.jobs, 0) AS jobs, coalesce(c.months, 0.0) AS months,
    coalesce(x.n, 0) AS listed, coalesce(x.names, []) AS names, p.years::DOUBLE AS yoe
  FROM people p LEFT JOIN career c USING (k) LEFT JOIN skillset x USING (k))"""

CONTRA = f"""
hits AS (
  SELECT k, 1 AS o, 'C1' AS code, 0.3 AS w, 'Anomalous skillset: Marketing title with advanced AI framework skills.' AS m
    FROM shape WHERE contains(t, 'marketing') AND k IN (
      SELECT k FROM sk WHERE lname IN {inlist(vocab.AI_SKILLS)} AND proficiency = 'advanced')
  UNION ALL SELECT k, 2, 'C2', 0.4, 'Contradictory career: AI title but previous roles are non-technical.' FROM shape
    WHERE (contains(t, 'ai') OR contains(t, 'machine learning')) AND jobs > 0 AND k NOT IN (
      SELECT k FROM job WHERE {contains_any('lower(title)', vocab.TECHNICAL_TITLE_WORDS)})
  UNION ALL SELECT k, 3, 'C3', 0.3, 'Unrealistic experience claim: Stated ' || yoe || ' YoE but career history adds up to '
      || printf('%.1f', months / 12) || ' YoE.'
    FROM shape WHERE yoe > 0 AND months > 0 AND abs(yoe - months / 12) > 5
  UNION ALL SELECT k, 4 + pos / 10000.0, 'C4', 0.5, 'Unrealistic skill duration: Claimed ' || duration_months ||
      CASE lname WHEN 'langchain' THEN ' months in LangChain (framework is newer than this).' ELSE ' months in ChatGPT.' END
    FROM sk WHERE (lname = 'langchain' AND duration_months > 36) OR (lname = 'chatgpt' AND duration_months > 48)
  UNION ALL SELECT k, 5, 'C5', 0.2,
      'Contradictory summary: Summary implies software engineering while current title is recruiter.'
    FROM shape WHERE contains(s, 'software engineer') AND contains(t, 'recruiter')
  UNION ALL SELECT k, 6, 'C6', 0.3, 'Skill stuffing: Profile lists ' || listed || ' discrete skills, which is abnormally high.'
    FROM shape WHERE listed > 60
  UNION ALL SELECT k, 7, 'C7', 0.3, 'Education anomaly: Start year ' || start_year || ' is after end year ' || end_year || '.'
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS nth FROM edu WHERE start_year > end_year) WHERE nth = 1
  UNION ALL SELECT k, 8, 'C8', 0.3, 'Career anomaly: Job start date ' || start_date || ' is after end date ' || end_date || '.'
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS nth FROM job WHERE start_date > end_date) WHERE nth = 1
  UNION ALL SELECT k, 9, 'C9', 0.2, 'Unrelated skill clusters: Profile combines highly technical AI skills with completely unrelated manual/administrative skills.'
    FROM shape WHERE list_has_any(names, {lst(vocab.UNRELATED_SKILLS)}) AND list_has_any(names, {lst(vocab.AI_SKILLS)})
  UNION ALL SELECT k, 10, 'C10', 0.4, 'Contradictory seniority: Title implies Senior/Lead, but all listed skills are beginner proficiency or < 2 years duration.'
    FROM shape WHERE {_SENIOR} AND listed > 0 AND k NOT IN (
      SELECT k FROM sk WHERE proficiency <> 'beginner' AND duration_months >= 24)),
contra AS (
  SELECT p.k, least(1.0, coalesce(sum(w), 0))::DOUBLE AS contradiction_score,
    coalesce(string_agg(code, '|' ORDER BY o), '') AS codes, coalesce(string_agg(m, '|' ORDER BY o), '') AS reasons
  FROM people p LEFT JOIN hits USING (k) GROUP BY 1)"""

_CLUSTERS = " + ".join(
    f"(len(list_distinct(list_intersect(names, {lst(c)}))) >= 2)::INTEGER" for c in vocab.SKILL_CLUSTERS
)
HONEY = f"""
{rows(list(vocab.TECH_RELEASE_YEARS.items()), 'release(tech, released)')},
pots AS (
  SELECT k, 1 AS o, 'H1' AS code, 0.4 AS w FROM sk, release
    WHERE contains(lname, tech) AND duration_months / 12.0 > {AS_OF_YEAR} - released + 1
  UNION ALL SELECT k, 2, 'H2', 0.3 FROM shape WHERE (contains(t, 'frontend') OR contains(t, 'ui '))
    AND NOT list_has_any(names, {lst(vocab.FRONTEND_SKILLS)})
  UNION ALL SELECT k, 3, 'H3', 0.3 FROM shape WHERE (contains(t, 'backend') OR contains(t, 'back-end'))
    AND NOT list_has_any(names, {lst(vocab.BACKEND_SKILLS)})
  UNION ALL SELECT k, 4, 'H4', 0.2 FROM shape WHERE listed > 75
  UNION ALL SELECT k, 5, 'H5', 0.3 FROM shape WHERE yoe >= 3 AND listed / yoe > 20
  UNION ALL SELECT k, 6, 'H6', 0.2 FROM shape WHERE response_rate = 1.0 AND views > 1000 AND listed > 50
  UNION ALL SELECT k, 7, 'H7', 0.3 FROM shape WHERE {_CLUSTERS} >= 4 AND yoe < 7
  UNION ALL SELECT k, 8, 'H8', 0.3 FROM shape WHERE months > 0 AND yoe > 0 AND yoe * 12 > months + 60
  UNION ALL SELECT k, 9, 'H9', 0.5 FROM shape WHERE len(list_distinct(list_intersect(names, {lst(vocab.AI_BUZZWORDS)}))) >= 3
    AND NOT list_has_any(names, {lst(vocab.AI_FOUNDATIONS)})),
honey AS (
  SELECT p.k, least(1.0, coalesce(sum(w), 0))::DOUBLE AS honeypot_probability, coalesce(string_agg(code, '|' ORDER BY o), '') AS codes
  FROM people p LEFT JOIN pots USING (k) GROUP BY 1)"""

NEGATIVE = """
skill_facts AS (
  SELECT k, avg(endorsements) AS mean_endorsed, count(score) AS scored,
    count(*) FILTER (WHERE proficiency = 'expert' AND endorsements = 0 AND score IS NULL) AS unverified FROM sk GROUP BY 1),
bad AS (
  SELECT k, 1 AS o, 'N1' AS code, 0.10 AS w, 'Possible keyword stuffing: ' || listed || ' skills, avg endorsements='
      || printf('%.1f', mean_endorsed) AS m
    FROM shape JOIN skill_facts USING (k) WHERE listed > 15 AND mean_endorsed < 2 AND scored = 0
  UNION ALL SELECT k, 2, 'N2', 0.08, unverified || ' unverified ''expert'' skills' FROM skill_facts WHERE unverified > 3
  UNION ALL SELECT k, 3, 'N3', 0.05, 'Very low profile completeness: ' || completeness::INTEGER || '%' FROM people WHERE completeness < 30
  UNION ALL SELECT k, 4, 'N4', 0.02, 'Not marked as open to work' FROM people WHERE NOT open_to_work
  UNION ALL SELECT k, 5, 'N5', 0.03, 'Long notice period: ' || notice || ' days' FROM people WHERE notice > 120
  UNION ALL SELECT k, 6, 'N6', 0.05, 'High job hopping: avg tenure ' || printf('%.0f', months / jobs) || ' months'
    FROM shape WHERE jobs >= 5 AND months / jobs < 6),
neg AS (
  SELECT p.k, least(0.35, coalesce(list_sum(list(w::DOUBLE ORDER BY o)), 0))::DOUBLE AS penalty, coalesce(string_agg(code, '|' ORDER BY o), '') AS codes,
    coalesce(string_agg(m, '|' ORDER BY o), '') AS flags, min_by(m, o) AS first_flag
  FROM people p LEFT JOIN bad USING (k) GROUP BY 1)"""

SQL["contradictions"] = with_base(
    "SELECT cid AS candidate_id, round(contradiction_score, 6) AS contradiction_score, codes, reasons FROM people JOIN contra USING (k)",
    SHAPE, CONTRA)
SQL["honeypots"] = with_base(
    "SELECT cid AS candidate_id, round(honeypot_probability, 6) AS honeypot_probability, codes FROM people JOIN honey USING (k)",
    SHAPE, HONEY)
SQL["negative_signals"] = with_base(
    "SELECT cid AS candidate_id, round(penalty, 6) AS penalty, codes, flags FROM people JOIN neg USING (k)", SHAPE, NEGATIVE)
SQL["fraud_gate"] = with_base(
    """SELECT cid AS candidate_id, round(contradiction_score, 6) AS contradiction_score,
  round(honeypot_probability, 6) AS honeypot_probability FROM people JOIN contra USING (k) JOIN honey USING (k)
WHERE contradiction_score < 0.3 AND honeypot_probability < 0.3""", SHAPE, CONTRA, HONEY)
SQL["fraud_breakdown"] = with_base(
    """SELECT code, count(DISTINCT k) AS n FROM (SELECT k, code FROM hits UNION ALL SELECT k, code FROM pots) GROUP BY 1""",
    SHAPE, CONTRA, HONEY)

# --- features -------------------------------------------------------------------------------------


def has(values) -> str:
    return f"list_has_any(names, {lst(values)})::INTEGER::DOUBLE"


_LOW, _HIGH = ROLE["required_experience_min"], ROLE["required_experience_max"]
_LEVEL = vocab.SENIORITY_POINTS.get(ROLE["seniority_level"], 2)
F31 = {
    "embedding_similarity": "coalesce(semantic_score, 0.0)",
    "bm25_score": "0.0",
    "skill_overlap_score": f"len(list_distinct(list_intersect(names, {lst(ASKED)}))) / {len(set(ASKED))}.0",
    "years_experience_score": f"CASE WHEN yoe BETWEEN {_LOW} AND {_HIGH} THEN 1.0 WHEN yoe > {_HIGH} THEN 0.8 ELSE yoe / {_LOW} END",
    "seniority_score": f"greatest(0.0, 1.0 - 0.2 * abs({_LEVEL} - CASE WHEN yoe < 2 THEN 1 WHEN yoe < 5 THEN 2 WHEN yoe < 8 THEN 3 ELSE 4 END))",
    "production_ml_score": has(vocab.PRODUCTION_SKILLS),
    "startup_score": "contains(s, 'startup')::INTEGER::DOUBLE",
    "leadership_score": "(contains(t, 'lead') OR contains(t, 'manager'))::INTEGER::DOUBLE",
    "average_tenure": "CASE WHEN jobs > 0 THEN months / 12 / jobs ELSE 0 END",
    "job_hops": "jobs",
    "career_growth_score": "CASE WHEN jobs > 0 AND months / 12 / jobs > 2 THEN 1.0 ELSE 0.5 END",
    "title_progression_score": "CASE WHEN jobs > 1 AND contains(t, 'senior') THEN 1.0 ELSE 0.5 END",
    "vector_db_score": has(vocab.VECTOR_DB_SKILLS),
    "retrieval_score": has(vocab.RETRIEVAL_SKILLS),
    "ranking_score": has(vocab.RANKING_SKILLS),
    "python_score": has(["python"]),
    "llm_score": has(vocab.LLM_SKILLS),
    "fine_tuning_score": has(vocab.FINE_TUNING_SKILLS),
    "open_source_score": "(github > 0.5)::INTEGER::DOUBLE",
    "recruiter_response_rate": "response_rate",
    "github_activity_score": "github",
    "interview_completion_rate": "interview_rate",
    "profile_views_score": "least(1.0, views / 100.0)",
    "saved_by_recruiters_score": "least(1.0, saved / 20.0)",
    "profile_completeness_score": "completeness",
    "open_to_work_score": "open_to_work::INTEGER::DOUBLE",
    "recent_activity_score": "(last_active_date <> '')::INTEGER::DOUBLE",
    "notice_period_score": "CASE WHEN notice <= 30 THEN 1.0 ELSE 0.5 END",
    "india_score": "contains(lower(country), 'india')::INTEGER::DOUBLE",
    "relocation_score": "relocate::INTEGER::DOUBLE",
    "hybrid_score": "(work_mode = 'hybrid')::INTEGER::DOUBLE",
}
assert list(F31) == FEATURES_31
COS = cosine("embeddings", "vec_id", "7")
FEATURED = "feat AS (SELECT k, cid, title, location, yoe, " + ", ".join(
    f"({e})::DOUBLE AS {n}" for n, e in F31.items()
) + " FROM shape LEFT JOIN cos ON cos.id = shape.k)"
SQL["features31"] = with_base(
    "SELECT cid AS candidate_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in F31) + " FROM feat", SHAPE, COS, FEATURED)

PROMOTED = """
promoted AS (
  SELECT k, count(*) FILTER (WHERE company = before_company AND title <> before_title)::INTEGER AS promotions
  FROM (SELECT k, company, title, lag(company) OVER w AS before_company, lag(title) OVER w AS before_title FROM job
        WINDOW w AS (PARTITION BY k ORDER BY pos)) GROUP BY 1)"""
SQL["promotions"] = with_base("SELECT cid AS candidate_id, promotions FROM people JOIN promoted USING (k)", PROMOTED)


def part(values) -> str:
    return contains_any("joined", values) + "::INTEGER::DOUBLE"


F26 = {
    "embedding_similarity": "yoe / 10",
    "bm25_score": "listed / 50.0",
    "title_similarity": "CASE WHEN contains(t, 'engineer') THEN 1.0 ELSE 0.5 END",
    "summary_similarity": "length(summary) / 1000.0",
    "skill_overlap": "listed / 100.0",
    "vector_db_score": part(vocab.VECTOR_DB_FRAGMENTS),
    "retrieval_score": part(vocab.RETRIEVAL_FRAGMENTS),
    "ranking_score": part(vocab.RANKING_FRAGMENTS),
    "python_score": has(["python"]),
    "llm_score": part(vocab.LLM_FRAGMENTS),
    "fine_tuning_score": part(vocab.FINE_TUNING_FRAGMENTS),
    "average_tenure": "CASE WHEN jobs > 0 THEN yoe / jobs ELSE 0 END",
    "promotions": "promotions",
    "title_progression": "(contains(t, 'senior') AND promotions > 0)::INTEGER::DOUBLE",
    "company_quality": "CASE WHEN known THEN 1.0 ELSE 0.5 END",
    "startup_experience": "contains(s, 'startup')::INTEGER::DOUBLE",
    "recruiter_response": "response_rate",
    "github_score": "github",
    "interview_completion": "interview_rate",
    "recent_activity": "0.5",
    "search_appearance": "0.5",
    "recruiter_saves": "0.5",
    "contradiction_score": "(yoe > 10 AND jobs = 0)::INTEGER::DOUBLE",
    "honeypot_score": f"(yoe = 0 AND {contains_any('joined', vocab.VECTOR_DB_FRAGMENTS)} AND {contains_any('joined', vocab.LLM_FRAGMENTS)})::INTEGER::DOUBLE",
    "inconsistency_score": "(promotions > 10)::INTEGER::DOUBLE",
    "keyword_stuffing_score": "CASE WHEN listed > 100 THEN 1.0 ELSE listed / 100.0 END",
}
assert list(F26) == FEATURES_26
SQL["features26"] = with_base(
    "SELECT cid AS candidate_id, " + ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in F26.items())
    + " FROM shape JOIN promoted USING (k) JOIN words USING (k) JOIN famous USING (k)",
    SHAPE, PROMOTED, "words AS (SELECT k, string_agg(lname, ' ' ORDER BY pos) AS joined FROM sk GROUP BY 1)",
    "famous AS (SELECT k, bool_or(" + contains_any(
        "lower(concat_ws('|', company, title, industry, description))", vocab.KNOWN_COMPANIES) + ") AS known FROM job GROUP BY 1)")
SQL["skill_overlap"] = with_base(
    f"SELECT cid AS candidate_id, round(({F31['skill_overlap_score']})::DOUBLE, 6) AS overlap FROM shape", SHAPE)
_LEVELS = "CASE proficiency " + " ".join(f"WHEN {q(n)} THEN {p}" for n, p in vocab.PROFICIENCY_POINTS.items()) + " ELSE 0 END"
BEST = f"""
best AS (
  SELECT k, string_agg(name, '|' ORDER BY nth) AS top_skills FROM (
    SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY {_LEVELS} DESC, endorsements DESC, pos) AS nth FROM sk)
  WHERE nth <= 5 GROUP BY 1)"""
SQL["top_skills_per_candidate"] = with_base(
    "SELECT cid AS candidate_id, coalesce(top_skills, '') AS top_skills FROM people LEFT JOIN best USING (k)", BEST)

# --- scores ---------------------------------------------------------------------------------------

R4 = """(0.3 * embedding_similarity + 0.2 * years_experience_score + 0.15 * recruiter_response_rate
  + 0.2 * production_ml_score + 0.1 * startup_score + 0.05 * career_growth_score)"""
SQL["weighted_score"] = with_base(f"SELECT cid AS candidate_id, round({R4}, 6) AS score FROM feat", SHAPE, COS, FEATURED)

PARTS = [  # label, weight, component
    ("Production Experience", 0.2, "(production_ml_score + skill_overlap_score) / 2"),
    ("Semantic Match", 0.3, "embedding_similarity"),
    ("Experience", 0.2, "years_experience_score"),
    ("Behavioral Signals", 0.15, "recruiter_response_rate"),
    ("Startup Experience", 0.1, "startup_score"),
    ("Career Stability", 0.05, "career_growth_score"),
]
ITEMS = "item AS (" + " UNION ALL ".join(
    f"SELECT k, {q(name)} AS feature, {i} AS o, {w} * {exact(e, 4)} AS value FROM feat"
    for i, (name, w, e) in enumerate(PARTS)
) + ")"
RAW = " + ".join(f"{w} * {exact(e, 4)}" for _, w, e in PARTS)
POOL = f"""
raw AS (SELECT k, {RAW} AS raw FROM feat),
pool AS (
  SELECT f.*, n.penalty, n.flags, n.first_flag, {exact('raw * (1 - n.penalty)', 6)} AS score, h.honeypot_probability,
    c.contradiction_score
  FROM feat f JOIN raw USING (k) JOIN neg n USING (k) JOIN honey h USING (k) JOIN contra c USING (k)),
topped AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, cid) AS rank FROM pool QUALIFY rank <= 100)"""
ALL = (SHAPE, COS, FEATURED, CONTRA, HONEY, NEGATIVE, ITEMS, POOL)
SQL["weighted_score_penalised"] = with_base(
    "SELECT cid AS candidate_id, round(penalty, 6) AS penalty, score FROM pool", *ALL)
FACTORS = """
factor AS (
  SELECT k, string_agg(feature, '|' ORDER BY nth) AS names,
    string_agg(feature || ' (' || printf('%.2f', value) || ')', '|' ORDER BY nth) AS factors FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC, o) AS nth FROM item) WHERE nth <= 3 GROUP BY 1)"""
SQL["top_factors"] = with_base(
    "SELECT cid AS candidate_id, names AS factors FROM people JOIN factor USING (k)", SHAPE, COS, FEATURED, ITEMS, FACTORS)
SQL["rank_legacy"] = with_base(
    """SELECT rank, cid AS candidate_id, score, coalesce(top_skills, '') AS top_skills, title, factors
FROM topped JOIN factor USING (k) LEFT JOIN best USING (k)""", *ALL, FACTORS, BEST)
SQL["reasoning_text"] = with_base(
    f"""SELECT p.cid AS candidate_id, p.title || ' with ' || printf('%.1f', yoe) || ' yrs; '
  || floor(skill_overlap_score * {len(ROLE['must_have_skills'])})::INTEGER || ' core skills matched; response rate '
  || printf('%.2f', recruiter_response_rate) || CASE WHEN open_to_work_score = 1 THEN '; open to work' ELSE '' END
  || CASE WHEN first_flag IS NOT NULL THEN '; flags: ' || substr(first_flag, 1, 40) ELSE '' END || '.' AS reasoning
FROM pool p""", *ALL)
SQL["candidate_importance"] = with_base(
    f"""SELECT cid AS candidate_id, feature, {exact('abs(value)', 4)} AS importance,
  CASE WHEN value < 0 THEN 'negative' ELSE 'positive' END AS direction FROM people JOIN item USING (k)
UNION ALL SELECT cid, 'Penalty', {exact('penalty', 4)}, 'negative' FROM pool""", *ALL)
SQL["global_importance"] = with_base(
    f"""SELECT feature, {exact('avg(value)', 4)} AS importance, 'positive' AS direction
FROM item SEMI JOIN topped USING (k) GROUP BY 1""", *ALL)
LINEAR = "lin AS (" + " UNION ALL ".join(
    f"SELECT cid, {q(f)} AS feature, {w} * ({f} - avg({f}) OVER ()) AS contribution FROM feat"
    for f, w in (
        ("embedding_similarity", 0.3), ("years_experience_score", 0.2), ("recruiter_response_rate", 0.15),
        ("production_ml_score", 0.2), ("startup_score", 0.1), ("career_growth_score", 0.05),
    )
) + ")"
SQL["linear_contrib"] = with_base(
    "SELECT cid AS candidate_id, feature, round(contribution, 6) AS contribution FROM lin", SHAPE, COS, FEATURED, LINEAR)
SQL["mean_abs_contrib"] = with_base(
    "SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM lin GROUP BY 1", SHAPE, COS, FEATURED, LINEAR)
SQL["score_tiers"] = with_base(
    """SELECT cid AS candidate_id, CASE WHEN score >= 0.85 THEN 'Top Match' WHEN score >= 0.7 THEN 'Strong' ELSE 'Moderate' END AS tier,
  honeypot_probability > 0.4 AS flagged FROM pool""", *ALL)
SQL["pool_kpis"] = with_base(
    f"""SELECT count(*) AS pool, count(*) FILTER (WHERE honeypot_probability <= 0.4) AS clean,
  count(*) FILTER (WHERE honeypot_probability > 0.4) AS flagged, {exact('avg(score)', 4)} AS mean_score FROM pool""", *ALL)
SQL["score_bands"] = with_base(" UNION ALL ".join(
    f"SELECT {q(n)} AS band, count(*) FILTER (WHERE score >= {a} AND score < {b}) AS n FROM pool"
    for n, a, b in (("90+", 0.9, 9), ("80-89", 0.8, 0.9), ("70-79", 0.7, 0.8), ("<70", -9, 0.7))), *ALL)
SQL["compare_top2"] = with_base(" UNION ALL ".join(
    f"SELECT {q(n)} AS attribute, max(CASE WHEN rank = 1 THEN {e}::VARCHAR END) AS a, max(CASE WHEN rank = 2 THEN {e}::VARCHAR END) AS b "
    "FROM topped JOIN people p USING (k) WHERE rank <= 2"
    for n, e in (("candidate_id", "p.cid"), ("title", "p.title"), ("location", "p.location"),
                 ("notice_period_days", "p.notice"), ("years_of_experience", "p.years::DOUBLE"))), *ALL)
SQL["search_ranked"] = with_base(
    """SELECT t.cid AS candidate_id, rank, score FROM topped t JOIN people p USING (k)
WHERE contains(lower(p.name), 'data') OR contains(lower(p.title), 'data') OR k IN (SELECT k FROM sk WHERE contains(lname, 'data'))""",
    *ALL)

# --- labels ---------------------------------------------------------------------------------------

LABELS = f"""
labelled AS (
  SELECT *, CASE
    WHEN contradiction_score >= 0.4 OR honeypot_probability >= 0.4 OR python_score = 0 THEN 'fraud'
    WHEN yoe BETWEEN 5 AND 9 AND production_ml_score > 0 AND retrieval_score > 0 AND embedding_similarity > 0.5
      AND vector_db_score > 0 AND (github_activity_score > 0.5 OR recruiter_response_rate > 0.5) THEN 'excellent'
    WHEN yoe >= 3 AND (production_ml_score > 0 OR retrieval_score > 0 OR vector_db_score > 0) THEN 'good'
    WHEN python_score > 0 OR embedding_similarity > 0.4 THEN 'weak' ELSE 'none' END AS verdict FROM pool),
lab AS (SELECT *, CASE verdict WHEN 'excellent' THEN 3 WHEN 'good' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END AS label,
  CASE verdict {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in vocab.LABEL_REASONS.items())} END AS reason FROM labelled)"""
SQL["pseudo_labels"] = with_base(
    f"""SELECT cid AS candidate_id, label, {exact('embedding_similarity', 4)} AS hybrid_score,
  {exact('contradiction_score', 2)} AS contradiction_score, {exact('honeypot_probability', 2)} AS honeypot_score, reason FROM lab""",
    *ALL, LABELS)
SQL["features_labels"] = with_base(
    "SELECT cid AS candidate_id, label, round(python_score, 6) AS python_score, round(average_tenure, 6) AS average_tenure FROM lab",
    *ALL, LABELS)


def _gain(k: int, order: str) -> str:
    return f"sum(CASE WHEN {order} <= {k} THEN (2 ** label - 1) / log2({order} + 1) ELSE 0 END)"


SQL["ndcg_at_k"] = with_base(
    "SELECT location, " + ", ".join(
        f"round(CASE WHEN {_gain(k, 'i')} = 0 THEN 1.0 ELSE {_gain(k, 'd')} / {_gain(k, 'i')} END, 6) AS ndcg_at_{k}" for k in (10, 50))
    + f""" FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY round({R4}, 6) DESC, cid) AS d,
  row_number() OVER (PARTITION BY location ORDER BY label DESC, cid) AS i FROM lab) GROUP BY 1""", *ALL, LABELS)

SQL["labels_file"] = SQL["pseudo_labels"]
SQL["features_file"] = SQL["features31"]
SQL["importance_file"] = SQL["mean_abs_contrib"]
SQL["search_export"] = SQL["search_ranked"]
SQL["ranking_file"] = with_base(
    """SELECT (rank + 1)::INTEGER AS row_num, cid AS candidate_id, rank::VARCHAR AS rank, printf('%.4f', score) AS score, 4 AS columns FROM topped""",
    *ALL)

# --- the pairwise ranker --------------------------------------------------------------------------

UNIT = 1 << 30


def lambda_slopes(score: str) -> str:
    """Relation ``pull``: per candidate the sums of slope and curvature over all pairs of its place, in units."""
    discount = "CASE WHEN {0}.r <= 30 THEN 1.0 / log2({0}.r + 1) ELSE 0.0 END"
    return f"""
placed AS (SELECT cid, coalesce(location, '') AS g, label, {score} AS s FROM lab),
ordered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, cid) AS r,
  row_number() OVER (PARTITION BY g ORDER BY label DESC, cid) AS i FROM placed),
ideal AS (SELECT g, sum((2.0 ** label - 1.0) / log2(i + 1)) AS most FROM ordered WHERE i <= 30 GROUP BY g HAVING most > 0),
versus AS (
  SELECT a.cid AS hi, b.cid AS lo, 1.0 / (1.0 + exp(a.s - b.s)) AS chance,
    abs(2.0 ** a.label - 2.0 ** b.label) * abs({discount.format('a')} - {discount.format('b')}) / most AS size
  FROM ordered a JOIN ordered b ON a.g = b.g AND a.label > b.label AND least(a.r, b.r) <= 30 JOIN ideal ON ideal.g = a.g),
units AS (SELECT hi, lo, round({UNIT} * size * chance)::BIGINT AS slope,
  round({UNIT} * size * chance * (1.0 - chance))::BIGINT AS curve FROM versus),
summed AS (SELECT cid, sum(slope) AS slope, sum(curve) AS curve FROM (
  SELECT hi AS cid, slope, curve FROM units UNION ALL SELECT lo, -slope, curve FROM units) GROUP BY 1),
pull AS (SELECT cid, coalesce(slope, 0)::DOUBLE / {UNIT} AS slope, coalesce(curve, 0)::DOUBLE / {UNIT} AS curve FROM placed LEFT JOIN summed USING (cid))"""


SQL["lambda_gradients"] = with_base(
    "SELECT cid AS candidate_id, round(slope, 6) AS slope, round(curve, 6) AS curve FROM pull", *ALL, LABELS, lambda_slopes(f"round({R4}, 6)"))


def _split(level: int, members: str) -> str:
    """The best split of every node of a level, and who goes where. ``members`` lists cid and node."""
    strength = "({0}) * ({0}) / ({1} + 1.0)"
    return f"""
in{level} AS ({members}),
sum{level} AS (SELECT node, count(*) AS rows, sum(slope) AS s, sum(curve) AS c FROM in{level} JOIN pull USING (cid) GROUP BY 1),
left{level} AS (SELECT node, f, i, any_value(edge) AS edge, count(*) AS n, sum(slope) AS s, sum(curve) AS c
  FROM in{level} JOIN pull USING (cid) JOIN val USING (cid) JOIN edges USING (f) WHERE v <= edge GROUP BY 1, 2, 3),
try{level} AS (SELECT l.node, f, i, edge, {strength.format('l.s', 'l.c')} + {strength.format('t.s - l.s', 't.c - l.c')} - {strength.format('t.s', 't.c')} AS gain
  FROM left{level} l JOIN sum{level} t USING (node) WHERE n >= 20 AND rows - n >= 20),
pick{level} AS (SELECT * FROM try{level} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, i) = 1)"""


LAMBDA_TREE = (
    lambda_slopes("0.0"),
    "val AS (" + " UNION ALL ".join(f"SELECT cid, {i} AS f, round({f}::DOUBLE, 6) AS v FROM lab" for i, f in enumerate(FEATURES_31)) + ")",
    "edges AS (SELECT f, i, lo + (hi - lo) * i / 16 AS edge FROM (SELECT f, min(v) AS lo, max(v) AS hi FROM val GROUP BY 1 HAVING hi > lo), range(1, 16) t(i))",
    _split(0, "SELECT cid, 1 AS node FROM placed"),
    _split(1, "SELECT cid, 2 * node + (v > edge)::INTEGER AS node FROM in0 JOIN pick0 USING (node) JOIN val USING (cid, f)"),
    """
in2 AS (SELECT cid, 2 * node + (v > edge)::INTEGER AS node FROM in1 JOIN pick1 USING (node) JOIN val USING (cid, f)),
sum2 AS (SELECT node, count(*) AS rows, sum(slope) AS s, sum(curve) AS c FROM in2 JOIN pull USING (cid) GROUP BY 1),
splits AS (SELECT node, f, edge, gain FROM pick0 UNION ALL SELECT node, f, edge, gain FROM pick1),
nodes AS (SELECT node, f, edge, coalesce(gain, 0.0) AS gain, rows, 0.1 * s / (c + 1.0) AS value
  FROM (FROM sum0 UNION ALL FROM sum1 UNION ALL FROM sum2) LEFT JOIN splits USING (node)),
names AS (SELECT unnest(range(""" + str(len(FEATURES_31)) + ")) AS f, unnest(" + lst(FEATURES_31) + """) AS feature),
leaves AS (SELECT cid, l.node, l.value, l.rows / p.rows AS z2, p.f AS f2, CASE WHEN l.node > 3 THEN p.rows / r.rows END AS z1,
    CASE WHEN l.node > 3 THEN r.f END AS f1, ((x2.v > p.edge)::INTEGER = l.node % 2)::INTEGER AS o2,
    ((x1.v > r.edge)::INTEGER = p.node % 2)::INTEGER AS o1
  FROM nodes l JOIN nodes p ON p.node = l.node // 2 JOIN nodes r ON r.node = 1 JOIN val x2 ON x2.f = p.f JOIN val x1 USING (cid)
  WHERE l.f IS NULL AND x1.f = r.f),
parts AS (
  SELECT cid, f2 AS f, value * (o2 - z2) AS part FROM leaves WHERE f1 IS NULL
  UNION ALL SELECT cid, f2, value * (o1 * o2 - z1 * z2) FROM leaves WHERE f1 = f2
  UNION ALL SELECT cid, f1, value * (o1 - z1) * (o2 + z2) / 2 FROM leaves WHERE f1 <> f2
  UNION ALL SELECT cid, f2, value * (o2 - z2) * (o1 + z1) / 2 FROM leaves WHERE f1 <> f2),
shares AS (SELECT cid, feature, sum(part) AS contribution FROM parts JOIN names USING (f) GROUP BY 1, 2)""",
)
SQL["lambda_tree"] = with_base(
    """SELECT node, feature, round(edge, 6) AS edge, round(gain, 4) AS gain, rows, round(value, 6) AS value
FROM nodes LEFT JOIN names USING (f)""", *ALL, LABELS, *LAMBDA_TREE)
SQL["tree_contrib"] = with_base(
    "SELECT cid AS candidate_id, feature, round(contribution, 6) AS contribution FROM shares", *ALL, LABELS, *LAMBDA_TREE)
SQL["tree_mean_abs"] = with_base(
    "SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM shares GROUP BY 1", *ALL, LABELS, *LAMBDA_TREE)

# --- the whole ranking ----------------------------------------------------------------------------

SQL["rank_candidates"] = with_base(
    """SELECT row_number() OVER (ORDER BY score DESC, cid) AS rank, cid AS candidate_id, score,
  round(semantic_score, 6) AS embedding_similarity, round(bm25_norm, 6) AS bm25_norm,
  round(years_experience_score, 6) AS years_experience_score
FROM scored ORDER BY score DESC, cid LIMIT 100""",
    SHAPE, COS, bm25("full_text", "k", "text", ROLE["text"]), HYBRID, CONTRA, HONEY, FEATURED,
    "retrieved AS (SELECT * FROM hybrid ORDER BY hybrid_score DESC, id LIMIT 1000)",
    f"""scored AS (SELECT r.*, f.*, {exact(R4, 4)} AS score FROM retrieved r JOIN feat f ON r.id = f.k
  JOIN contra c USING (k) JOIN honey h USING (k) WHERE contradiction_score < 0.3 AND honeypot_probability < 0.3)""")
SQL["rank_whole_texts"] = with_base(
    """SELECT row_number() OVER (ORDER BY score DESC, cid) AS rank, cid AS candidate_id, score,
  round(semantic_score, 6) AS embedding_similarity, round(bm25_norm, 6) AS bm25_norm,
  round(years_experience_score, 6) AS years_experience_score
FROM scored ORDER BY score DESC, cid LIMIT 100""",
    """whole_text AS (
  SELECT p.k, concat_ws(' ', p.headline, nullif(p.summary, ''), p.title, p.industry, s.listed, j.described) AS text
  FROM people p
    LEFT JOIN (SELECT k, string_agg(name, ' ' ORDER BY pos) AS listed FROM sk GROUP BY k) s USING (k)
    LEFT JOIN (SELECT k, string_agg(description, ' ' ORDER BY pos) AS described FROM job GROUP BY k) j USING (k))""",
    SHAPE, COS, bm25("whole_text", "k", "text", ROLE["text"]), HYBRID, CONTRA, HONEY, FEATURED,
    "retrieved AS (SELECT * FROM hybrid ORDER BY hybrid_score DESC, id LIMIT 1000)",
    f"""scored AS (SELECT r.*, f.*, {exact(R4, 4)} AS score FROM retrieved r JOIN feat f ON r.id = f.k
  JOIN contra c USING (k) JOIN honey h USING (k) WHERE contradiction_score < 0.3 AND honeypot_probability < 0.3)""")
