"""Comparison SQL for the ranking of a table of jobs, from their texts to the best candidates."""

from __future__ import annotations

from oracle import jobs
from oracle.base import exact, q, tokens, with_base
from oracle.ranking import CONTRA, COS, FEATURED, HONEY, R4, SHAPE
from shortlist import vocab

SQL: dict[str, str] = {}

_SLOT = "(('0x' || substr(md5(term), 1, 8))::BIGINT % 64)"


def _bag(name: str, words: str, key: str) -> str:
    """Relation ``name``: the unit vector of every text, a row per slot that is not empty."""
    return f"""
{name} AS (
  SELECT {key}, slot, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v
  FROM (SELECT {key}, {_SLOT} AS slot, count(*)::DOUBLE AS c FROM {words} GROUP BY 1, 2))"""


_ITEMS = jobs.JDS.replace("documents", "benchmark").replace("doc_id", "item_id")
_POINTS = "CASE asked.level " + " ".join(f"WHEN {q(n)} THEN {p}" for n, p in vocab.SENIORITY_POINTS.items()) + " ELSE 2 END"
_OWN = R4.replace("embedding_similarity", "p.semantic_score").replace("years_experience_score", "p.fitting")
SQL["rank_jobs"] = with_base(
    f"""SELECT jd_id, rank, cid AS candidate_id, score, round(semantic_score, 6) AS embedding_similarity, round(bm25_norm, 6) AS bm25_score,
  round(overlap, 6) AS skill_overlap_score, round(fitting, 6) AS years_experience_score, round(steps, 6) AS seniority_score
FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, cid) AS rank FROM matched) WHERE rank <= 100""",
    _ITEMS, *jobs.SKILLS, jobs.EXPERIENCE, jobs.SENIORITY, jobs.TITLES,
    f"""
asked AS (
  SELECT j.jd_id, e.lo, e.hi, l.level, coalesce(m.names, []) AS must, substr({jobs.SUMMARY}, 1, 2000) AS summary
  FROM {jobs.SUMMARISED})""",
    SHAPE, COS, FEATURED, CONTRA, HONEY,
    f"jt AS (SELECT jd_id, unnest({tokens('summary')}) AS term FROM asked)",
    f"pt AS (SELECT k, unnest({tokens('text')}) AS term FROM full_text)",
    _bag("jv", "jt", "jd_id"), _bag("pv", "pt", "k"),
    f"""
near AS (SELECT jd_id, k, round(sum(a.v * b.v), 9) AS s FROM jv a JOIN pv b USING (slot) GROUP BY 1, 2),
ql AS (SELECT k, len({tokens('text')}) AS length FROM full_text),
whole AS (SELECT count(*) AS n, avg(length) AS mean_length FROM ql),
qt AS (SELECT DISTINCT jd_id, term FROM jt),
qf AS (SELECT k, term, count(*) AS tf FROM pt SEMI JOIN qt USING (term) GROUP BY 1, 2),
qi AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM (SELECT term, count(*) AS df FROM qf GROUP BY 1), whole),
qs AS (
  SELECT jd_id, k, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 9) AS s
  FROM qf JOIN qt USING (term) JOIN qi USING (term) JOIN ql USING (k), whole GROUP BY 1, 2),
grid AS (
  SELECT a.jd_id, ql.k, coalesce(qs.s, 0.0) AS s, coalesce(near.s, 0.0) AS semantic_score
  FROM asked a CROSS JOIN ql LEFT JOIN qs ON qs.jd_id = a.jd_id AND qs.k = ql.k LEFT JOIN near ON near.jd_id = a.jd_id AND near.k = ql.k),
normal AS (
  SELECT *, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0.0 END AS bm25_norm
  FROM grid WINDOW w AS (PARTITION BY jd_id)),
found AS (
  SELECT n.*, cid FROM normal n JOIN people USING (k)
  QUALIFY row_number() OVER (PARTITION BY jd_id ORDER BY round(0.4 * bm25_norm + 0.6 * semantic_score, 9) DESC, cid) <= 1000),
compared AS (
  SELECT found.jd_id, k, bm25_norm, semantic_score,
    CASE WHEN yoe BETWEEN least_years AND most_years THEN 1.0 WHEN yoe > most_years THEN 0.8 WHEN least_years > 0 THEN yoe / least_years ELSE 0.0 END::DOUBLE AS fitting,
    greatest(0.0, 1.0 - abs({_POINTS} - CASE WHEN yoe < 2 THEN 1 WHEN yoe < 5 THEN 2 WHEN yoe < 8 THEN 3 ELSE 4 END) * 0.2)::DOUBLE AS steps,
    CASE WHEN len(wanted) = 0 THEN 1.0 ELSE len(list_intersect(wanted, names)) / len(wanted)::DOUBLE END::DOUBLE AS overlap
  FROM found JOIN shape USING (k) JOIN (
    SELECT *, coalesce(lo, 0.0) AS least_years, coalesce(nullif(hi, 0.0), 99.0) AS most_years,
      list_distinct(list_transform(must, lambda x: lower(x))) AS wanted FROM asked) asked USING (jd_id)),
matched AS (
  SELECT p.*, f.cid, {exact(_OWN, 4)} AS score FROM compared p JOIN feat f USING (k) JOIN contra c USING (k) JOIN honey h USING (k)
  WHERE contradiction_score < 0.3 AND honeypot_probability < 0.3)""",
)
