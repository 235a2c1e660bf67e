"""Comparison SQL for job descriptions.

This dialect has no look-around, so sentences are cut by marking breaks in three replacements,
and word boundaries are spelled out as neighbouring characters.
"""

from __future__ import annotations

from oracle.base import contains_any, lst, pick, q, rows
from shortlist import vocab
from shortlist.functions.arrays import any_of, quoted
from shortlist.operators.jd import lone_r_rank, spelling_rows
from shortlist.plans import derived

SQL: dict[str, str] = {}

_W = r"\p{L}\p{N}_"
NL = "chr(10)"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def bounded(phrase: str) -> str:
    """The phrase with word boundaries at both ends, as the characters next to it."""
    word = lambda c: c.isalnum() or c == "_"
    left = rf"(?:^|[^{_W}])" if word(phrase[0]) else f"[{_W}]"
    right = rf"(?:$|[^{_W}])" if word(phrase[-1]) else f"[{_W}]"
    return left + quoted(phrase) + right


def has_word(column: str, phrases) -> str:
    return f"regexp_matches({column}, {q('|'.join(bounded(p) for p in phrases))})"


_T0 = f"{pick(derived.JD_TEMPLATES, 'doc_id')} || {NL} || text"
_T1 = f"replace(translate({_T0}, '–—’‘' || chr(160), '--'''' '), '•', {NL} || '• ')"
_T2 = f"regexp_replace(regexp_replace({_T1}, '\\r\\n|\\r', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')"
_T3 = strip(rf"regexp_replace({_T2}, '[^\S\n]+(\n|\z)', '\1', 'g')")
JDS = f"jds AS MATERIALIZED (SELECT doc_id AS jd_id, clean, lower(clean) AS low FROM (SELECT doc_id, {_T3} AS clean FROM documents))"


def cut(column: str) -> str:
    """The sentences of a text as a list."""
    marked = rf"regexp_replace({column}, '\n\s*\d+[.)]\s+', chr(1), 'g')"
    marked = rf"regexp_replace({marked}, '\n\s*[-•*]\s*', chr(1), 'g')"
    marked = rf"regexp_replace({marked}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {strip('x')}), lambda x: length(x) > 3)"


_LOWERED = "trim(regexp_replace(lower(bare), ':+$', ''))"
SECTIONS = f"""
line AS (
  SELECT jd_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT jd_id, string_split(clean, {NL}) AS parts FROM jds)),
labelled AS (
  SELECT jd_id, pos, line, CASE WHEN length(bare) BETWEEN 1 AND 80 AND NOT regexp_matches(bare, '^[\\-•*]\\s|^\\d+\\.')
      AND length({_LOWERED}) < 60 THEN CASE {' '.join(f"WHEN regexp_matches({_LOWERED}, {q(any_of(v))}) THEN {q(k)}" for k, v in vocab.SECTION_HEADERS.items())} END END AS label
  FROM (SELECT *, {strip('line')} AS bare FROM line)),
spanned AS (
  SELECT *, last_value(label IGNORE NULLS) OVER w AS section, count(label) OVER w AS no
  FROM labelled WINDOW w AS (PARTITION BY jd_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
piece AS (
  SELECT jd_id, section, no, {strip(f"string_agg(line, {NL} ORDER BY pos)")} AS body
  FROM spanned WHERE label IS NULL AND section IS NOT NULL GROUP BY 1, 2, 3),
named AS (SELECT jd_id, section, string_agg(body, {NL} ORDER BY no) AS body FROM piece GROUP BY 1, 2),
section AS (
  SELECT * FROM named UNION ALL SELECT jd_id, 'full_text', clean FROM jds WHERE jd_id NOT IN (SELECT jd_id FROM named))"""


def jd(tail: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([JDS, *[c.strip() for c in ctes]]) + "\n" + tail


SQL["jd_normalise"] = jd("SELECT jd_id, md5(clean) AS digest, length(clean)::INTEGER AS chars FROM jds")
SQL["jd_sentences"] = jd(
    f"SELECT jd_id, len(s)::INTEGER AS sentences, md5(array_to_string(s, {NL} || {NL})) AS digest FROM s",
    f"s AS (SELECT jd_id, {cut('clean')} AS s FROM jds)")
SQL["jd_sections"] = jd(
    "SELECT jd_id, section, length(body)::INTEGER AS chars, md5(body) AS digest FROM section", SECTIONS)

# --- skills -------------------------------------------------------------------------------------

_SPELLINGS = rows([(r["spelling"], r["name"], r["rank"]) for r in spelling_rows()], "spelling(spelling, name, rank)")


def _count(values) -> str:
    return "(" + " + ".join(f"contains(low, {q(v)})::INTEGER" for v in values) + ")"


def _wordlike(text: str) -> str:
    """Single words between spaces. A full stop before white space goes, others stay; chr(1) holds its place meanwhile."""
    stops = f"regexp_replace({text}, '[.](\\s|$)', chr(1) || '\\1', 'g')"
    spaced = f"regexp_replace({stops}, '[^\\p{{L}}\\p{{N}}+#./&\\x01-]+', ' ', 'g')"
    return f"(' ' || replace({spaced}, chr(1), ' ') || ' ')"


def _found(kind: str, default: str, section: str, text: str, whole: bool = False) -> str:
    """Relations ``{kind}_text``, ``{kind}_sent`` and ``{kind}``: the mentions from one part of the text; ``whole`` asks for whole words."""
    inside, held, asked = ("lower(body)", "s.low", "w.spelling") if not whole else ("body_words", "s.words", "' ' || w.spelling || ' '")
    spelled = "spelling" if not whole else "' ' || spelling || ' '"
    return f"""
{kind}_text AS (
  SELECT *, {_wordlike('lower(body)')} AS body_words FROM (
    SELECT j.jd_id, coalesce(nullif(s.body, ''), j.clean) AS body, j.clean FROM jds j
      LEFT JOIN named s ON s.jd_id = j.jd_id AND s.section = {q(text)})),
{kind}_pool AS (
  SELECT jd_id, CASE WHEN len(own) > 0 THEN own ELSE {cut('clean')} END AS sents
  FROM (SELECT jd_id, clean, {cut('body')} AS own FROM {kind}_text)),
{kind}_sent AS MATERIALIZED (
  SELECT *, CASE WHEN must > nice THEN 'must_have' WHEN nice > must THEN 'nice_to_have' ELSE {q(default)} END AS context,
    CASE WHEN must > nice THEN least(0.70 + must * 0.05, 0.95) WHEN nice > must THEN least(0.70 + nice * 0.05, 0.90)
      ELSE 0.65 END::DOUBLE AS conf, {_wordlike('low')} AS words
  FROM (SELECT jd_id, pos, low, {contains_any('low', vocab.NEGATION_CUES)} AS negated, {_count(vocab.MUST_HAVE_CUES)} AS must,
      {_count(vocab.NICE_TO_HAVE_CUES)} AS nice
    FROM (SELECT jd_id, generate_subscripts(sents, 1) AS pos, lower(unnest(sents)) AS low FROM {kind}_pool))),
{kind}_word AS MATERIALIZED (
  SELECT jd_id, spelling, name, rank FROM {kind}_text, spelling WHERE contains({inside}, {spelled})),
{kind}_hit AS (
  SELECT w.jd_id, w.name, w.rank,
    CASE WHEN bool_or(s.negated) THEN 'nice_to_have' ELSE coalesce(min_by(s.context, (-s.conf, s.pos)), {q(default)}) END AS context,
    CASE WHEN bool_or(s.negated) THEN 0.55 ELSE coalesce(max(s.conf), 0.60) END AS conf
  FROM {kind}_word w LEFT JOIN {kind}_sent s ON s.jd_id = w.jd_id AND contains({held}, {asked}) GROUP BY ALL
  UNION ALL SELECT jd_id, 'R', {lone_r_rank()}, {q(default)}, 0.60 FROM {kind}_text WHERE regexp_matches(body, {q(bounded('R'))})),
{kind}_best AS (
  SELECT jd_id, name, min_by(context, (-conf, rank)) AS context, max(conf) AS conf, min(rank) AS rank
  FROM {kind}_hit GROUP BY 1, 2),
{kind} AS (
  SELECT *, {q(section)} AS section, row_number() OVER (
    PARTITION BY jd_id ORDER BY context <> 'must_have', -conf, rank) AS nth FROM {kind}_best QUALIFY nth <= 30)"""


SKILLS = (SECTIONS, _SPELLINGS, _found("must", "must_have", "requirements", "requirements"),
          _found("nice", "nice_to_have", "preferred", "preferred"),
          "extra AS (SELECT * FROM nice n WHERE NOT EXISTS (SELECT 1 FROM must m WHERE m.jd_id = n.jd_id AND m.name = n.name))")
SQL["jd_skill_mentions"] = jd(
    """SELECT jd_id, name, context, round(conf, 6) AS confidence, section FROM must
UNION ALL SELECT jd_id, name, context, round(conf, 6), section FROM extra""", *SKILLS)

SQL["jd_word_mentions"] = jd(
    """SELECT jd_id, name, context, round(conf, 6) AS confidence, section FROM must
UNION ALL SELECT jd_id, name, context, round(conf, 6), section FROM extra""",
    *SKILLS[:2], _found("must", "must_have", "requirements", "requirements", True), _found("nice", "nice_to_have", "preferred", "preferred", True), SKILLS[-1])

# --- numbers and seniority ------------------------------------------------------------------------


def _group(pattern: str, n: int) -> str:
    return f"regexp_extract(clean, {q(pattern)}, {n})"


def _number(pattern: str, n: int) -> str:
    return f"try_cast({_group(pattern, n)} AS DOUBLE)"


_EXP = ["(?i)" + p for p in vocab.EXPERIENCE_PATTERNS]
_first = lambda build: "CASE " + " ".join(
    f"WHEN {_group(p, 0)} <> '' THEN {build(i, p)}" for i, p in enumerate(_EXP)) + " END"
EXPERIENCE = f"""
exp AS (
  SELECT *, {_first(lambda i, p: f"least({_number(p, 1)}, {_number(p, 2)})" if i == 0 else _number(p, 1))} AS lo,
    {_first(lambda i, p: f"greatest({_number(p, 1)}, {_number(p, 2)})" if i == 0
            else f"CASE WHEN contains({_group(p, 0)}, '+') THEN NULL ELSE {_number(p, 1)} + 4 END")} AS hi,
    {_first(lambda i, p: _group(p, 0))} AS raw FROM jds)"""
SQL["jd_experience"] = jd(
    "SELECT jd_id, lo AS years_min, hi AS years_max, coalesce((lo + hi) / 2, lo) AS midpoint, raw FROM exp", EXPERIENCE)

_LEVELS = " UNION ALL ".join(
    f"SELECT jd_id, {q(level)} AS level, {conf}::DOUBLE AS conf, {i} AS o FROM jds WHERE {has_word('low', phrases)}"
    for i, (level, conf, phrases) in enumerate(vocab.SENIORITY_PHRASES))
SENIORITY = f"""
said AS ({_LEVELS}),
stated AS (
  SELECT e.jd_id, e.lo, coalesce((lo + hi) / 2, lo) AS middle, coalesce(s.level, 'unknown') AS stated, coalesce(s.conf, 0.0) AS conf
  FROM exp e LEFT JOIN (SELECT jd_id, min_by(level, (-conf, o)) AS level, max(conf) AS conf FROM said GROUP BY 1) s USING (jd_id)),
level AS (
  SELECT jd_id, stated,
    CASE WHEN lo IS NULL OR stated <> 'unknown' THEN stated WHEN y = 0 THEN 'intern' WHEN y <= 2 THEN 'junior' WHEN y <= 5 THEN 'mid'
      WHEN y <= 8 THEN 'senior' WHEN y <= 12 THEN 'lead' ELSE 'principal' END AS level,
    CASE WHEN lo IS NULL THEN conf WHEN stated = 'unknown' THEN CASE WHEN y = 0 THEN 0.55 WHEN y <= 8 THEN 0.6 ELSE 0.55 END
      WHEN CASE stated {' '.join(f"WHEN {q(n)} THEN y NOT BETWEEN {a} AND {b}" for n, (a, b) in vocab.SENIORITY_YEARS.items())} END
      THEN round(greatest(conf - 0.1, 0.4), 2) ELSE conf END::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN middle = 0 THEN lo ELSE middle END AS y FROM stated))"""
SQL["jd_seniority"] = jd(
    "SELECT jd_id, stated, level, round(confidence, 6) AS confidence FROM level", EXPERIENCE, SENIORITY)

# --- lists ----------------------------------------------------------------------------------------


def _joined(items: list[tuple[str, str]]) -> str:
    """``name`` of every condition that holds, in order."""
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {condition} THEN {q(name)} END" for name, condition in items) + "], lambda x: x IS NOT NULL), '|')"


_INDUSTRIES = _joined([(name, contains_any("low", found)) for name, found in vocab.INDUSTRY_WORDS.items()])
SQL["jd_industries"] = jd(f"SELECT jd_id, {_INDUSTRIES} AS industries FROM jds")
_city = lambda part: "CASE " + " ".join(
    f"WHEN contains(low, {q(s)}) THEN {q(place[part])}" for s, place in vocab.CITIES.items()) + " END"
_COUNTRY = "CASE " + " ".join(f"WHEN {has_word('low', [s])} THEN {q(c)}" for s, c in vocab.COUNTRIES.items()) + " END"
_MODE = "CASE " + " ".join(
    f"WHEN {contains_any('low', p)} THEN {q(m)}" for m, p in vocab.WORK_MODE_PHRASES.items()) + " ELSE 'unknown' END"
SQL["jd_location"] = jd(f"""
SELECT jd_id, {_city(0)} AS city, coalesce({_city(1)}, {_COUNTRY}) AS country, {_MODE} AS work_mode,
  {contains_any('low', vocab.RELOCATION_PHRASES)} AS relocation_offered,
  {contains_any('low', vocab.VISA_PHRASES)} AS visa_sponsorship FROM jds""")
_flag = lambda name: contains_any("low", [p for p, (f, _) in vocab.STARTUP_PHRASES.items() if f == name])
_STAGE = "CASE " + " ".join(
    f"WHEN contains(low, {q(p)}) THEN {q(stage)}"
    for p, (_, stage) in reversed(vocab.STARTUP_PHRASES.items()) if stage) + " END"
SQL["jd_startup"] = jd("SELECT jd_id, " + ", ".join(
    f"{_flag(n)} AS {n}" for n in ("is_startup", "fast_paced", "ownership_culture", "equity_mentioned", "flat_hierarchy", "scrappy_culture"))
    + f""", {_STAGE} AS funding_stage,
  array_to_string(list_filter({lst(vocab.STARTUP_PHRASES)}, lambda x: contains(low, x)), '|') AS signals FROM jds""")

_LEAD = [("(?i)" + p, meaning) for p, meaning in vocab.LEADERSHIP_PATTERNS]
_any = lambda *names: "(" + " OR ".join(f"{_group(p, 0)} <> ''" for p, m in _LEAD if m in names) + ")"
_RANGES = [p for p, m in _LEAD if m == "reports_range"]
_MINS = [p for p, m in _LEAD if m == "min_reports"]
_int = lambda p, n: f"try_cast({_group(p, n)} AS INTEGER)"
SQL["jd_leadership"] = jd(f"""
SELECT jd_id, {_any('requires_management', 'reports_range', 'min_reports', 'technical_lead')} AS requires_management,
  {_any('hiring_manager')} AS hiring_manager, {_any('cross_functional')} AS cross_functional,
  {_any('technical_lead')} AS technical_lead, {_any('strategy_ownership')} AS strategy_ownership,
  CASE {' '.join(f"WHEN {_group(p, 0)} <> '' THEN {_int(p, 1)}" for p in reversed(_MINS))}
    {' '.join(f"WHEN {_group(p, 0)} <> '' THEN least({_int(p, 1)}, {_int(p, 2)})" for p in reversed(_RANGES))} END AS min_direct_reports,
  CASE {' '.join(f"WHEN {_group(p, 0)} <> '' THEN greatest({_int(p, 1)}, {_int(p, 2)})" for p in reversed(_RANGES))} END AS max_direct_reports,
  array_to_string(list_slice(list_filter([{', '.join(f"substr(nullif({_group(p, 0)}, ''), 1, 60)" for p, _ in _LEAD)}],
    lambda x: x IS NOT NULL), 1, 10), '|') AS signals FROM jds""")
SQL["jd_negative"] = jd(" UNION ALL ".join(
    f"SELECT jd_id, {q(label)} AS signal, {q(category)} AS category, substr({_group('(?i)' + p, 0)}, 1, 100) AS raw "
    f"FROM jds WHERE {_group('(?i)' + p, 0)} <> ''" for p, category, label in vocab.NEGATIVE_PATTERNS))

TITLES = f"""
title AS (
  SELECT jd_id, list_filter(list_slice(list_filter(list_transform(string_split(clean, {NL}), lambda x: {strip('x')}),
      lambda x: x <> ''), 1, 3), lambda x: length(x) BETWEEN 6 AND 79 AND NOT regexp_matches(x, '[.,?@]')
      AND regexp_matches(x, {q('(?i)' + '|'.join(vocab.TITLE_LINE_WORDS))}))
    || list_filter(list_transform(regexp_extract_all(clean, {q('(?i)' + vocab.HIRING_PATTERN)}, 1),
      lambda x: regexp_replace({strip('x')}, '[,.]+$', '')), lambda x: length(x) BETWEEN 6 AND 69)
    || list_filter(list_transform(regexp_extract_all(clean, {q('(?i)' + vocab.ROLE_PATTERN)}, 1), lambda x: {strip('x')}),
      lambda x: length(x) BETWEEN 6 AND 69)
    || list_filter({lst(vocab.KNOWN_TITLES)}, lambda x: contains(low, lower(x))) AS found FROM jds),
titles AS (
  SELECT t.jd_id, array_to_string(coalesce(list_slice(s.kept, 1, 8), []), '|') AS titles FROM title t LEFT JOIN (
    SELECT jd_id, list(name ORDER BY pos) AS kept FROM (
      SELECT jd_id, min(pos) AS pos, min_by(name, pos) AS name FROM (
        SELECT jd_id, generate_subscripts(found, 1) AS pos, unnest(found) AS name FROM title) GROUP BY jd_id, lower(name))
    GROUP BY 1) s USING (jd_id))"""
SQL["jd_titles"] = jd("SELECT jd_id, titles FROM titles", TITLES)

_PAY = vocab.SALARY_PATTERNS
SALARY = "CASE " + " ".join(f"WHEN {_group(p, 0)} <> '' THEN {{}}" for p in _PAY) + " END"
SQL["jd_salary"] = jd(
    "SELECT jd_id, " + SALARY.format(*[_number(p, 1) for p in _PAY]) + " AS salary_min, "
    + SALARY.format(*[_number(p, 2) if i < 2 else f"{_number(p, 1)} * 1.5" for i, p in enumerate(_PAY)])
    + " AS salary_max FROM jds")

# --- the hand-off -----------------------------------------------------------------------------------

_NEGATIVE = _joined([(label, f"{_group('(?i)' + p, 0)} <> ''") for p, _, label in vocab.NEGATIVE_PATTERNS])
#: The text a description is searched with, uncut, and what it is made of.
SUMMARY = f"""concat_ws(' ', nullif(substr(j.clean, 1, 600), ''), 'Required skills: ' || coalesce(m.first15, ''),
    'Nice-to-have: ' || coalesce(x.first10, ''),
    'Titles: ' || array_to_string(list_slice(string_split(t.titles, '|'), 1, 4), ', '), 'Seniority: ' || l.level,
    'Industries: ' || array_to_string(list_slice(string_split({_INDUSTRIES.replace('low,', 'j.low,')}, '|'), 1, 5), ', '))"""
SUMMARISED = """jds j JOIN exp e USING (jd_id) JOIN level l USING (jd_id) JOIN titles t USING (jd_id)
  LEFT JOIN (SELECT jd_id, string_agg(name, '|' ORDER BY nth) AS joined, list(name ORDER BY nth) AS names,
    string_agg(name, ', ' ORDER BY nth) FILTER (WHERE nth <= 15) AS first15 FROM must GROUP BY 1) m USING (jd_id)
  LEFT JOIN (SELECT jd_id, string_agg(name, '|' ORDER BY nth) AS names,
    string_agg(name, ', ' ORDER BY nth) FILTER (WHERE again <= 10) AS first10
    FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY nth) AS again FROM extra) GROUP BY 1) x USING (jd_id)"""
SQL["jd_requirements"] = jd(f"""
SELECT j.jd_id, coalesce(m.joined, '') AS must_have_skills, coalesce(x.names, '') AS nice_to_have_skills,
  e.lo AS required_experience_min, e.hi AS required_experience_max, l.level AS seniority_level,
  {_INDUSTRIES.replace('low,', 'j.low,')} AS required_industries,
  EXISTS (SELECT 1 FROM (SELECT jd_id, name FROM must UNION ALL SELECT jd_id, name FROM extra) a
    WHERE a.jd_id = j.jd_id AND lower(a.name) IN ({', '.join(q(s) for s in vocab.PRODUCTION_ML_SKILLS)}))
    OR (contains(j.low, 'production') AND contains(j.low, 'machine learning')) AS production_ml_requirements,
  {_NEGATIVE.replace('(clean,', '(j.clean,')} AS negative_signals, {_city(0).replace('(low,', '(j.low,')} AS city,
  {_MODE.replace('(low,', '(j.low,')} AS work_mode_requirements,
  least(2000, length({SUMMARY}))::INTEGER
    AS summary_chars
FROM {SUMMARISED}""",
    *SKILLS, EXPERIENCE, SENIORITY, TITLES)
