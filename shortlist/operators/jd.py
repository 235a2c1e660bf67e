"""Job descriptions to structured requirements, for a table of them.

Input ``(jd_id, text)``. Every extraction is an expression over one row: the word lists are
literals, so a table of descriptions is parsed in one narrow stage without joins or shuffles.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.arrays import any_of, count_substrings, has_any_substring, let, words
from shortlist.functions.text import normalised, sections, sentences, stripped

MUST, NICE = "must_have", "nice_to_have"
MENTION = "struct<name:string,context:string,confidence:double,section:string>"


@dataclass(frozen=True)
class Caps:
    """How much of a description is kept; ``None`` keeps all of it."""

    mentions: int | None = 30
    snippets: int | None = 10
    snippet_chars: int | None = 60
    negative_chars: int | None = 100
    title_lines: int | None = 3
    titles: int | None = 8
    section_chars: int | None = 500
    summary_clean_chars: int | None = 600
    summary_must_have: int | None = 15
    summary_nice_to_have: int | None = 10
    summary_titles: int | None = 4
    summary_industries: int | None = 5
    summary_chars: int | None = 2000


CAPS = Caps()
UNCAPPED = Caps(**{field.name: None for field in fields(Caps)})


def _first(values: Column | str, n: int | None) -> Column:
    return (F.col(values) if isinstance(values, str) else values) if n is None else F.slice(values, 1, n)


def _begin(value: Column | str, n: int | None) -> Column:
    return (F.col(value) if isinstance(value, str) else value) if n is None else F.substring(value, 1, n)


def whole_words(values: list[str]) -> str:
    """A pattern for one of the phrases, bounded like words of any script."""
    return rf"(?U)\b(?:{any_of(values)})\b"


def _records(rows: list[dict], ddl: str) -> Column:
    """A literal array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")


# --- skills -----------------------------------------------------------------------------


def _ranked_spellings(skills: dict[str, list[str]] | None) -> list[tuple[str, str]]:
    table = vocab.SKILL_SPELLINGS if skills is None else skills
    rows = [(-len(vocab.LONE_R), False, list(table).index("R") if "R" in table else len(table), vocab.LONE_R, "R")]
    for position, (name, others) in enumerate(table.items()):
        for spelling in {name.lower(), *others}:
            rows.append((-len(spelling), spelling in vocab.SPELLED_LAST, position, spelling, name))
    return [(spelling, name) for *_, spelling, name in sorted(rows)]


def spelling_rows(skills: dict[str, list[str]] | None = None) -> list[dict]:
    """Every spelling with its skill, longest first; that order decides between equal mentions."""
    rows = enumerate(_ranked_spellings(skills))
    return [{"spelling": s, "name": n, "rank": i} for i, (s, n) in rows if s != vocab.LONE_R]


def lone_r_rank(skills: dict[str, list[str]] | None = None) -> int:
    """Where a capital R standing alone ranks among the spellings: by the length of its pattern."""
    return _ranked_spellings(skills).index((vocab.LONE_R, "R"))


def _wordlike(text: Column) -> Column:
    """Text with single spaces between words and around it, for whole-word search."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}+#./&-]+|[.](?=\s|$)", " "), F.lit(" "))


def cued_sentences(found: Column, default: str) -> Column:
    """Each sentence with its lower-cased text, whether it negates, and its context and confidence."""

    def cue(sentence: Column) -> Column:
        return let(
            F.lower(sentence),
            lambda low: F.struct(
                low.alias("low"),
                has_any_substring(low, vocab.NEGATION_CUES).alias("negated"),
                count_substrings(low, vocab.MUST_HAVE_CUES).alias("must"),
                count_substrings(low, vocab.NICE_TO_HAVE_CUES).alias("nice"),
            ),
        )

    return F.transform(
        F.transform(found, cue),
        lambda s: F.struct(
            s["low"].alias("low"),
            s["negated"].alias("negated"),
            F.when(s["must"] > s["nice"], MUST).when(s["nice"] > s["must"], NICE).otherwise(default).alias("context"),
            F.when(s["must"] > s["nice"], F.least(0.70 + s["must"] * F.lit(0.05), F.lit(0.95)))
            .when(s["nice"] > s["must"], F.least(0.70 + s["nice"] * F.lit(0.05), F.lit(0.90)))
            .otherwise(0.65)
            .alias("confidence"),
        ),
    )


def _candidates(low: Column, spellings: Column) -> Column:
    """The spellings whose longest word occurs in ``low``: all that a part of the text can hold, and few others.

    A word without spaces or line ends lies within one such piece of the text, and long texts have few different ones.
    """
    pieces = F.array_join(F.array_distinct(F.split(F.translate(low, "\n", " "), " ", -1)), " ")
    return let(pieces, lambda distinct: F.filter(spellings, lambda a: F.contains(distinct, a["key"])))


def _mentions(text: Column, cued: Column, default: str, section: str, match: str, spellings: Column, lone: int,
              caps: Caps = CAPS) -> Column:
    """The skills a text mentions, best context per skill, at most 30."""
    if match not in ("substring", "word"):
        raise ValueError("match must be 'substring' or 'word'")
    whole = match == "word"

    def pad(c: Column) -> Column:
        return F.concat(F.lit(" "), c, F.lit(" ")) if whole else c

    def searchable(c: Column) -> Column:
        return _wordlike(F.lower(c)) if whole else F.lower(c)

    inside = F.transform(cued, lambda s: s.withField("low", _wordlike(s["low"]))) if whole else cued
    start = F.struct(
        F.lit(False).alias("negated"), F.lit(default).alias("context"), F.lit(0.60).alias("confidence")
    )

    def classify(spelling: Column, pool: Column) -> Column:
        """One pass over the sentences that hold the spelling; the first of the most confident wins."""
        return F.aggregate(
            F.filter(pool, lambda s: F.contains(s["low"], pad(spelling))),
            start,
            lambda acc, s: F.struct(
                (acc["negated"] | s["negated"]).alias("negated"),
                F.when(s["confidence"] > acc["confidence"], s["context"]).otherwise(acc["context"]).alias("context"),
                F.greatest(s["confidence"], acc["confidence"]).alias("confidence"),
            ),
            lambda acc: F.struct(
                F.when(acc["negated"], NICE).otherwise(acc["context"]).alias("context"),
                F.when(acc["negated"], 0.55).otherwise(acc["confidence"]).alias("confidence"),
            ),
        )

    matched = let(
        searchable(text), lambda low: F.filter(spellings, lambda a: F.contains(low, pad(a["spelling"])))
    )
    hits = let(
        inside,
        lambda pool: F.transform(
            matched,
            lambda a: F.struct(
                a["name"].alias("name"), a["rank"].alias("rank"), classify(a["spelling"], pool).alias("found")
            ),
        ),
    )
    # A capital R standing alone counts as the language, with no context of its own.
    alone = F.when(
        text.rlike(r"(?U)\bR\b"),
        F.array(
            F.struct(
                F.lit("R").alias("name"),
                F.lit(lone).alias("rank"),
                F.struct(F.lit(default).alias("context"), F.lit(0.60).alias("confidence")).alias("found"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<name:string,rank:int,found:struct<context:string,confidence:double>>>"))

    def best_of(name: Column, mine: Column) -> Column:
        """The most confident mention of one skill, placed where its longest spelling ranks."""
        top = F.array_min(
            F.transform(
                mine,
                lambda h: F.struct(
                    (-h["found"]["confidence"]).alias("minus"), h["rank"].alias("rank"),
                    h["found"]["context"].alias("context"),
                ),
            )
        )
        first = F.array_min(F.transform(mine, lambda h: h["rank"]))
        return let(
            top,
            lambda t: F.struct(
                (t["context"] != MUST).cast("int").alias("later"), t["minus"].alias("minus"),
                first.alias("rank"), name.alias("name"), t["context"].alias("context"),
            ),
        )

    best = let(
        F.concat(alone, hits),
        lambda found: F.transform(
            F.array_distinct(F.transform(found, lambda h: h["name"])),
            lambda name: let(F.filter(found, lambda h: h["name"] == name), lambda mine: best_of(name, mine)),
        ),
    )
    return F.transform(
        _first(F.array_sort(best), caps.mentions),
        lambda b: F.struct(
            b["name"].alias("name"), b["context"].alias("context"), (-b["minus"]).alias("confidence"),
            F.lit(section).alias("section"),
        ),
    )


def _names(mentions: Column) -> Column:
    return F.transform(mentions, lambda m: m["name"])


def with_cues(parsed: DataFrame) -> DataFrame:
    """Adds the parts that must-haves and nice-to-haves are looked for in, and their sentences with cues."""
    part = lambda name: F.coalesce(
        F.nullif(F.try_element_at("sections", F.lit(name)), F.lit("")), F.col("clean")
    )
    parts = parsed.select("*", part("requirements").alias("_must_text"), part("preferred").alias("_nice_text"))

    # A part that is the whole text has the sentences of the text; any other is cut here, once.
    own = lambda column: F.when(F.col(column) == F.col("clean"), F.col("sentences")).otherwise(sentences(F.col(column)))
    parts = parts.select("*", own("_must_text").alias("_must_own"), own("_nice_text").alias("_nice_own"))
    pool = lambda column: F.when(F.size(column) > 0, F.col(column)).otherwise(F.col("sentences"))
    cued = parts.select(
        "*", cued_sentences(pool("_must_own"), MUST).alias("_must_cues"), cued_sentences(pool("_nice_own"), NICE).alias("_nice_cues")
    )
    return cued.drop("_must_own", "_nice_own")


def with_skills(parsed: DataFrame, match: str = "substring", skills: dict[str, list[str]] | None = None,
                caps: Caps = CAPS) -> DataFrame:
    """Must-have and nice-to-have mentions.

    Must-haves come from the requirements section, nice-to-haves from the preferred one; without
    such a section the whole text is searched. A skill is never in both lists.
    """
    rows = [{**row, "key": max(re.split(r"[ \n]", row["spelling"]), key=len)} for row in spelling_rows(skills)]
    spellings, lone = _records(rows, "spelling:string,name:string,rank:int,key:string"), lone_r_rank(skills)
    cued = with_cues(parsed).withColumn("_spellings", _candidates(F.lower("clean"), spellings))
    found = cued.select(
        "*",
        _mentions(
            F.col("_must_text"), F.col("_must_cues"), MUST, "requirements", match, F.col("_spellings"), lone, caps
        ).alias("must_have"),
        _mentions(
            F.col("_nice_text"), F.col("_nice_cues"), NICE, "preferred", match, F.col("_spellings"), lone, caps
        ).alias("_nice_all"),
    )
    return (
        found.withColumn("must_have_skills", _names(F.col("must_have")))
        .withColumn(
            "nice_to_have",
            F.filter("_nice_all", lambda m: ~F.array_contains("must_have_skills", m["name"])),
        )
        .withColumn("nice_to_have_skills", _names(F.col("nice_to_have")))
        .withColumn("all_skills", F.array_distinct(F.concat("must_have_skills", "nice_to_have_skills")))
        .drop("_must_text", "_nice_text", "_must_cues", "_nice_cues", "_spellings", "_nice_all")
    )


# --- numbers ----------------------------------------------------------------------------


def _extract(text: Column, low: Column, pattern: str, needs: list[str]) -> Column:
    """The first match, or "". ``needs`` are words of which every match holds at least one.

    Searching for a plain word is much cheaper than for a pattern, and most texts stop there.
    """
    return F.when(has_any_substring(low, needs), F.regexp_extract(text, pattern, 0)).otherwise("")


def _first_of(snippets: Column, patterns: list[str], build) -> Column:
    """``build(index, pattern, match)`` for the first pattern, in list order, that matched."""
    out = F.lit(None)
    for i, pattern in reversed(list(enumerate(patterns))):
        snippet = F.get(snippets, F.lit(i))
        out = F.when(snippet != "", build(i, pattern, snippet)).otherwise(out)
    return out


def _number(snippet: Column, pattern: str, group: int, kind: str = "double") -> Column:
    """A number of a match; the pattern finds the same groups in the matched piece alone."""
    return F.regexp_extract(snippet, pattern, group).try_cast(kind)


def experience(text: Column) -> Column:
    """``struct<min, max, raw>``; an open end is null, a single number spans four years."""
    patterns = [f"(?i){p}" for p in vocab.EXPERIENCE_PATTERNS]

    def build(i: int, pattern: str, raw: Column) -> Column:
        low = _number(raw, pattern, 1)
        if i == 0:
            other = _number(raw, pattern, 2)
            return F.struct(
                F.least(low, other).alias("min"), F.greatest(low, other).alias("max"), raw.alias("raw")
            )
        top = F.when(~F.contains(raw, F.lit("+")), low + 4.0)
        return F.struct(low.alias("min"), top.alias("max"), raw.alias("raw"))

    low = F.lower(text)
    snippets = F.array(*[_extract(text, low, p, ["year", "yr"]) for p in patterns])
    return let(snippets, lambda found: _first_of(found, patterns, build))


def midpoint(low: Column, high: Column) -> Column:
    """X4b."""
    return F.coalesce((low + high) / 2.0, low)


def salary(text: Column) -> Column:
    """``struct<min, max>``; a single amount v stands for v to 1.5 v."""

    def build(i: int, pattern: str, raw: Column) -> Column:
        low = _number(raw, pattern, 1)
        high = _number(raw, pattern, 2) if i < 2 else low * 1.5
        return F.struct(low.alias("min"), high.alias("max"))

    low = F.lower(text)
    snippets = F.array(*[_extract(text, low, p, ["lpa", "lakh"]) for p in vocab.SALARY_PATTERNS])
    return let(snippets, lambda found: _first_of(found, vocab.SALARY_PATTERNS, build))


# --- seniority --------------------------------------------------------------------------


def stated_seniority(low: Column) -> Column:
    """``struct<level, confidence>`` of the most confident phrase, the earlier level on ties."""
    options = [
        F.when(
            has_any_substring(low, phrases) & low.rlike(whole_words(phrases)),
            F.struct(F.lit(-confidence).alias("minus"), F.lit(i).alias("at"), F.lit(level).alias("level")),
        )
        for i, (level, confidence, phrases) in enumerate(vocab.SENIORITY_PHRASES)
    ]
    best = F.array_min(F.array_compact(F.array(*options)))
    return F.struct(
        F.coalesce(best["level"], F.lit("unknown")).alias("level"),
        F.coalesce(-best["minus"], F.lit(0.0)).alias("confidence"),
    )


def reconciled_seniority(stated: Column, low: Column, high: Column) -> Column:
    """Inferred from the years where no phrase says it, else doubted when the years disagree."""
    middle = midpoint(low, high)
    years = F.when(middle == 0, low).otherwise(middle)
    guess = F.lit(None)
    for up_to, level, confidence in reversed(vocab.INFERRED_SENIORITY):
        answer = F.struct(F.lit(level).alias("level"), F.lit(confidence).alias("confidence"))
        guess = answer if up_to is None else F.when(
            (years == 0) if up_to == 0 else (years <= up_to), answer
        ).otherwise(guess)
    outside = F.lit(False)
    for level, (least, most) in vocab.SENIORITY_YEARS.items():
        outside = outside | ((stated["level"] == level) & ~years.between(least, most))
    doubted = F.struct(
        stated["level"].alias("level"),
        F.round(
            F.when(outside, F.greatest(stated["confidence"] - 0.10, F.lit(0.40))).otherwise(stated["confidence"]), 2
        ).alias("confidence"),
    )
    return F.when(low.isNull(), stated).when(stated["level"] == "unknown", guess).otherwise(doubted)


# --- lists of phrases -----------------------------------------------------------------------


def industries(low: Column) -> Column:
    """Industries one of whose words occurs, in list order."""
    return F.array_compact(
        F.array(*[F.when(has_any_substring(low, found), F.lit(name)) for name, found in vocab.INDUSTRY_WORDS.items()])
    )


def location(low: Column, longest_match: bool = False) -> Column:
    """``struct<city, country, work_mode, relocation_offered, visa_sponsorship>``.

    The first known city in list order wins, so a name that contains an earlier one is never
    found; ``longest_match`` tries longer names first.
    """
    cities = list(vocab.CITIES.items())
    if longest_match:
        cities.sort(key=lambda item: -len(item[0]))
    place = F.lit(None).cast("struct<city:string,country:string>")
    for spelling, (city, country) in reversed(cities):
        place = F.when(
            F.contains(low, F.lit(spelling)), F.struct(F.lit(city).alias("city"), F.lit(country).alias("country"))
        ).otherwise(place)
    by_word = F.lit(None).cast("string")
    for spelling, country in reversed(vocab.COUNTRIES.items()):
        named = F.contains(low, F.lit(spelling)) & low.rlike(whole_words([spelling]))
        by_word = F.when(named, F.lit(country)).otherwise(by_word)
    mode = F.lit("unknown")
    for name, phrases in reversed(vocab.WORK_MODE_PHRASES.items()):
        mode = F.when(has_any_substring(low, phrases), F.lit(name)).otherwise(mode)
    return F.struct(
        place["city"].alias("city"),
        F.coalesce(place["country"], by_word).alias("country"),
        mode.alias("work_mode"),
        has_any_substring(low, vocab.RELOCATION_PHRASES).alias("relocation_offered"),
        has_any_substring(low, vocab.VISA_PHRASES).alias("visa_sponsorship"),
    )


STARTUP_FLAGS = [
    "is_startup", "fast_paced", "ownership_culture", "equity_mentioned", "flat_hierarchy", "scrappy_culture",
]


def startup_signals(low: Column) -> Column:
    """Flags, the last funding stage in list order, and the phrases found."""
    rows = [{"phrase": p, "flag": f, "stage": s} for p, (f, s) in vocab.STARTUP_PHRASES.items()]
    phrases = _records(rows, "phrase:string,flag:string,stage:string")
    hits = let(low, lambda text: F.filter(phrases, lambda x: F.contains(text, x["phrase"])))

    def summary(found: Column) -> Column:
        flags = F.transform(found, lambda x: x["flag"])
        stages = F.filter(F.transform(found, lambda x: x["stage"]), lambda s: s.isNotNull())
        return F.struct(
            *[F.array_contains(flags, F.lit(name)).alias(name) for name in STARTUP_FLAGS],
            F.try_element_at(stages, F.lit(-1)).alias("funding_stage"),
            F.transform(found, lambda x: x["phrase"]).alias("signals"),
        )

    return let(hits, summary)


LEADERSHIP_FLAGS = ["requires_management", "hiring_manager", "cross_functional", "technical_lead", "strategy_ownership"]


#: A word that every match of the leadership pattern at the same position holds.
_LEADERSHIP_WORDS = [
    ["manage"], ["manage"], ["people"], ["people"], ["report"], ["team"], ["team"], ["report"], ["lead"], ["build"],
    ["grow"], ["hire", "hiring", "build"], ["cross"], ["work"], ["define"], ["technical"], ["drive"], ["tech"],
    ["lead"], ["mentor"],
]


def leadership_signals(text: Column, caps: Caps = CAPS) -> Column:
    """Flags, the range of direct reports (the last pattern that names one), and the first snippets."""
    patterns = [(f"(?i){pattern}", meaning) for pattern, meaning in vocab.LEADERSHIP_PATTERNS]

    def summary(found: Column) -> Column:
        low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
        flags = {name: F.lit(False) for name in LEADERSHIP_FLAGS}
        manages = F.lit(False)
        for i, (pattern, meaning) in enumerate(patterns):
            raw = F.get(found, F.lit(i))
            hit = raw != ""
            if meaning == "reports_range":
                a, b = _number(raw, pattern, 1, "int"), _number(raw, pattern, 2, "int")
                low, high = F.when(hit, F.least(a, b)).otherwise(low), F.when(hit, F.greatest(a, b)).otherwise(high)
                manages = manages | hit
            elif meaning == "min_reports":
                low = F.when(hit, _number(raw, pattern, 1, "int")).otherwise(low)
                manages = manages | hit
            else:
                flags[meaning] = flags[meaning] | hit
        flags["requires_management"] = flags["requires_management"] | manages | flags["technical_lead"]
        shown = F.transform(F.filter(found, lambda raw: raw != ""), lambda raw: _begin(raw, caps.snippet_chars))
        return F.struct(
            *[value.alias(name) for name, value in flags.items()],
            low.alias("min_direct_reports"),
            high.alias("max_direct_reports"),
            _first(shown, caps.snippets).alias("signals"),
        )

    low = F.lower(text)
    snippets = [
        _extract(text, low, pattern, needs)
        for (pattern, _), needs in zip(patterns, _LEADERSHIP_WORDS, strict=True)
    ]
    return let(F.array(*snippets), summary)


#: A word that every match of the negative pattern at the same position holds.
_NEGATIVE_WORDS = [
    ["fresher"], ["experience"], ["technical"], ["remote", "office", "onsite", "home"], ["immediate"], ["must"],
    ["gap"], ["looking"], ["remote", "wfh", "home"], ["notice"],
]


def negative_signals(text: Column, caps: Caps = CAPS) -> Column:
    """``array<struct<signal, category, raw>>`` in list order."""
    low = F.lower(text)
    entries = [
        F.struct(
            F.lit(label).alias("signal"), F.lit(category).alias("category"),
            _begin(_extract(text, low, f"(?i){pattern}", needs), caps.negative_chars).alias("raw"),
        )
        for (pattern, category, label), needs in zip(vocab.NEGATIVE_PATTERNS, _NEGATIVE_WORDS, strict=True)
    ]
    return F.filter(F.array(*entries), lambda x: x["raw"] != "")


def target_titles(text: Column, low: Column, caps: Caps = CAPS) -> Column:
    """X11: titles from the first lines, from "hiring a ...", from "role: ..." and from a known list."""
    lines = _first(
        F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda line: line != ""), caps.title_lines
    )
    heads = F.filter(
        lines,
        lambda line: F.length(line).between(6, 79)
        & ~line.rlike(r"[.,?@]")
        & line.rlike(f"(?i)(?:{'|'.join(vocab.TITLE_LINE_WORDS)})"),
    )

    def sized(found: Column) -> Column:
        return F.filter(found, lambda t: F.length(t).between(6, 69))

    def every(pattern: str, needs: list[str]) -> Column:
        matches = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))
        return F.when(has_any_substring(low, needs), matches).otherwise(F.array().cast("array<string>"))

    hiring = F.transform(
        every(vocab.HIRING_PATTERN, ["hiring", "looking for", "seeking", "recruiting"]),
        lambda t: F.regexp_replace(stripped(t), r"[,.]+$", ""),
    )
    role = F.transform(every(vocab.ROLE_PATTERN, ["role", "position", "title"]), stripped)
    known = let(low, lambda whole: F.filter(words(vocab.KNOWN_TITLES), lambda t: F.contains(whole, F.lower(t))))

    def distinct(titles: Column) -> Column:
        """The first of those that differ only in case."""
        return let(
            F.transform(titles, lambda t: F.lower(t)),
            lambda lowered: F.filter(titles, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1),
        )

    return _first(let(F.concat(heads, sized(hiring), sized(role), known), distinct), caps.titles)


# --- the whole description ------------------------------------------------------------------


def with_clean_text(jds: DataFrame, text_col: str = "text") -> DataFrame:
    """``clean``, ``low``, ``sentences`` and ``sections``."""
    return (
        jds.withColumn("clean", normalised(F.col(text_col)))
        .withColumn("low", F.lower("clean"))
        .withColumn("sentences", sentences(F.col("clean")))
        .withColumn("sections", sections(F.col("clean")))
    )


def with_roles(df: DataFrame, longest_match: bool = False, caps: Caps = CAPS) -> DataFrame:
    """X4-X12 over ``clean`` and ``low``."""
    clean, low = F.col("clean"), F.col("low")
    return (
        df.withColumn("experience", experience(clean))
        .withColumn("stated", stated_seniority(low))
        .withColumn(
            "seniority", reconciled_seniority(F.col("stated"), F.col("experience.min"), F.col("experience.max"))
        )
        .withColumn("industries", industries(low))
        .withColumn("location", location(low, longest_match))
        .withColumn("startup", startup_signals(low))
        .withColumn("leadership", leadership_signals(clean, caps))
        .withColumn("negatives", negative_signals(clean, caps))
        .withColumn("titles", target_titles(clean, low, caps))
        .withColumn("salary", salary(clean))
    )


def embedding_summary(caps: Caps = CAPS) -> Column:
    """The text a description is searched with."""
    joined = lambda c, n: F.array_join(_first(c, n), ", ")
    parts = F.array(
        _begin("clean", caps.summary_clean_chars),
        F.concat(F.lit("Required skills: "), joined("must_have_skills", caps.summary_must_have)),
        F.concat(F.lit("Nice-to-have: "), joined("nice_to_have_skills", caps.summary_nice_to_have)),
        F.concat(F.lit("Titles: "), joined("titles", caps.summary_titles)),
        F.concat(F.lit("Seniority: "), F.col("seniority.level")),
        F.concat(F.lit("Industries: "), joined("industries", caps.summary_industries)),
    )
    return _begin(F.array_join(F.filter(parts, lambda p: p != ""), " "), caps.summary_chars)


def parse_jds(jds: DataFrame, text_col: str = "text", match: str = "substring", longest_match: bool = False,
              skills: dict[str, list[str]] | None = None, caps: Caps = CAPS) -> DataFrame:
    """Every field of a parsed description, one row per description."""
    parsed = with_roles(with_skills(with_clean_text(jds, text_col), match, skills, caps), longest_match, caps)
    return (
        parsed.withColumn("summary_for_embedding", embedding_summary(caps))
        .withColumn("char_count", F.length("clean"))
        .withColumn("is_senior_role", F.col("seniority.level").isin(vocab.SENIOR_LEVELS))
        .withColumn("requires_management", F.col("leadership.requires_management"))
        .withColumn("sections", F.transform_values("sections", lambda _, v: _begin(v, caps.section_chars)))
        .drop("low", "sentences", "stated")
    )


def production_ml_flag() -> Column:
    """A production skill is named, or the text speaks of production and machine learning."""
    low = F.lower("clean")
    return F.arrays_overlap(
        F.transform("all_skills", F.lower), words(vocab.PRODUCTION_ML_SKILLS)
    ) | (F.contains(low, F.lit("production")) & F.contains(low, F.lit("machine learning")))


def requirements(parsed: DataFrame, id_col: str = "jd_id") -> DataFrame:
    """The flat hand-off that ranking works with."""
    return parsed.select(
        id_col,
        "must_have_skills",
        "nice_to_have_skills",
        F.col("nice_to_have_skills").alias("preferred_skills"),
        F.col("experience.min").alias("required_experience_min"),
        F.col("experience.max").alias("required_experience_max"),
        F.col("industries").alias("required_industries"),
        F.col("seniority.level").alias("seniority_level"),
        F.struct("leadership.requires_management", "leadership.technical_lead", "leadership.signals").alias(
            "leadership_requirements"
        ),
        F.struct("startup.is_startup", "startup.fast_paced", "startup.signals").alias("startup_requirements"),
        production_ml_flag().alias("production_ml_requirements"),
        F.transform("negatives", lambda x: x["signal"]).alias("negative_signals"),
        F.struct("location.city", "location.country").alias("location_requirements"),
        F.col("location.work_mode").alias("work_mode_requirements"),
        "titles",
        "summary_for_embedding",
    )
