"""Contradictions, implausible claims and other negative signals.

Each rule set is one array expression per row: no join, no shuffle, no Python on the data path.
Missing values take the documented defaults; a missing list counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions import rules as r
from shortlist.functions.arrays import (
    distinct_overlap,
    fields_of,
    has_any_element,
    has_any_substring,
    lowered,
    once,
    or_default,
    total,
)
from shortlist.functions.numbers import fixed


def with_rule_inputs(df: DataFrame) -> DataFrame:
    """Shared inputs, computed once per row in their own projection."""
    return df.select(
        "*",
        fields_of("skills", {"name": "string", "proficiency": "string", "endorsements": "int",
                             "duration_months": "int"}).alias("_skills"),
        fields_of("career_history", {"title": "string", "start_date": "string", "end_date": "string",
                                     "duration_months": "int"}).alias("_jobs"),
        fields_of("education", {"start_year": "int", "end_year": "int"}).alias("_schools"),
        lowered(F.col("profile.current_title")).alias("_title"),
        lowered(F.col("profile.summary")).alias("_summary"),
        or_default(F.col("profile.years_of_experience"), 0.0).alias("_years"),
    ).select(
        "*",
        F.transform("_skills", lambda s: lowered(s["name"])).alias("_names"),
        total(F.transform("_jobs", lambda j: or_default(j["duration_months"], 0))).alias("_months"),
    )


def _first(array: Column, condition) -> Column:
    return F.get(F.filter(array, condition), F.lit(0))


def _duration(skill: Column) -> Column:
    return or_default(skill["duration_months"], 0)


def _backwards(job: Column) -> Column:
    """Both dates readable from their first ten characters and the start after the end."""
    day = lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return (job["start_date"] != "") & (job["end_date"] != "") & (day(job["start_date"]) > day(job["end_date"]))


def contradiction_rules() -> list[r.Rule | r.EachRule]:
    title, years, months = F.col("_title"), F.col("_years"), F.col("_months")
    skills, jobs, schools, names = F.col("_skills"), F.col("_jobs"), F.col("_schools"), F.col("_names")
    has_ai = has_any_element(names, vocab.AI_SKILLS)
    advanced_ai = F.exists(
        skills, lambda s: lowered(s["name"]).isin(vocab.AI_SKILLS) & (or_default(s["proficiency"], "") == "advanced")
    )
    no_technical_job = ~F.exists(jobs, lambda j: has_any_substring(lowered(j["title"]), vocab.TECHNICAL_TITLE_WORDS))
    school_backwards = lambda e: (
        (e["start_year"] > 0) & (e["end_year"] > 0) & (e["start_year"] > e["end_year"])
    )
    beginner = lambda s: (or_default(s["proficiency"], "beginner") == "beginner") | (_duration(s) < 24)
    school, job = _first(schools, school_backwards), _first(jobs, _backwards)

    too_long = {"langchain": 36, "chatgpt": 48}

    def too_long_message(s: Column) -> Column:
        claimed = F.concat(F.lit("Unrealistic skill duration: Claimed "), _duration(s).cast("string"))
        return F.when(
            lowered(s["name"]) == "langchain",
            F.concat(claimed, F.lit(" months in LangChain (framework is newer than this).")),
        ).otherwise(F.concat(claimed, F.lit(" months in ChatGPT.")))

    def over_limit(s: Column) -> Column:
        name = lowered(s["name"])
        return ((name == "langchain") & (_duration(s) > too_long["langchain"])) | (
            (name == "chatgpt") & (_duration(s) > too_long["chatgpt"])
        )

    return [
        r.Rule("C1", 0.3, F.contains(title, F.lit("marketing")) & advanced_ai,
               F.lit("Anomalous skillset: Marketing title with advanced AI framework skills.")),
        r.Rule("C2", 0.4, has_any_substring(title, ["ai", "machine learning"]) & (F.size(jobs) > 0) & no_technical_job,
               F.lit("Contradictory career: AI title but previous roles are non-technical.")),
        r.Rule("C3", 0.3, (years > 0) & (months > 0) & (F.abs(years - months / 12.0) > 5.0),
               F.concat(F.lit("Unrealistic experience claim: Stated "), years.cast("string"),
                        F.lit(" YoE but career history adds up to "), fixed(months / 12.0, 1), F.lit(" YoE."))),
        r.EachRule("C4", 0.5, skills, over_limit, too_long_message),
        r.Rule("C5", 0.2, F.contains("_summary", F.lit("software engineer")) & F.contains(title, F.lit("recruiter")),
               F.lit("Contradictory summary: Summary implies software engineering while current title is recruiter.")),
        r.Rule("C6", 0.3, F.size(skills) > 60,
               F.concat(F.lit("Skill stuffing: Profile lists "), F.size(skills).cast("string"),
                        F.lit(" discrete skills, which is abnormally high."))),
        r.Rule("C7", 0.3, F.exists(schools, school_backwards),
               F.concat(F.lit("Education anomaly: Start year "), school["start_year"].cast("string"),
                        F.lit(" is after end year "), school["end_year"].cast("string"), F.lit("."))),
        r.Rule("C8", 0.3, F.exists(jobs, _backwards),
               F.concat(F.lit("Career anomaly: Job start date "), job["start_date"],
                        F.lit(" is after end date "), job["end_date"], F.lit("."))),
        r.Rule("C9", 0.2, has_any_element(names, vocab.UNRELATED_SKILLS) & has_ai,
               F.lit("Unrelated skill clusters: Profile combines highly technical AI skills with completely "
                     "unrelated manual/administrative skills.")),
        r.Rule("C10", 0.4, has_any_substring(title, vocab.SENIOR_TITLE_WORDS) & (F.size(skills) > 0)
               & F.forall(skills, beginner),
               F.lit("Contradictory seniority: Title implies Senior/Lead, but all listed skills are beginner "
                     "proficiency or < 2 years duration.")),
    ]


def honeypot_rules(as_of_year: int, views_field: str = "profile_views_received_30d") -> list[r.Rule | r.EachRule]:
    title, years, months = F.col("_title"), F.col("_years"), F.col("_months")
    skills, names = F.col("_skills"), F.col("_names")
    release = F.array(
        *[F.struct(F.lit(t).alias("tech"), F.lit(y).alias("year")) for t, y in vocab.TECH_RELEASE_YEARS.items()]
    )
    claims = F.flatten(
        F.transform(
            skills,
            lambda s: F.transform(
                F.filter(release, lambda t: F.contains(lowered(s["name"]), t["tech"])),
                lambda t: F.struct(lowered(s["name"]).alias("name"), _duration(s).alias("months"), t["year"].alias("year")),
            ),
        )
    )
    clusters = sum(
        ((distinct_overlap(names, cluster) >= 2).cast("int") for cluster in vocab.SKILL_CLUSTERS), F.lit(0)
    )
    buzz = distinct_overlap(names, vocab.AI_BUZZWORDS)
    rate = or_default(F.col("signals.recruiter_response_rate"), -1.0)
    views = or_default(F.col(f"signals.{views_field}"), -1.0) if views_field else F.lit(-1.0)
    return [
        r.EachRule("H1", 0.4, claims, lambda c: c["months"] / 12.0 > (as_of_year - c["year"] + 1),
                   lambda c: F.concat(F.lit("Impossible profile: Claimed "), fixed(c["months"] / 12.0, 1),
                                      F.lit(" years in "), c["name"], F.lit(", which only released in "),
                                      c["year"].cast("string"), F.lit("."))),
        r.Rule("H2", 0.3, has_any_substring(title, ["frontend", "ui "]) & ~has_any_element(names, vocab.FRONTEND_SKILLS),
               F.lit("Synthetic inconsistency: Frontend title with zero frontend skills.")),
        r.Rule("H3", 0.3, has_any_substring(title, ["backend", "back-end"]) & ~has_any_element(names, vocab.BACKEND_SKILLS),
               F.lit("Synthetic inconsistency: Backend title with zero backend skills.")),
        r.Rule("H4", 0.2, F.size(skills) > 75,
               F.concat(F.lit("Keyword stuffing: "), F.size(skills).cast("string"),
                        F.lit(" discrete skills is statistically improbable."))),
        r.Rule("H5", 0.3, (years >= 3) & (F.try_divide(F.size(skills), years) > 20),
               F.lit("Keyword stuffing: Claiming to master 20+ entirely new technologies every single year.")),
        r.Rule("H6", 0.2, (rate == 1.0) & (views > 1000) & (F.size(skills) > 50),
               F.lit("Behavioral anomaly: Perfect response rate with hyper-inflated views and skills (bot signature).")),
        r.Rule("H7", 0.3, (clusters >= 4) & (years < 7),
               F.lit("Unrealistically perfect: Claims mastery of multiple opposing framework clusters across full "
                     "stack and AI with low YoE.")),
        r.Rule("H8", 0.3, (months > 0) & (years > 0) & (years * 12 > months + 60),
               F.concat(F.lit("Contradictory employment: Profile claims "), years.cast("string"),
                        F.lit(" YoE, but career history only contains "), fixed(months / 12.0, 1),
                        F.lit(" years."))),
        r.Rule("H9", 0.5, (buzz >= 3) & ~has_any_element(names, vocab.AI_FOUNDATIONS),
               F.concat(F.lit("AI buzzword stuffing: Claimed "), buzz.cast("string"),
                        F.lit(" GenAI frameworks but zero foundational ML or Python skills."))),
    ]


def negative_rules() -> list[r.Rule]:
    skills, jobs = F.col("_skills"), F.col("_jobs")
    scores = F.coalesce(F.col("signals.skill_assessment_scores"), F.create_map().cast("map<string,double>"))
    mean_endorsements = F.coalesce(
        F.try_divide(total(F.transform(skills, lambda s: or_default(s["endorsements"], 0))), F.size(skills)), F.lit(0.0)
    )
    unverified = F.size(
        F.filter(
            skills,
            lambda s: (s["proficiency"] == "expert")
            & (or_default(s["endorsements"], 0) == 0)
            & ~F.map_contains_key(scores, or_default(s["name"], "")),
        )
    )
    completeness = or_default(F.col("signals.profile_completeness_score"), 100.0)
    notice = or_default(F.col("signals.notice_period_days"), 60)
    tenure = F.try_divide(F.col("_months"), F.size(jobs))
    return [
        r.Rule("N1", 0.10, (F.size(skills) > 15) & (mean_endorsements < 2) & (F.size(scores) == 0),
               F.concat(F.lit("Possible keyword stuffing: "), F.size(skills).cast("string"),
                        F.lit(" skills, avg endorsements="), fixed(mean_endorsements, 1))),
        r.Rule("N2", 0.08, unverified > 3, F.concat(unverified.cast("string"), F.lit(" unverified 'expert' skills"))),
        r.Rule("N3", 0.05, completeness < 30,
               F.concat(F.lit("Very low profile completeness: "), fixed(completeness, 0), F.lit("%"))),
        r.Rule("N4", 0.02, ~or_default(F.col("signals.open_to_work_flag"), True), F.lit("Not marked as open to work")),
        r.Rule("N5", 0.03, notice > 120,
               F.concat(F.lit("Long notice period: "), notice.cast("string"), F.lit(" days"))),
        r.Rule("N6", 0.05, (F.size(jobs) >= 5) & (tenure < 6),
               F.concat(F.lit("High job hopping: avg tenure "), fixed(tenure, 0), F.lit(" months"))),
    ]


def _scored(df: DataFrame, parts: dict[str, tuple[list, float]]) -> DataFrame:
    """Add hit arrays, then scores and messages, for each named rule set."""
    out = once(with_rule_inputs(df), **{f"_{name}": r.all_hits(rules) for name, (rules, _) in parts.items()})
    columns = []
    for name, (_, cap) in parts.items():
        hits = F.col(f"_{name}")
        columns += [
            r.capped_score(hits, cap).alias(_SCORES[name]),
            r.hit_codes(hits).alias(f"{name}_codes"),
            r.hit_messages(hits).alias(f"{name}_reasons"),
        ]
    return out.select(*[c for c in df.columns], *columns)


_SCORES = {"contradiction": "contradiction_score", "honeypot": "honeypot_probability", "negative": "penalty"}


def with_contradictions(candidates: DataFrame) -> DataFrame:
    """``contradiction_score`` in 0..1 with codes and reasons."""
    return _scored(candidates, {"contradiction": (contradiction_rules(), 1.0)})


def with_honeypots(
    candidates: DataFrame, as_of_year: int, views_field: str = "profile_views_received_30d"
) -> DataFrame:
    """R2: ``honeypot_probability`` in 0..1 with codes and reasons.

    ``as_of_year`` is a parameter so that a result does not change with the calendar. An empty
    ``views_field`` stands for input that has no such count.
    """
    return _scored(candidates, {"honeypot": (honeypot_rules(as_of_year, views_field), 1.0)})


def with_negative_signals(candidates: DataFrame) -> DataFrame:
    """``penalty`` in 0..0.35 with codes and flags."""
    return _scored(candidates, {"negative": (negative_rules(), 0.35)})


def with_fraud_scores(
    candidates: DataFrame, as_of_year: int, views_field: str = "profile_views_received_30d"
) -> DataFrame:
    """R1 and R2 in one pass over shared inputs."""
    return _scored(
        candidates,
        {"contradiction": (contradiction_rules(), 1.0), "honeypot": (honeypot_rules(as_of_year, views_field), 1.0)},
    )


def passes_gate(threshold: float = 0.3) -> Column:
    """neither fraud score reaches the threshold."""
    return (F.col("contradiction_score") < threshold) & (F.col("honeypot_probability") < threshold)


def fraud_gate(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.where(passes_gate(threshold))
