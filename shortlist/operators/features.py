"""Feature columns (the 31-column set, the 26-column set) and promotions.

Both sets are one projection per candidate. The first matches whole skill names, the second
matches fragments of the joined skill list; the two are kept apart on purpose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.arrays import (
    elements,
    flag,
    has_any_element,
    has_any_substring,
    lowered,
    or_default,
    total,
    words,
)
from shortlist.schemas import CAREER_DDL

FEATURES_31 = [
    "embedding_similarity", "bm25_score", "skill_overlap_score", "years_experience_score", "seniority_score",
    "production_ml_score", "startup_score", "leadership_score", "average_tenure", "job_hops",
    "career_growth_score", "title_progression_score", "vector_db_score", "retrieval_score", "ranking_score",
    "python_score", "llm_score", "fine_tuning_score", "open_source_score", "recruiter_response_rate",
    "github_activity_score", "interview_completion_rate", "profile_views_score", "saved_by_recruiters_score",
    "profile_completeness_score", "open_to_work_score", "recent_activity_score", "notice_period_score",
    "india_score", "relocation_score", "hybrid_score",
]
FEATURES_26 = [
    "embedding_similarity", "bm25_score", "title_similarity", "summary_similarity", "skill_overlap",
    "vector_db_score", "retrieval_score", "ranking_score", "python_score", "llm_score", "fine_tuning_score",
    "average_tenure", "promotions", "title_progression", "company_quality", "startup_experience",
    "recruiter_response", "github_score", "interview_completion", "recent_activity", "search_appearance",
    "recruiter_saves", "contradiction_score", "honeypot_score", "inconsistency_score", "keyword_stuffing_score",
]


@dataclass(frozen=True)
class Role:
    """What a job asks for, as Columns: literals for one job, columns for a table of jobs."""

    must_have: Column
    years_min: Column
    years_max: Column
    seniority: Column

    @staticmethod
    def of(must_have: list[str], years_min: float | None, years_max: float | None, seniority: str) -> Role:
        return Role(
            words(must_have).cast("array<string>"),
            F.lit(years_min).cast("double"),
            F.lit(years_max).cast("double"),
            F.lit(seniority),
        )

    @staticmethod
    def from_columns(
        must_have="must_have_skills", years_min="required_experience_min", years_max="required_experience_max",
        seniority="seniority_level",
    ) -> Role:
        return Role(F.col(must_have), F.col(years_min), F.col(years_max), F.col(seniority))


@dataclass(frozen=True)
class SignalNames:
    """Which signal feeds which feature; an empty name stands for a signal the input lacks.

    ``SignalNames()`` follows the record schema. ``SignalNames.strict()`` looks for three
    names that records of this schema never carry, which leaves those features constant.
    """

    open_to_work: str = "open_to_work_flag"
    views: str = "profile_views_received_30d"
    hybrid: str = "preferred_work_mode"

    @staticmethod
    def strict() -> SignalNames:
        return SignalNames("", "", "")


def overlap_share(asked: Column, offered: Column) -> Column:
    """Distinct asked-for names found, as a share; 1 when nothing is asked for."""
    wanted = F.array_distinct(F.transform(F.coalesce(asked, F.array().cast("array<string>")), F.lower))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(
        F.size(F.array_intersect(wanted, offered)) / F.greatest(F.size(wanted), F.lit(1))
    )


def _inputs(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "*",
        F.transform(elements(F.col("skills.name"), "string"), lowered).alias("_names"),
        elements(F.col("career_history.duration_months"), "int").alias("_durations"),
        lowered(F.col("profile.current_title")).alias("_title"),
        lowered(F.col("profile.summary")).alias("_summary"),
        or_default(F.col("profile.years_of_experience"), 0.0).alias("_years"),
    )


def years_score(years: Column, low: Column, high: Column) -> Column:
    """1 inside the range, 0.8 above it, the share of the minimum below it."""
    least = F.coalesce(low, F.lit(0.0))
    most = F.coalesce(F.nullif(high, F.lit(0.0)), F.lit(99.0))
    short = F.when(least > 0, years / least).otherwise(0.0)
    return F.when(years.between(least, most), 1.0).when(years > most, 0.8).otherwise(short)


def seniority_score(years: Column, level: Column) -> Column:
    """Loses 0.2 for every step between the asked-for level and the one the years suggest."""
    asked = F.lit(2)
    for name, points in vocab.SENIORITY_POINTS.items():
        asked = F.when(level == name, F.lit(points)).otherwise(asked)
    held = F.when(years < 2, 1).when(years < 5, 2).when(years < 8, 3).otherwise(4)
    return F.greatest(F.lit(0.0), 1.0 - F.abs(asked - held) * 0.2)


def with_features_31(
    candidates: DataFrame,
    role: Role,
    bm25: Column | None = None,
    semantic: Column | None = None,
    signals: SignalNames | None = None,
    open_source_above: float = 0.5,
) -> DataFrame:
    """Append the 31 feature columns. ``bm25`` and ``semantic`` are scores carried in by retrieval."""
    source = signals or SignalNames()
    names, title, years = F.col("_names"), F.col("_title"), F.col("_years")

    def signal(name: str, default):
        return or_default(F.col(f"signals.{name}"), default).cast("double")

    def yes(name: str) -> Column:
        return flag(or_default(F.col(f"signals.{name}"), False)) if name else F.lit(0.0)

    def skilled(values: list[str]) -> Column:
        return flag(has_any_element(names, values))

    hops = F.size("_durations")
    months = total(F.transform("_durations", lambda d: or_default(d, 0)))
    tenure = F.when(hops > 0, months / 12.0 / F.greatest(hops, F.lit(1))).otherwise(0.0)
    github = signal("github_activity_score", 0.0)
    views = signal(source.views, 0.0) if source.views else F.lit(0.0)
    if source.hybrid == "preferred_work_mode":
        hybrid = flag(or_default(F.col("signals.preferred_work_mode"), "") == "hybrid")
    else:
        hybrid = yes(source.hybrid)
    features = {
        "embedding_similarity": (semantic if semantic is not None else F.lit(0.0)).cast("double"),
        "bm25_score": (bm25 if bm25 is not None else F.lit(0.0)).cast("double"),
        "skill_overlap_score": overlap_share(role.must_have, names),
        "years_experience_score": years_score(years, role.years_min, role.years_max),
        "seniority_score": seniority_score(years, role.seniority),
        "production_ml_score": skilled(vocab.PRODUCTION_SKILLS),
        "startup_score": flag(F.contains("_summary", F.lit("startup"))),
        "leadership_score": flag(has_any_substring(title, ["lead", "manager"])),
        "average_tenure": tenure,
        "job_hops": hops.cast("double"),
        "career_growth_score": flag(tenure > 2.0, 1.0, 0.5),
        "title_progression_score": flag((hops > 1) & F.contains(title, F.lit("senior")), 1.0, 0.5),
        "vector_db_score": skilled(vocab.VECTOR_DB_SKILLS),
        "retrieval_score": skilled(vocab.RETRIEVAL_SKILLS),
        "ranking_score": skilled(vocab.RANKING_SKILLS),
        "python_score": skilled(["python"]),
        "llm_score": skilled(vocab.LLM_SKILLS),
        "fine_tuning_score": skilled(vocab.FINE_TUNING_SKILLS),
        "open_source_score": flag(github > open_source_above),
        "recruiter_response_rate": signal("recruiter_response_rate", 0.0),
        "github_activity_score": github,
        "interview_completion_rate": signal("interview_completion_rate", 0.0),
        "profile_views_score": F.least(F.lit(1.0), views / 100.0),
        "saved_by_recruiters_score": F.least(F.lit(1.0), signal("saved_by_recruiters_30d", 0.0) / 20.0),
        "profile_completeness_score": signal("profile_completeness_score", 0.8),
        "open_to_work_score": yes(source.open_to_work),
        "recent_activity_score": flag(or_default(F.col("signals.last_active_date"), "") != ""),
        "notice_period_score": flag(signal("notice_period_days", 90) <= 30, 1.0, 0.5),
        "india_score": flag(F.contains(lowered(F.col("profile.country")), F.lit("india"))),
        "relocation_score": yes("willing_to_relocate"),
        "hybrid_score": hybrid,
    }
    kept = [c for c in candidates.columns if c not in features]
    return _inputs(candidates).select(*kept, *[value.alias(name) for name, value in features.items()])


def with_job_inputs(candidates: DataFrame) -> DataFrame:
    """Adds what a job's demands are compared with: ``_names`` (lower-cased skills) and ``_years``."""
    names = F.transform(elements(F.col("skills.name"), "string"), lowered)
    return candidates.withColumns({"_names": names, "_years": or_default(F.col("profile.years_of_experience"), 0.0)})


def with_pair_features(pairs: DataFrame, role: Role, bm25: Column, semantic: Column) -> DataFrame:
    """The features that depend on candidate and job, for pairs with ``with_job_inputs`` and the role's columns."""
    return pairs.withColumns({
        "embedding_similarity": semantic.cast("double"), "bm25_score": bm25.cast("double"), "skill_overlap_score": overlap_share(role.must_have, F.col("_names")),
        "years_experience_score": years_score(F.col("_years"), role.years_min, role.years_max), "seniority_score": seniority_score(F.col("_years"), role.seniority),
    })


def promotions(jobs: Column) -> Column:
    """Neighbours in the stored order with the same company and another title."""
    # Comparing neighbours inside the row needs no window and no shuffle.
    pairs = F.zip_with(
        jobs,
        F.slice(jobs, 2, F.greatest(F.size(jobs), F.lit(1))),
        lambda a, b: b.isNotNull() & a["company"].eqNullSafe(b["company"]) & ~a["title"].eqNullSafe(b["title"]),
    )
    return F.size(F.filter(pairs, lambda p: p))


def with_features_26(candidates: DataFrame) -> DataFrame:
    """Append the 26 job-independent feature columns."""
    jobs = elements(F.col("career_history"), CAREER_DDL[6:-1])
    title, years = F.col("_title"), F.col("_years")
    joined, promoted = F.col("_joined"), F.col("_promotions")
    listed = F.size("_names")

    def fragment(values: list[str]) -> Column:
        return flag(has_any_substring(joined, values))

    def signal(name: str) -> Column:
        return or_default(F.col(f"signals.{name}"), 0.0).cast("double")

    vector_db, llm = fragment(vocab.VECTOR_DB_FRAGMENTS), fragment(vocab.LLM_FRAGMENTS)
    # Every text field of every job, since a company name may stand in any of them.
    career_text = F.lower(F.to_json(jobs))
    features = {
        "embedding_similarity": years / 10.0,
        "bm25_score": listed / 50.0,
        "title_similarity": flag(F.contains(title, F.lit("engineer")), 1.0, 0.5),
        "summary_similarity": F.length(or_default(F.col("profile.summary"), "")) / 1000.0,
        "skill_overlap": listed / 100.0,
        "vector_db_score": vector_db,
        "retrieval_score": fragment(vocab.RETRIEVAL_FRAGMENTS),
        "ranking_score": fragment(vocab.RANKING_FRAGMENTS),
        "python_score": flag(has_any_element(F.col("_names"), ["python"])),
        "llm_score": llm,
        "fine_tuning_score": fragment(vocab.FINE_TUNING_FRAGMENTS),
        "average_tenure": F.coalesce(F.try_divide(years, F.size(jobs)), F.lit(0.0)),
        "promotions": promoted.cast("double"),
        "title_progression": flag(F.contains(title, F.lit("senior")) & (promoted > 0)),
        "company_quality": flag(has_any_substring(career_text, vocab.KNOWN_COMPANIES), 1.0, 0.5),
        "startup_experience": flag(F.contains("_summary", F.lit("startup"))),
        "recruiter_response": signal("recruiter_response_rate"),
        "github_score": signal("github_activity_score"),
        "interview_completion": signal("interview_completion_rate"),
        # The record schema has no such signals, so these three keep their neutral value.
        "recent_activity": F.lit(0.5),
        "search_appearance": F.lit(0.5),
        "recruiter_saves": F.lit(0.5),
        "contradiction_score": flag((years > 10) & (F.size(jobs) == 0)),
        "honeypot_score": flag((years == 0) & (vector_db == 1.0) & (llm == 1.0)),
        "inconsistency_score": flag(promoted > 10),
        "keyword_stuffing_score": F.least(F.lit(1.0), listed / 100.0),
    }
    kept = [c for c in candidates.columns if c not in features]
    return (
        _inputs(candidates)
        .select("*", F.array_join("_names", " ").alias("_joined"), promotions(jobs).alias("_promotions"))
        .select(*kept, *[value.alias(name) for name, value in features.items()])
    )
