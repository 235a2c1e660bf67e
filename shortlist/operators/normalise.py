"""Nested candidates to six flat tables (P1-P8). Narrow projections and explodes, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.arrays import total

_PLAIN_SIGNALS = [
    "profile_completeness_score", "signup_date", "last_active_date", "open_to_work_flag",
    "profile_views_received_30d", "applications_submitted_30d", "recruiter_response_rate",
    "avg_response_time_hours", "connection_count", "endorsements_received", "notice_period_days",
]
_MORE_SIGNALS = [
    "preferred_work_mode", "willing_to_relocate", "github_activity_score", "search_appearance_30d",
    "saved_by_recruiters_30d", "interview_completion_rate", "offer_acceptance_rate", "verified_email",
    "verified_phone", "linkedin_connected",
]
_PROFILE = [
    "anonymized_name", "headline", "summary", "location", "country", "years_of_experience", "current_title",
    "current_company", "current_company_size", "current_industry",
]


def average_assessment(scores: Column) -> Column:
    """Mean of the assessment scores, -1 where there are none."""
    values = F.map_values(scores)
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(-1.0))


def retrieval_text(
    summary_chars: int | None = 500, skill_count: int | None = 20, job_count: int | None = 2, text_chars: int | None = 2000
) -> Column:
    """The text a candidate is found by; ``None`` leaves a part whole."""
    first = lambda c, n: F.col(c) if n is None else F.slice(c, 1, n)
    begin = lambda c, n: c if n is None else F.substring(c, 1, n)
    parts = F.array(
        F.col("profile.headline"),
        begin(F.col("profile.summary"), summary_chars),
        F.col("profile.current_title"),
        F.col("profile.current_industry"),
        F.array_join(F.transform(first("skills", skill_count), lambda s: s["name"]), " "),
        F.array_join(F.transform(first("career_history", job_count), lambda j: j["description"]), " "),
    )
    return begin(F.array_join(F.filter(parts, lambda p: p != ""), " "), text_chars)


def whole_texts(candidates: DataFrame) -> DataFrame:
    """P8 without its cuts, under the column name of the stored text."""
    return candidates.select("candidate_id", retrieval_text(None, None, None, None).alias("embedding_text"))


def profiles(candidates: DataFrame) -> DataFrame:
    """One row per candidate, 38 columns."""
    return candidates.select(
        "candidate_id",
        *[F.col(f"profile.{c}").alias(c) for c in _PROFILE],
        F.size("certifications").cast("smallint").alias("cert_count"),
        F.size("skills").cast("smallint").alias("skill_count"),
        *[F.col(f"signals.{c}").alias(c) for c in _PLAIN_SIGNALS],
        F.col("signals.expected_salary_range_inr_lpa.min").alias("salary_min_lpa"),
        F.col("signals.expected_salary_range_inr_lpa.max").alias("salary_max_lpa"),
        *[F.col(f"signals.{c}").alias(c) for c in _MORE_SIGNALS],
        average_assessment(F.col("signals.skill_assessment_scores")).alias("avg_assessment_score"),
        retrieval_text().alias("embedding_text"),
    )


def skills(candidates: DataFrame) -> DataFrame:
    """One row per listed skill; the assessment is looked up by the exact name, -1 if absent."""
    score = F.coalesce(F.try_element_at("scores", F.col("s.name")), F.lit(-1.0))
    return candidates.select(
        "candidate_id", F.col("signals.skill_assessment_scores").alias("scores"), F.explode("skills").alias("s")
    ).select(
        "candidate_id", F.col("s.name").alias("skill_name"), "s.proficiency", "s.endorsements",
        "s.duration_months", score.alias("assessment_score"),
    )


def education(candidates: DataFrame) -> DataFrame:
    """P3."""
    return candidates.select("candidate_id", F.explode("education").alias("e")).select(
        "candidate_id", "e.institution", "e.degree", "e.field_of_study",
        F.col("e.start_year").cast("smallint").alias("start_year"),
        F.col("e.end_year").cast("smallint").alias("end_year"),
        F.coalesce("e.grade", F.lit("")).alias("grade"), "e.tier",
    )


def career_history(candidates: DataFrame) -> DataFrame:
    """``job_order`` is the position in the stored list."""
    return candidates.select("candidate_id", F.posexplode("career_history").alias("job_order", "j")).select(
        "candidate_id", "j.company", "j.title", "j.start_date", F.coalesce("j.end_date", F.lit("")).alias("end_date"),
        "j.duration_months", "j.is_current", "j.industry", "j.company_size", "j.description",
        F.col("job_order").cast("tinyint").alias("job_order"),
    )


def certifications(candidates: DataFrame) -> DataFrame:
    """P5."""
    return candidates.select("candidate_id", F.explode("certifications").alias("c")).select(
        "candidate_id", F.col("c.name").alias("cert_name"), "c.issuer", F.col("c.year").cast("smallint").alias("year")
    )


def languages(candidates: DataFrame) -> DataFrame:
    """P6."""
    return candidates.select("candidate_id", F.explode("languages").alias("l")).select(
        "candidate_id", "l.language", "l.proficiency"
    )


NORMALISERS = {
    "profiles": profiles,
    "skills": skills,
    "education": education,
    "career_history": career_history,
    "certifications": certifications,
    "languages": languages,
}


def six_tables(candidates: DataFrame) -> dict[str, DataFrame]:
    return {name: build(candidates) for name, build in NORMALISERS.items()}
