"""The whole ranking, from a job to an explained top list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.numbers import exact_round
from shortlist.operators import features as feat
from shortlist.operators import ranking, retrieval, scoring, screening
from shortlist.operators.ltr import predict_or_weighted
from shortlist.session import staged


@dataclass(frozen=True)
class Settings:
    """Depths, thresholds and weights of a ranking run."""

    as_of_year: int
    retrieve: int = 1000
    top: int = 100
    fraud_threshold: float = 0.3
    weights: scoring.Weights = scoring.Weights()
    stage_text_scores: bool = False


def screened_features(candidates: DataFrame, retrieved: DataFrame, role: feat.Role, settings: Settings) -> DataFrame:
    """J4, F7 and the 31 features for retrieved candidates.

    ``retrieved`` has at most ``settings.retrieve`` rows of ids and three numbers, so it is
    broadcast and the candidate table is neither shuffled nor sorted. Rules run before features,
    and both only for retrieved candidates.
    """
    met = candidates.join(F.broadcast(retrieved), "candidate_id")
    passed = screening.fraud_gate(screening.with_fraud_scores(met, settings.as_of_year), settings.fraud_threshold)
    return feat.with_features_31(passed, role, F.col("bm25_norm"), F.col("semantic_score"))


def score_and_rank(featured: DataFrame, settings: Settings, model: Model | None = None) -> DataFrame:
    """Score to four places, order, cut, number; features as one struct."""
    scored = predict_or_weighted(model, featured, feat.FEATURES_31, settings.weights)
    shaped = scored.select(
        "candidate_id",
        exact_round(F.col("score"), 4).alias("score"),
        F.struct(*feat.FEATURES_31).alias("feature_breakdown"),
    )
    return ranking.ranked(shaped, settings.top).select("candidate_id", "rank", "score", "feature_breakdown")


def rank_candidates(
    candidates: DataFrame, texts: DataFrame, vectors: DataFrame, query: str, query_vector: Column, role: feat.Role,
    settings: Settings, model: Model | None = None, text_col: str = "embedding_text",
) -> DataFrame:
    """Retrieve, look up, screen, featurise, score, cut. An empty result is possible.

    ``texts`` and ``vectors`` hold what is searched, keyed by candidate; ``query`` is the text
    of the job and ``query_vector`` its vector.
    """
    retrieved = retrieval.hybrid_topk(
        texts, vectors, query, query_vector, settings.retrieve, text_col=text_col, stage=settings.stage_text_scores
    )
    return score_and_rank(screened_features(candidates, retrieved, role, settings), settings, model)


#: Features that compare a candidate with the job; the others are computed once per candidate.
PAIR_FEATURES = ["embedding_similarity", "bm25_score", "skill_overlap_score", "years_experience_score", "seniority_score"]


def rank_jobs(
    candidates: DataFrame, texts: DataFrame, vectors: DataFrame, jobs: DataFrame, settings: Settings, model: Model | None = None,
    text_col: str = "embedding_text", job_id: str = "jd_id",
) -> DataFrame:
    """R6 for a table of parsed jobs: ``(job, rank, candidate, score, feature_breakdown)``, the best of every job.

    ``jobs`` has what ``jd.requirements`` returns and ``query_vector``; its ids are unique. Retrieval gives at most
    ``settings.retrieve`` pairs a job, and nothing else pairs jobs with people. Whoever was retrieved for any job is screened
    once, and the features that ask nothing of the job are computed once, both before the pairs are made; a pair
    carries numbers and skill names, never the nested record. Of every job each task sends on no more than the asked-for top.
    """
    queries = jobs.select(F.col(job_id).alias("query_id"), F.col("summary_for_embedding").alias("query_text"), "query_vector")
    met = retrieval.hybrid_batch(texts, vectors, queries, settings.retrieve, text_col=text_col)
    met = staged(met.select("query_id", "candidate_id", "bm25_norm", "semantic_score"), "job-pairs")
    wanted = candidates.join(met.select("candidate_id").distinct(), "candidate_id", "left_semi")
    passed = screening.fraud_gate(screening.with_fraud_scores(wanted, settings.as_of_year), settings.fraud_threshold)
    own = [f for f in feat.FEATURES_31 if f not in PAIR_FEATURES]
    people = feat.with_job_inputs(feat.with_features_31(passed, feat.Role.of([], None, None, ""))).select("candidate_id", "_names", "_years", *own)
    asked = jobs.select(F.col(job_id).alias("query_id"), "must_have_skills", "required_experience_min", "required_experience_max", "seniority_level")
    pairs = met.join(staged(people, "job-people"), "candidate_id").join(asked, "query_id")
    featured = feat.with_pair_features(pairs, feat.Role.from_columns(), F.col("bm25_norm"), F.col("semantic_score"))
    scored = predict_or_weighted(model, featured, feat.FEATURES_31, settings.weights)
    shaped = scored.select("query_id", "candidate_id", exact_round(F.col("score"), 4).alias("score"), F.struct(*feat.FEATURES_31).alias("feature_breakdown"))
    best = retrieval.best_per_query(shaped, "score", "candidate_id", settings.top)
    return best.select(F.col("query_id").alias(job_id), "rank", "candidate_id", "score", "feature_breakdown")


#: The nested parts of a record.
RECORD = ["profile", "career_history", "education", "skills", "certifications", "languages", "signals"]


def shown(candidates: DataFrame) -> DataFrame:
    """R3 and what a ranked list shows of a candidate, in place of the nested record, so that no later join or sort moves that."""
    flagged = screening.with_negative_signals(candidates)
    return flagged.select(
        *[c for c in flagged.columns if c not in RECORD],
        F.col("profile.current_title").alias("title"),
        F.col("profile.anonymized_name").alias("name"),
        F.col("profile.headline").alias("headline"),
        F.col("profile.years_of_experience").alias("years_of_experience"),
        F.col("profile.location").alias("location"),
        F.col("profile.country").alias("country"),
        scoring.top_skills(F.col("skills")).alias("top_skills"),
        F.transform("skills", lambda s: s["name"]).alias("skill_names"),
        F.col("signals.recruiter_response_rate").alias("response_rate"),
        F.col("signals.open_to_work_flag").alias("open_to_work"),
        F.col("signals.notice_period_days").alias("notice_period_days"),
    )


def reasoning() -> Column:
    """R9 over the columns of ``shown`` and ``matched`` (skills found)."""
    return scoring.reasoning_text(
        F.col("title"), F.col("years_of_experience"), F.col("matched"), F.col("response_rate"), F.col("open_to_work"), F.col("negative_reasons")
    )


def rank_with_components(
    candidates: DataFrame, weights: scoring.Weights | None = None, n: int = 100
) -> DataFrame:
    """Rank by penalised component scores, with reason, top skills, factors and flags.

    Needs the six component columns and ``matched`` (skills found), next to the nested record.
    """
    return rank_shown(shown(candidates), weights, n)


def rank_shown(listed: DataFrame, weights: scoring.Weights | None = None, n: int = 100) -> DataFrame:
    """``rank_with_components`` for the columns of ``shown`` with the components and ``matched``."""
    # Six places, because the order of equal scores is decided by the id.
    top = ranking.ranked(listed.withColumn("score", exact_round(scoring.penalised_score(weights), 6)), n)
    return top.select(
        "candidate_id",
        "rank",
        "score",
        reasoning().alias("reasoning"),
        F.struct(
            *[scoring.component(column).alias(column) for column, _ in scoring.COMPONENTS.values()],
            "penalty",
            F.col("score").alias("total_score"),
        ).alias("breakdown"),
        scoring.top_factors(weights).alias("factors"),
        F.col("negative_reasons").alias("flags"),
        "title",
        "name",
        "headline",
        "years_of_experience",
        "location",
        "country",
        "top_skills",
        "skill_names",
        "open_to_work",
        "notice_period_days",
    )


def components(featured: DataFrame) -> DataFrame:
    """The six component scores from the 31 features, for ``rank_with_components``."""
    return featured.select(
        "*",
        ((F.col("production_ml_score") + F.col("skill_overlap_score")) / 2).alias("skill_score"),
        F.col("embedding_similarity").alias("semantic_score"),
        F.col("years_experience_score").alias("experience_score"),
        F.col("recruiter_response_rate").alias("signal_score"),
        F.col("startup_score").alias("education_score"),
        F.col("career_growth_score").alias("engagement_score"),
    )


def embedding_audit(candidates: DataFrame, stored: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """V7: how stored vectors and candidates differ, as one row; ``reset`` asks for a full run.

    Duplicate ids in the store mean that ids and vectors no longer belong together.
    """
    ours = candidates.select(F.col(id_col).alias("_id"), F.lit(1).alias("_want"), F.lit(0).alias("_have"))
    theirs = stored.select(F.col(id_col).alias("_id"), F.lit(0).alias("_want"), F.lit(1).alias("_have"))
    per_id = ours.unionByName(theirs).groupBy("_id").agg(
        F.max("_want").alias("want"), F.sum("_have").alias("have")
    )
    return per_id.agg(
        F.count_if(F.col("want") == 1).alias("candidates"),
        F.count_if(F.col("have") > 0).alias("stored"),
        F.count_if((F.col("want") == 1) & (F.col("have") == 0)).alias("pending"),
        F.count_if((F.col("want") == 0) & (F.col("have") > 0)).alias("orphaned"),
        F.count_if(F.col("have") > 1).alias("duplicated"),
        F.coalesce(F.max(F.col("have") > 1), F.lit(False)).alias("reset"),
    )
