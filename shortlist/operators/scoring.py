"""Weights, scores, labels and explanations."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.arrays import elements, or_default
from shortlist.functions.numbers import exact_round, fixed
from shortlist.schemas import SKILLS_DDL


@dataclass(frozen=True)
class Weights:
    """Six percentages that sum to 100."""

    semantic_match: float = 30.0
    experience: float = 20.0
    behavioral_signals: float = 15.0
    production_experience: float = 20.0
    startup_experience: float = 10.0
    career_stability: float = 5.0

    def __post_init__(self) -> None:
        values = asdict(self)
        bad = [name for name, v in values.items() if not 0 <= v <= 100]
        if bad:
            raise ValueError(f"weights must lie between 0 and 100: {', '.join(bad)}")
        if abs(sum(values.values()) - 100.0) > 1e-3:
            raise ValueError(f"Weights must sum to exactly 100%. Current sum is {round(sum(values.values()), 2)}%.")

    def share(self, name: str) -> Column:
        return F.lit(getattr(self, name) / 100.0)


WEIGHT_NAMES = list(asdict(Weights()))

#: Label in explanations -> (component column, weight). The pairs are fixed.
COMPONENTS = {
    "Production Experience": ("skill_score", "production_experience"),
    "Semantic Match": ("semantic_score", "semantic_match"),
    "Experience": ("experience_score", "experience"),
    "Behavioral Signals": ("signal_score", "behavioral_signals"),
    "Startup Experience": ("education_score", "startup_experience"),
    "Career Stability": ("engagement_score", "career_stability"),
}
WEIGHTED_FEATURES = {
    "semantic_match": "embedding_similarity",
    "experience": "years_experience_score",
    "behavioral_signals": "recruiter_response_rate",
    "production_experience": "production_ml_score",
    "startup_experience": "startup_score",
    "career_stability": "career_growth_score",
}


# --- weights ----------------------------------------------------------------------------


def weights_check(table: DataFrame) -> DataFrame:
    """V6: which rows of a weights table are usable, and why not."""
    values = [F.col(name) for name in WEIGHT_NAMES]
    total = reduce(lambda a, b: a + b, values)
    out_of_range = reduce(lambda a, b: a | b, [F.coalesce(~v.between(0, 100), F.lit(True)) for v in values])
    problem = F.when(out_of_range, "range").when(F.abs(total - 100.0) > 1e-3, "sum").otherwise("")
    return table.select("*", F.round(total, 4).alias("total"), problem.alias("problem"), (problem == "").alias("ok"))


def read_weights(spark: SparkSession, path: str) -> Weights:
    """The first usable row of a JSON weights file, else the defaults. One small row is read."""
    schema = ", ".join(f"{name} double" for name in WEIGHT_NAMES)
    try:
        stored = spark.read.schema(schema).option("multiLine", True).json(path)
        row = weights_check(stored.na.fill(asdict(Weights()))).where("ok").select(*WEIGHT_NAMES).first()
    except Exception as error:  # a missing file is not an error here
        if "PATH_NOT_FOUND" not in str(error):
            raise
        row = None
    return Weights(**row.asDict()) if row else Weights()


def write_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    schema = ", ".join(f"{name} double" for name in WEIGHT_NAMES)
    spark.createDataFrame([tuple(asdict(weights).values())], schema).coalesce(1).write.mode("overwrite").json(path)


# --- scores -----------------------------------------------------------------------------


def weighted_score(weights: Weights | None = None) -> Column:
    """Weighted sum of six features."""
    chosen = weights or Weights()
    parts = [chosen.share(w) * or_default(F.col(f), 0.0) for w, f in WEIGHTED_FEATURES.items()]
    return reduce(lambda a, b: a + b, parts)


def component(name: str) -> Column:
    """A component score, missing as 0, to four places."""
    return exact_round(or_default(F.col(name), 0.0), 4)


def contributions(weights: Weights | None = None) -> dict[str, Column]:
    chosen = weights or Weights()
    return {label: component(column) * chosen.share(w) for label, (column, w) in COMPONENTS.items()}


def penalised_score(weights: Weights | None = None, penalty: str = "penalty") -> Column:
    """Weighted components, reduced by the penalty."""
    raw = reduce(lambda a, b: a + b, contributions(weights).values())
    return raw * (1.0 - F.col(penalty))


def top_factors(weights: Weights | None = None, n: int = 3) -> Column:
    """The largest contributions as ``Name (0.00)``; equal ones keep their fixed order."""
    items = F.array(
        *[
            F.struct((-value).alias("order"), F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value"))
            for i, (label, value) in enumerate(contributions(weights).items())
        ]
    )
    return F.transform(
        F.slice(F.array_sort(items), 1, n),
        lambda x: F.concat(x["label"], F.lit(" ("), fixed(x["value"], 2), F.lit(")")),
    )


def candidate_importance(weights: Weights | None = None, penalty: str = "penalty") -> Column:
    """``array<struct<feature, importance, direction>>``, largest first; the penalty counts against."""
    order = [
        "Semantic Match", "Experience", "Behavioral Signals", "Production Experience", "Startup Experience",
        "Career Stability",
    ]
    parts = contributions(weights)
    values = [(label, parts[label]) for label in order] + [("Penalty", -F.col(penalty))]
    items = F.array(
        *[
            F.struct(
                (-exact_round(F.abs(value), 4)).alias("order"),
                F.lit(i).alias("position"),
                F.lit(label).alias("feature"),
                exact_round(F.abs(value), 4).alias("importance"),
                F.when((value < 0) | F.lit(label == "Penalty"), "negative").otherwise("positive").alias("direction"),
            )
            for i, (label, value) in enumerate(values)
        ]
    )
    return F.transform(F.array_sort(items), lambda x: x.dropFields("order", "position"))


def global_importance(ranked: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Mean contribution of each component over the rows: ``(feature, importance, direction)``."""
    parts = contributions(weights)
    means = ranked.agg(F.count("*").alias("rows"), *[F.avg(v).alias(label) for label, v in parts.items()])
    return (
        means.where(F.col("rows") > 0)
        .unpivot("rows", list(parts), "feature", "importance")
        .select("feature", exact_round(F.col("importance"), 4).alias("importance"), F.lit("positive").alias("direction"))
        .orderBy(F.desc("importance"), F.asc("feature"))
    )


# --- skills, reasons and labels -----------------------------------------------------------


def top_skills(skills: Column, n: int = 5) -> Column:
    """The strongest skills by proficiency, then endorsements, then stored order.

    A missing level counts as beginner, an unknown one as nothing. In-row, so no window is needed.
    """
    def level(s: Column) -> Column:
        given = or_default(s["proficiency"], "beginner")
        out = F.lit(0)
        for name, value in vocab.PROFICIENCY_POINTS.items():
            out = F.when(given == name, F.lit(value)).otherwise(out)
        return out

    keyed = F.transform(
        elements(skills, SKILLS_DDL[6:-1]),
        lambda s, i: F.struct(
            (-level(s)).alias("level"), (-or_default(s["endorsements"], 0)).alias("endorsed"), i.alias("at"),
            s["name"].alias("name"),
        ),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["name"])


def reasoning_text(title: Column, years: Column, matched: Column, rate: Column, open_flag: Column,
                   flags: Column) -> Column:
    """The one-sentence reason of a ranked row."""
    first_flag = F.get(flags, F.lit(0))
    return F.concat(
        F.concat_ws(
            "; ",
            F.concat(or_default(title, "Professional"), F.lit(" with "),
                     fixed(or_default(years, 0.0), 1), F.lit(" yrs")),
            F.concat(matched.cast("int").cast("string"), F.lit(" core skills matched")),
            F.concat(F.lit("response rate "), fixed(or_default(rate, 0.0), 2)),
            F.when(or_default(open_flag, False), F.lit("open to work")),
            F.when(first_flag.isNotNull(), F.concat(F.lit("flags: "), F.substring(first_flag, 1, 40))),
        ),
        F.lit("."),
    )


def matched_skills(share: Column, asked: Column) -> Column:
    """How many of the asked-for skills a share stands for, cut to a whole number."""
    return F.floor(share * F.greatest(asked, F.lit(1)))


def label_columns(years: Column, hybrid: Column, semantic: Column | None = None, fraud_at: float = 0.4) -> dict:
    """``label`` 0..3 and ``reason`` from features and fraud scores.

    ``semantic`` is the similarity the top label asks for; left out it is 0, so no row gets 3.
    """
    similarity = semantic if semantic is not None else F.lit(0.0)
    production, retrieval = F.col("production_ml_score") > 0, F.col("retrieval_score") > 0
    vector_db, python = F.col("vector_db_score") > 0, F.col("python_score") > 0
    strong = (F.col("github_activity_score") > 0.5) | (F.col("recruiter_response_rate") > 0.5)
    fraud = (F.col("contradiction_score") >= fraud_at) | (F.col("honeypot_probability") >= fraud_at)
    excellent = years.between(5, 9) & production & retrieval & (similarity > 0.5) & vector_db & strong
    good = (years >= 3) & (production | retrieval | vector_db)
    weak = python | (hybrid > 0.4)
    outcomes = [
        (fraud | (F.col("python_score") == 0), 0, "fraud"),
        (excellent, 3, "excellent"),
        (good, 2, "good"),
        (weak, 1, "weak"),
    ]
    label, reason = F.lit(0), F.lit(vocab.LABEL_REASONS["none"])
    for test, value, key in reversed(outcomes):
        label = F.when(test, F.lit(value)).otherwise(label)
        reason = F.when(test, F.lit(vocab.LABEL_REASONS[key])).otherwise(reason)
    return {"label": label, "reason": reason}


def pseudo_label(hybrid: str = "hybrid_score", semantic: str | None = None) -> dict:
    """``label`` and ``reason`` as columns of a frame with the 31 features, both fraud scores and ``profile``.

    ``semantic`` names the similarity.
    """
    years = or_default(F.col("profile.years_of_experience"), 0.0)
    return label_columns(years, F.col(hybrid), F.col(semantic) if semantic else None)


def pseudo_labels(featured: DataFrame, hybrid: str = "hybrid_score", semantic: str | None = None) -> DataFrame:
    """The label table, scores rounded to 4, 2 and 2 places; arguments as for ``pseudo_label``."""
    columns = pseudo_label(hybrid, semantic)
    return featured.select(
        "candidate_id",
        columns["label"].alias("label"),
        exact_round(F.col(hybrid), 4).alias("hybrid_score"),
        exact_round(F.col("contradiction_score"), 2).alias("contradiction_score"),
        exact_round(F.col("honeypot_probability"), 2).alias("honeypot_score"),
        columns["reason"].alias("reason"),
    )
