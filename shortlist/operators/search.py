"""Search, lookup, paging and presentation of candidates and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_COLUMNS = [
    "candidate_id", "anonymized_name", "headline", "current_title", "current_company", "years_of_experience",
    "location", "country", "open_to_work_flag", "profile_completeness_score", "preferred_work_mode", "skill_count",
]


def text_predicate(query: str, columns: list[str], regex: bool = False) -> Column:
    """the lower-cased query occurs in one of the columns; missing text never matches."""
    wanted = query.lower()
    out = F.lit(False)
    for name in columns:
        text = F.lower(F.coalesce(F.col(name), F.lit("")))
        out = out | (text.rlike(wanted) if regex else F.contains(text, F.lit(wanted)))
    return out


def with_skill(profiles: DataFrame, skills: DataFrame, skill: str) -> DataFrame:
    """Profiles that list a skill whose name contains the text. A semi join never multiplies rows."""
    matching = skills.where(F.contains(F.lower("skill_name"), F.lit(skill.lower()))).select("candidate_id")
    return profiles.join(matching, "candidate_id", "left_semi")


def search_candidates(
    profiles: DataFrame, skills: DataFrame | None = None, q: str | None = None, skill: str | None = None,
    open_to_work: bool | None = None, min_yoe: float | None = None, max_yoe: float | None = None,
    work_mode: str | None = None, country: str | None = None, regex: bool = False,
) -> DataFrame:
    """all given conditions together; the summary columns (P9) of the matches.

    Range and equality conditions on plain columns are pushed into the Parquet scan.
    """
    out = profiles
    if open_to_work is not None:
        out = out.where(F.col("open_to_work_flag") == open_to_work)
    if min_yoe is not None:
        out = out.where(F.col("years_of_experience") >= min_yoe)
    if max_yoe is not None:
        out = out.where(F.col("years_of_experience") <= max_yoe)
    if work_mode:
        out = out.where(F.col("preferred_work_mode") == work_mode)
    if country:
        out = out.where(F.lower("country") == country.lower())
    if q:
        out = out.where(text_predicate(q, ["current_title", "headline", "summary"], regex))
    if skill:
        if skills is None:
            raise ValueError("a skill filter needs the skills table")
        out = with_skill(out, skills, skill)
    return out.select(*SUMMARY_COLUMNS).na.fill("")


def page(df: DataFrame, order_by: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """P10: one page in a stated order. The total is a separate count of the same frame."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def lookup(table: DataFrame, candidate_id: str) -> DataFrame:
    """the rows of one candidate."""
    return table.where(F.col("candidate_id") == candidate_id)


def candidate_detail(tables: dict[str, DataFrame], candidate_id: str | None = None) -> DataFrame:
    """Profiles with their five child lists; the retrieval text is left out.

    Each child table is grouped once by the id, which is also the join key, so the joins reuse
    that partitioning. With an id, the condition reaches every scan and only its rows are read.
    """
    pick = (lambda t: lookup(t, candidate_id)) if candidate_id is not None else (lambda t: t)
    out = pick(tables["profiles"]).drop("embedding_text")
    for name in ("skills", "education", "career_history", "certifications", "languages"):
        child = pick(tables[name])
        fields = [c for c in child.columns if c != "candidate_id"]
        if "job_order" in fields:  # keep the stored order of jobs
            fields = ["job_order", *[c for c in fields if c != "job_order"]]
        lists = child.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(lists, "candidate_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(lists.schema[name].dataType))
        )
    return out


def masked_name(name: Column) -> Column:
    """The first letter of every word, then a star for each further letter."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.rpad(F.substring(w, 1, 1), F.length(w), F.lit("*"))), " "
    )


def score_tier(score: Column) -> Column:
    """P12."""
    return F.when(score >= 0.85, "Top Match").when(score >= 0.7, "Strong").otherwise("Moderate")


def fraud_flag(probability: Column, above: float = 0.4) -> Column:
    """P13."""
    return F.coalesce(probability, F.lit(0.0)) > above


def compare_pair(ranked: DataFrame, attributes: list[str], ranks: tuple[int, int] = (1, 2)) -> DataFrame:
    """Two ranked rows side by side: ``(attribute, a, b)``."""
    pair = ranked.where(F.col("rank").isin(list(ranks))).select("rank", *[F.col(c).cast("string") for c in attributes])
    long = pair.unpivot("rank", attributes, "attribute", "value")
    return long.groupBy("attribute").agg(
        F.max(F.when(F.col("rank") == ranks[0], F.col("value"))).alias("a"),
        F.max(F.when(F.col("rank") == ranks[1], F.col("value"))).alias("b"),
    )


def search_ranked(ranked: DataFrame, text: str, order_by: str = "score") -> DataFrame:
    """ranked rows whose name, title or one of whose skills contains the text.

    ``order_by`` is ``score`` or ``years_of_experience``, highest first.
    """
    wanted = F.lit(text.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted)
    found = ranked.where(
        has(F.col("name")) | has(F.col("title")) | F.coalesce(F.exists("skill_names", lambda s: has(s)), F.lit(False))
    )
    return found.orderBy(F.desc(order_by), F.asc("candidate_id"))
