"""Dataset statistics (A1-A9, A15-A17, K7, K9, S4). Aggregations combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.functions.numbers import exact_round

YEARS_BANDS = [("0-2", None, 2), ("2-5", 2, 5), ("5-10", 5, 10), ("10-15", 10, 15), ("15+", 15, None)]
SCORE_BANDS = [("90+", 0.9, None), ("80-89", 0.8, 0.9), ("70-79", 0.7, 0.8), ("<70", None, 0.7)]


def dataset_stats(profiles: DataFrame) -> DataFrame:
    """The headline numbers in one pass."""
    yes = lambda c: F.count_if(F.col(c)).alias(c)
    mean = lambda c, digits, name: exact_round(F.avg(c), digits).alias(name)
    return profiles.agg(
        F.count("*").alias("total_candidates"),
        F.count_if(F.col("open_to_work_flag")).alias("open_to_work"),
        F.round(
            F.count_if(F.col("open_to_work_flag")) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4
        ).alias("open_to_work_pct"),
        mean("years_of_experience", 2, "avg_years_experience"),
        mean("profile_completeness_score", 2, "avg_profile_completeness"),
        *[yes(c) for c in ("willing_to_relocate", "verified_email", "verified_phone", "linkedin_connected")],
        mean("notice_period_days", 1, "avg_notice_period_days"),
        mean("recruiter_response_rate", 3, "avg_recruiter_response_rate"),
        mean("interview_completion_rate", 3, "avg_interview_completion_rate"),
    )


def value_counts(df: DataFrame, column: str | Column, name: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value; missing values left out."""
    value = F.col(column) if isinstance(column, str) else column
    counts = df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), F.asc(name)).limit(top)


def facet_counts(df: DataFrame, facets: list[str], skip_empty: bool = True) -> DataFrame:
    """Value counts of several columns in one pass: ``(facet, value, n)``."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in facets]).unpivot([], facets, "facet", "value")
    long = long.where(F.col("value").isNotNull())
    if skip_empty:
        long = long.where(F.col("value") != "")
    return long.groupBy("facet", "value").agg(F.count("*").alias("n"))


def band(value: Column, bands: list[tuple[str, float | None, float | None]]) -> Column:
    """The first half-open band ``[low, high)`` that holds the value."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value < high)
        out = F.when(test, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def band_counts(df: DataFrame, column: str, bands=None, name: str = "band") -> DataFrame:
    """Rows per band; every band is listed, with 0 where it is empty."""
    bands = bands or YEARS_BANDS
    which = band(F.col(column), bands)
    sums = df.agg(*[F.count_if(which == label).alias(label) for label, _, _ in bands])
    labels = [label for label, _, _ in bands]
    return sums.unpivot([], labels, name, "n")


def _nested_entries(candidates: DataFrame, field: str, part: str, section: str) -> Column:
    """One ``(section, key)`` per list element; an element without the value counts as Unknown."""
    listed = F.coalesce(F.col(field), F.array().cast(candidates.schema[field].dataType))
    return F.transform(
        listed, lambda x: F.struct(F.lit(section).alias("section"), F.coalesce(x[part], F.lit("Unknown")).alias("key"))
    )


def _plain_entry(value: Column, section: str) -> Column:
    """One ``(section, key)`` for a plain value; none where it is empty."""
    key = value.cast("string")
    return F.when(
        F.coalesce(key, F.lit("")) != "", F.array(F.struct(F.lit(section).alias("section"), key.alias("key")))
    ).otherwise(F.array().cast("array<struct<section:string,key:string>>"))


def _section_counts(candidates: DataFrame, entries: list[Column]) -> DataFrame:
    """Counts of all sections in a single pass over the candidates."""
    return (
        candidates.select(F.explode(F.concat(*entries)).alias("e"))
        .groupBy(F.col("e.section").alias("section"), F.col("e.key").alias("key"))
        .agg(F.count("*").alias("n"))
    )


def _top_of_sections(counts: DataFrame, sizes: dict[str, int | None]) -> DataFrame:
    """The most frequent keys of each section, ties by key. Of limited sections, every task keeps at most the largest size."""
    whole = [section for section, size in sizes.items() if size is None]
    if whole:
        order = Window.partitionBy("section").orderBy(F.desc("n"), F.asc("key"))
        listed = counts.where(F.col("section").isin(whole)).withColumn("rank", F.row_number().over(order))
        limited = counts.where(~F.col("section").isin(whole))
        return _top_of_sections(limited, {s: n for s, n in sizes.items() if n is not None}).unionByName(listed)
    order = Window.partitionBy("section").orderBy(F.desc("n"), F.asc("key"))
    allowed = F.lit(0)
    for section, size in sizes.items():
        allowed = F.when(F.col("section") == section, F.lit(size)).otherwise(allowed)
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(sizes.values()))
        .where(F.col("rank") <= allowed)
    )


def nested_counts(candidates: DataFrame) -> DataFrame:
    """A5: skills, certifications and company sizes over the nested lists: ``(section, key, n)``."""
    return _section_counts(
        candidates,
        [
            _nested_entries(candidates, "skills", "name", "skills"),
            _nested_entries(candidates, "certifications", "name", "certifications"),
            _nested_entries(candidates, "career_history", "company_size", "company_sizes"),
        ],
    )


def active_by_month(profiles: DataFrame) -> DataFrame:
    """Candidates by the month they were last active."""
    return value_counts(profiles, F.substring("last_active_date", 1, 7), "month")


HISTOGRAM_METRICS = [
    "years_of_experience", "github_activity_score", "recruiter_response_rate", "interview_completion_rate",
    "saved_by_recruiters_30d",
]


def histograms(df: DataFrame, metrics: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; the last bin is closed.

    A metric with one value only gets bins of total width one around it. Empty bins are not listed.
    """
    metrics = metrics or HISTOGRAM_METRICS
    long = df.select(*[F.col(c).cast("double").alias(c) for c in metrics]).unpivot([], metrics, "metric", "value")
    long = long.where(F.col("value").isNotNull())
    span = long.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = span.select(
        "metric",
        F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
    )
    bin_no = F.least(
        F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)
    ).cast("int")
    return (
        long.join(F.broadcast(span), "metric")  # one row per metric
        .groupBy("metric", bin_no.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def pool_kpis(ranked: DataFrame, above: float = 0.4) -> DataFrame:
    """Clean and flagged rows and the mean score; zeros for an empty pool."""
    flagged = F.coalesce("honeypot_probability", F.lit(0.0)) > above
    return ranked.agg(
        F.count("*").alias("pool"),
        F.count_if(~flagged).alias("clean"),
        F.count_if(flagged).alias("flagged"),
        exact_round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean_score"),
    )


def fraud_breakdown(screened: DataFrame) -> DataFrame:
    """How many candidates each rule fired for."""
    codes = F.array_distinct(F.concat("contradiction_codes", "honeypot_codes"))
    return screened.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


#: Rows per section of the report; None lists all.
REPORT_SIZES = {
    "top_100_skills": 100, "top_titles": 20, "top_industries": 20, "top_countries": 20, "top_certifications": 20,
    "company_sizes": None, "notice_periods": None,
}


def dataset_report(candidates: DataFrame) -> DataFrame:
    """K7: the statistics report in long form ``(section, key, n, rank)``, in one pass."""
    counts = _section_counts(
        candidates,
        [
            _nested_entries(candidates, "skills", "name", "top_100_skills"),
            _plain_entry(F.col("profile.current_title"), "top_titles"),
            _plain_entry(F.col("profile.current_industry"), "top_industries"),
            _plain_entry(F.col("profile.country"), "top_countries"),
            _nested_entries(candidates, "certifications", "name", "top_certifications"),
            _nested_entries(candidates, "career_history", "company_size", "company_sizes"),
            _plain_entry(F.col("signals.notice_period_days"), "notice_periods"),
        ],
    )
    return _top_of_sections(counts, REPORT_SIZES)


def report_document(report: DataFrame, profiles: DataFrame) -> DataFrame:
    """K7: the long report as one row of maps, ready to be written as JSON.

    The long sections are bounded by their top-n; sizes and notice periods are listed in full.
    """
    maps = [
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("key", "n"))))
        ).alias(name)
        for name in REPORT_SIZES
    ]
    totals = profiles.agg(
        F.struct(
            F.count("*").alias("n"),
            (F.count_if(F.col("open_to_work_flag")) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("pct"),
        )
    )
    return (
        report.agg(*maps)
        .withColumn("totals", totals.scalar())
        .select(
            F.col("totals.n").alias("total_candidates"),
            F.col("totals.pct").alias("open_to_work_percentage"),
            *REPORT_SIZES,
        )
    )


def dataset_summary(candidates: DataFrame) -> DataFrame:
    """Five industries, five countries and ten skills with their position."""
    counts = _section_counts(
        candidates,
        [
            _plain_entry(F.col("profile.current_industry"), "industry"),
            _plain_entry(F.col("profile.country"), "country"),
            _nested_entries(candidates, "skills", "name", "skill"),
        ],
    )
    return _top_of_sections(counts, {"industry": 5, "country": 5, "skill": 10})


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows and columns of each table; each count reads file footers only."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def table_sizes(paths: dict[str, str], spark) -> DataFrame:
    """Bytes on disk of each stored table, from the file listing."""
    out = None
    for name, path in sorted(paths.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet"
        ).load(path)
        row = files.agg(F.sum("length").alias("size_bytes")).select(F.lit(name).alias("name"), "size_bytes")
        out = row if out is None else out.unionByName(row)
    return out
