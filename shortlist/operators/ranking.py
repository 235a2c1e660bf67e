"""Ranked output: duplicates, ranks, and the rules a ranked file must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.arrays import words


def dedupe_best(results: DataFrame, position: str = "input_pos", keys: list[str] | None = None) -> DataFrame:
    """One row per candidate, the best score, the earlier row on ties.

    The first-row limit is applied before the shuffle, so a much repeated id stays cheap.
    """
    order = Window.partitionBy(*(keys or ["candidate_id"])).orderBy(F.desc("score"), F.asc(position))
    return results.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def ranked(results: DataFrame, n: int = 100) -> DataFrame:
    """The n best rows with ranks 1..n, ties by id. The window sees only those n rows."""
    top = results.orderBy(F.desc("score"), F.asc("candidate_id")).limit(n)
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("candidate_id")))
    )


def ranking_rows(results: DataFrame, n: int = 100, position: str = "input_pos") -> DataFrame:
    """The rows of a ranked file, before formatting."""
    reason = F.col("reasoning") if "reasoning" in results.columns else F.lit(None).cast("string")
    return ranked(dedupe_best(results, position), n).select(
        "candidate_id", "rank", "score", F.coalesce(reason, F.lit(vocab.DEFAULT_REASONING)).alias("reasoning")
    )


def header_errors(header: Column) -> Column:
    """V4: null when the header is exactly right, else the message."""
    wanted = words(vocab.RANKING_HEADER)
    text = ",".join(vocab.RANKING_HEADER)
    return F.when(
        ~header.eqNullSafe(wanted),
        F.concat(F.lit(f"Row 1 (header) must be exactly: {text}; found: "), F.array_join(header, ",")),
    )


def validate_ranking(
    rows: DataFrame, n: int = 100, list_id: str = "list_id", bucket: int = 1000, id_pattern: str = vocab.ID_PATTERN
) -> DataFrame:
    """V5: one row per broken rule: ``(list, rule, row_num, message)``.

    Input: ``(list, row_num, candidate_id, rank, score)`` as text, one list per ranked file, so
    that many files are checked in one job. Rules about one row are a projection. Duplicates
    are found by counts per key. Neighbouring ranks are compared inside buckets of ``bucket``
    ranks and then across bucket edges, so a very long list is not sorted in one task.

    A column ``columns`` tells how many cells a row had; rows with another number than the header break that rule
    alone, and count as rows.
    """
    every, cells = rows, len(vocab.RANKING_HEADER)
    odd = F.col("columns") != cells if "columns" in rows.columns else F.lit(False)
    rows = rows.where(~odd)
    clean = rows.select(
        list_id,
        "row_num",
        F.trim(F.coalesce("candidate_id", F.lit(""))).alias("cid"),
        F.trim(F.coalesce("rank", F.lit(""))).alias("rank_text"),
        F.trim(F.coalesce("score", F.lit(""))).alias("score_text"),
    )
    whole = F.col("rank_text").rlike("^(0|-?[1-9][0-9]*)$")
    parsed = clean.select(
        "*",
        F.when(whole, F.expr("try_cast(rank_text AS BIGINT)")).alias("rank"),
        F.expr("try_cast(score_text AS DOUBLE)").alias("score"),
        F.col("cid").rlike(id_pattern).alias("id_ok"),
    )
    in_range = F.col("rank").between(1, n)

    # Which row of a duplicated id or rank came first: per key, with map-side combine.
    first_id = (
        parsed.where("id_ok").groupBy(list_id, "cid").agg(F.min("row_num").alias("first_row"), F.count("*").alias("c"))
        .where("c > 1")
    )
    first_rank = (
        parsed.where(in_range).groupBy(list_id, "rank")
        .agg(F.min("row_num").alias("first_row"), F.count("*").alias("c"))
        .where("c > 1")
    )
    single = parsed.select(
        list_id,
        "row_num",
        F.explode(
            F.array_compact(
                F.array(
                    _finding(F.col("cid") == "", "id_required", ": candidate_id is required."),
                    _finding((F.col("cid") != "") & ~F.col("id_ok"), "id_pattern",
                             ": candidate_id must be CAND_XXXXXXX (7 digits)."),
                    _finding(F.col("rank").isNull(), "rank_integer", f": rank must be an integer (1–{n})."),
                    _finding(~in_range, "rank_range", f": rank must be between 1 and {n}."),
                    _finding(F.col("score").isNull(), "score_number", ": score must be a float."),
                )
            )
        ).alias("f"),
    ).select(list_id, "f.rule", "row_num", "f.message")
    again_id = parsed.where("id_ok").join(first_id, [list_id, "cid"]).where("row_num > first_row").select(
        list_id, F.lit("id_duplicate").alias("rule"), "row_num",
        _row_message(F.concat(F.lit(": duplicate candidate_id '"), "cid", F.lit("'."))).alias("message"),
    )
    again_rank = parsed.where(in_range).join(first_rank, [list_id, "rank"]).where("row_num > first_row").select(
        list_id, F.lit("rank_duplicate").alias("rule"), "row_num",
        _row_message(F.concat(F.lit(": duplicate rank "), F.col("rank").cast("string"), F.lit("."))).alias("message"),
    )
    counts = every.groupBy(list_id).agg(F.count("*").alias("c"))
    row_count = counts.where(F.col("c") != n).select(
        list_id, F.lit("row_count").alias("rule"), F.lit(None).cast(rows.schema["row_num"].dataType).alias("row_num"),
        F.concat(F.lit(f"there must be exactly {n} data rows; found "), F.col("c").cast("string"), F.lit(".")).alias(
            "message"
        ),
    )
    # At most n different ranks per list are collected.
    seen = parsed.where(in_range).select(list_id, "rank").distinct().groupBy(list_id).agg(
        F.collect_set("rank").alias("seen")
    )
    missing = counts.join(seen, list_id, "left").select(
        list_id,
        F.array_except(
            F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>"),
            F.coalesce("seen", F.array().cast("array<bigint>")),
        ).alias("m"),
    ).where(F.size("m") > 0).select(
        list_id, F.lit("rank_missing").alias("rule"), F.lit(None).cast(rows.schema["row_num"].dataType).alias("row_num"),
        F.concat(F.lit(f"Each rank 1–{n} must appear exactly once; missing: ["), F.array_join("m", ", "),
                 F.lit("]")).alias("message"),
    )
    order = _neighbours(
        parsed.where(F.col("rank").isNotNull() & F.col("score").isNotNull() & (F.col("cid") != "")), list_id, bucket
    )
    rank_text, next_text = F.col("rank").cast("string"), F.col("next.rank").cast("string")
    rising = order.where(F.col("score") < F.col("next.score")).select(
        list_id, F.lit("score_order").alias("rule"), "row_num",
        F.concat(F.lit("score must be non-increasing by rank: rank "), rank_text, F.lit(" < rank "), next_text,
                 F.lit(".")).alias("message"),
    )
    ties = order.where((F.col("score") == F.col("next.score")) & (F.col("cid") > F.col("next.cid"))).select(
        list_id, F.lit("tie_break").alias("rule"), "row_num",
        F.concat(F.lit("Equal scores at ranks "), rank_text, F.lit(" and "), next_text,
                 F.lit(": tie-break requires candidate_id ascending.")).alias("message"),
    )
    out = single
    if "columns" in every.columns:
        expected = f": expected {cells} columns ({','.join(vocab.RANKING_HEADER)}), got "
        out = out.unionByName(every.where(odd).select(
            list_id, F.lit("column_count").alias("rule"), "row_num",
            _row_message(F.concat(F.lit(expected), F.col("columns").cast("string"), F.lit("."))).alias("message"),
        ))
    for part in (again_id, again_rank, row_count, missing, rising, ties):
        out = out.unionByName(part)
    return out


def _row_message(text: Column) -> Column:
    return F.concat(F.lit("Row "), F.col("row_num").cast("string"), text)


def _finding(test: Column, rule: str, text: str) -> Column:
    return F.when(test, F.struct(F.lit(rule).alias("rule"), _row_message(F.lit(text)).alias("message")))


def _neighbours(rows: DataFrame, list_id: str, bucket: int) -> DataFrame:
    """Every row with the next one in rank order, as ``next``."""
    item = F.struct("rank", "row_num", "score", "cid")
    placed = rows.withColumn("_bucket", F.floor(F.col("rank") / bucket)).withColumn("_item", item)
    inside = Window.partitionBy(list_id, "_bucket").orderBy("rank", "row_num")
    within = placed.withColumn("next", F.lead("_item").over(inside))
    # One row per bucket: its first item, handed to the bucket before it.
    starts = placed.groupBy(list_id, "_bucket").agg(F.min("_item").alias("_first"))
    after = Window.partitionBy(list_id).orderBy("_bucket")
    starts = starts.withColumn("_following", F.lead("_first").over(after)).select(list_id, "_bucket", "_following")
    return (
        within.join(starts, [list_id, "_bucket"])
        .withColumn("next", F.coalesce("next", "_following"))
        .where(F.col("next").isNotNull())
        .drop("_bucket", "_item", "_following")
    )
