"""Ranked lists and weights with known faults, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.plans.derived import candidate_id

LIST_SIZE = 60


def ranked_lists(customer: DataFrame) -> DataFrame:
    """One list per 60 customers, as text cells, with faults by customer number.

    Wrong ids, repeated ids, ranks with a leading zero, repeated ranks, ranks out of range,
    scores that are no number, scores that rise, and equal scores with descending ids.
    """
    k = F.col("c_custkey")
    no = F.floor(k / LIST_SIZE)
    place = F.pmod(k, F.lit(LIST_SIZE)) + 1
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    number = F.when(no % 2 == 0, no * LIST_SIZE + (LIST_SIZE - 1) - F.pmod(k, F.lit(LIST_SIZE))).otherwise(k)
    cid = (
        F.when(every(37), F.concat(F.lit("BAD_"), k.cast("string")))
        .when(every(53), F.lit("CAND_0000001"))
        .when(every(59), F.lit(" "))
        .otherwise(candidate_id(number))
    )
    rank = (
        F.when(every(41), F.concat(F.lit("0"), place.cast("string")))
        .when(every(47) & (place > 1), (place - 1).cast("string"))
        .when(every(61), (place + LIST_SIZE).cast("string"))
        .otherwise(place.cast("string"))
    )
    hundredths = F.lit(100) - place + F.when(every(7), 1).otherwise(0) + F.when(every(31), 50).otherwise(0)
    score = F.when(every(43), F.lit("n/a")).otherwise((hundredths / 100.0).cast("string"))
    return customer.select(
        F.concat(F.lit("list_"), no.cast("string")).alias("list_id"),
        (place + 1).cast("int").alias("row_num"),
        cid.alias("candidate_id"),
        rank.alias("rank"),
        score.alias("score"),
    )


def weight_rows(part: DataFrame) -> DataFrame:
    """One weights row per part; about half sum to 100 and some leave the range."""
    k = F.col("p_partkey")
    semantic = (F.pmod(k, F.lit(50))).cast("double")
    odd = F.when(F.pmod(k, F.lit(2)) == 0, 0.0).otherwise(F.pmod(k, F.lit(7)).cast("double"))
    experience = F.when(F.pmod(k, F.lit(11)) == 0, 120.0).otherwise(20.0)
    return part.select(
        k.alias("weights_id"),
        semantic.alias("semantic_match"),
        experience.alias("experience"),
        F.lit(15.0).alias("behavioral_signals"),
        (F.lit(50.0) - semantic + odd).alias("production_experience"),
        F.lit(10.0).alias("startup_experience"),
        F.lit(5.0).alias("career_stability"),
    )
