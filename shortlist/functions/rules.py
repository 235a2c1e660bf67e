"""Weighted rules as data: each rule is a condition, a weight and a message, all Columns.

A rule set becomes one array of ``struct(code, weight, message)`` per row. The score is the
capped sum of the weights, so every rule of a set is evaluated in a single narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<code:string,weight:double,message:string>"


@dataclass(frozen=True)
class Rule:
    """Fires at most once per row."""

    code: str
    weight: float
    condition: Column
    message: Column

    def hits(self) -> Column:
        hit = hit_struct(self.code, self.weight, self.message)
        return F.when(self.condition, F.array(hit)).otherwise(no_hits())


@dataclass(frozen=True)
class EachRule:
    """Fires once for every matching element of an array."""

    code: str
    weight: float
    array: Column
    condition: Callable[[Column], Column]
    message: Callable[[Column], Column]

    def hits(self) -> Column:
        return F.transform(
            F.filter(self.array, self.condition),
            lambda x: hit_struct(self.code, self.weight, self.message(x)),
        )


def hit_struct(code: str, weight: float, message: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(float(weight)).alias("weight"), message.cast("string").alias("message")
    ).cast(HIT)


def no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")


def all_hits(rules: Sequence[Rule | EachRule]) -> Column:
    return F.concat(*[rule.hits() for rule in rules])


def capped_score(hits: Column, cap: float = 1.0) -> Column:
    return F.least(F.lit(float(cap)), F.aggregate(hits, F.lit(0.0), lambda acc, hit: acc + hit["weight"]))


def hit_codes(hits: Column) -> Column:
    return F.transform(hits, lambda hit: hit["code"])


def hit_messages(hits: Column) -> Column:
    return F.transform(hits, lambda hit: hit["message"])
