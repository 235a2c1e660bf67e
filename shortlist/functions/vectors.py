"""Vector helpers on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist.functions.arrays import let
from shortlist.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    """Sum of products; equals the cosine where both vectors have unit length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit_length(vector: Column) -> Column:
    """The vector scaled to length one; an all-zero vector stays as it is."""
    def scaled(v: Column) -> Column:
        return let(
            F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))
        )

    return let(vector, scaled)


def hashed_bag(text: Column, dim: int = 64) -> Column:
    """The built-in encoder: token hashes counted into ``dim`` slots, scaled to unit length."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))

    def counted(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda slot: F.size(F.filter(found, lambda s: s == slot)).cast("double"),
        )

    return F.transform(unit_length(let(slots, counted)), lambda x: x.cast("float"))
