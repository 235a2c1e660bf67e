"""Array and matching helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATTERN_CHARS = set("\\.^$*+?()[]{}|")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once per row.

    An expression that is mentioned inside a lambda is evaluated for every element. As a lambda
    variable it is a plain reference, also after the optimizer has merged projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns behind a one-row generator, so that they are computed a single time.

    Spark pushes a filter on a computed column below the projection and then evaluates the
    expression twice. Filters on generated columns stay above the generator; filters on other
    columns still pass through it to the scan.
    """
    made = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.select("*", made)


def words(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    quoted_values = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({', '.join(quoted_values)})")


def or_default(column: Column, value) -> Column:
    """``column``, or ``value`` where it is missing."""
    return F.coalesce(column, F.lit(value))


def lowered(column: Column) -> Column:
    return F.lower(or_default(column, ""))


def elements(column: Column, element_type: str) -> Column:
    """The array itself, or an empty one where it is missing."""
    return F.coalesce(column, F.array().cast(f"array<{element_type}>"))


def fields_of(array: str, fields: dict[str, str]) -> Column:
    """Some fields of an array of structs, as a smaller array of structs; empty where it is missing.

    Each field is taken out by itself, so a Parquet scan reads only these and not, for instance,
    the long descriptions next to them.
    """
    kind = "array<struct<" + ",".join(f"{name}:{type_}" for name, type_ in fields.items()) + ">>"
    narrow = F.arrays_zip(*[F.col(f"{array}.{name}") for name in fields]).cast(kind)
    return F.coalesce(narrow, F.array().cast(kind))


def has_any_element(column: Column, values: Iterable[str]) -> Column:
    """Whether one of ``values`` is, as a whole, an element of the array."""
    return F.arrays_overlap(column, words(values))


def quoted(text: str) -> str:
    """``text`` as a pattern that matches only itself."""
    return "".join(f"\\{c}" if c in _PATTERN_CHARS else c for c in text)


def any_of(values: Iterable[str]) -> str:
    return "|".join(quoted(v) for v in values)


def has_any_substring(column: Column, values: Iterable[str]) -> Column:
    """Whether one of ``values`` occurs anywhere in the text."""
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(v)) for v in values])


def count_substrings(column: Column, values: Iterable[str]) -> Column:
    """How many of ``values`` occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(column, F.lit(v)).cast("int") for v in values])


def distinct_overlap(column: Column, values: Iterable[str]) -> Column:
    """How many different ``values`` are elements of the array."""
    return F.size(F.array_intersect(column, words(values)))


def total(column: Column) -> Column:
    """Sum of a numeric array; 0 for an empty one."""
    return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def flag(condition: Column, yes: float = 1.0, no: float = 0.0) -> Column:
    return F.when(condition, F.lit(float(yes))).otherwise(F.lit(float(no)))
