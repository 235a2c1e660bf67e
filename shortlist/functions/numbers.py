"""Rounding of the stored binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products are exact.
_SPLITTER = "134217729.0D"


def exact_round(value: Column, digits: int) -> Column:
    """The nearest number with ``digits`` places, judged by the exact binary value, ties to even.

    The built-in functions round the shortest decimal form, which turns 0.285 (stored a little
    below) into a tie. Here the error of ``value * 10^digits`` is computed as well, so that an
    apparent tie is decided by what is really stored.
    """
    scale = f"{float(10**digits)}D"
    # t.p is the scaled value, t.h the upper half of x; the bracketed sum is the error of t.p.
    error = f"((t.h * {scale} - t.p) + (x - t.h) * {scale})"
    up = f"t.r > 0.5D OR (t.r = 0.5D AND ({error} > 0 OR ({error} = 0 AND floor(t.p) % 2 = 1)))"
    parts = f"struct(x * {scale} AS p, x * {_SPLITTER} - (x * {_SPLITTER} - x) AS h, x * {scale} - floor(x * {scale}) AS r)"
    result = f"signum(v) * (floor(t.p) + if({up}, 1, 0)) / {scale}"
    body = "v -> " + _bound("abs(v)", "x", _bound(parts, "t", result))
    return F.element_at(F.call_function("transform", F.array(value.cast("double")), F.expr(body)), 1)


def _bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for the value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fixed(value: Column, digits: int) -> Column:
    """The number as text with a fixed number of places."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))
