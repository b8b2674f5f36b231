"""Scalar and array helpers whose rules differ from the nearest Spark built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_trailing(text: Column, n: int) -> Column:
    """``text`` without its last ``n`` characters (empty when shorter)."""
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))


def part_suffix(text: Column) -> Column:
    """Strict variant for part ids: drop a trailing ``-<digits>`` of any length."""
    return F.regexp_replace(text, r"-\d+$", "")


def any_differs(values: Column, x: str) -> Column:
    """True when some element is not ``x`` (not "none equals ``x``")."""
    return F.exists(values, lambda e: e != x)


def occurrences(values: Column, x: str) -> Column:
    """How often ``x`` occurs in the array."""
    return F.size(F.filter(values, lambda e: e == x))


def sentinel_to_null(value: Column, sentinel: int) -> Column:
    return F.nullif(value, F.lit(sentinel))


def zero_if_present(count: Column, guard: Column) -> Column:
    """0 for a missing count, but only where ``guard`` is there."""
    return F.when(count.isNull() & guard.isNotNull(), F.lit(0)).otherwise(count)


def parse_double(text: Column, strict: bool = True) -> Column:
    """Text to double; the strict form fails on bad text, the other yields null."""
    return text.cast("double") if strict else text.try_cast("double")


def distance_between(a: Column, b: Column) -> Column:
    return F.abs(a - b)
