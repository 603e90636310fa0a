"""Expressions over token and position arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalstrand.config import DAY_SEP, PAD


def tail(arr: Column, n: int) -> Column:
    """Last ``n`` elements; shorter arrays are left alone."""
    return F.when(F.size(arr) > n, F.slice(arr, -n, n)).otherwise(arr)


def pad_right(arr: Column, n: int, value: int = PAD) -> Column:
    kept = tail(arr, n)
    return F.concat(kept, F.array_repeat(F.lit(value).cast("int"), F.lit(n) - F.size(kept)))


def attention_mask(arr: Column, n: int) -> Column:
    real = F.least(F.size(arr), F.lit(n))
    return F.concat(F.array_repeat(F.lit(True), real), F.array_repeat(F.lit(False), F.lit(n) - real))


def positions_from_separators(ids: Column, separator: int = DAY_SEP) -> Column:
    """Day index per token, counting separators up to and including it; padding stays at 0."""
    marks = F.filter(
        F.transform(ids, lambda t, i: F.when(t == separator, i)), lambda i: i.isNotNull()
    )
    return F.transform(
        ids,
        lambda t, i: F.when(t == PAD, F.lit(0)).otherwise(F.size(F.filter(marks, lambda m: m <= i))),
    )


def max_id(ids: Column) -> Column:
    """Largest id; an empty array counts as 0."""
    return F.coalesce(F.array_max(ids), F.lit(0))


def as_text(arr: Column) -> Column:
    return F.array_join(arr.cast("array<string>"), " ")
