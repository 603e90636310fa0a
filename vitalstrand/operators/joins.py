"""Joins whose keys may be dealt unevenly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds at least this share of the rows is hot; fewer keys than its inverse can be.
HOT_SHARE = 1 / 64
#: Entries of the sketch that finds them; its error is well below the share.
SKETCH_ITEMS = 1024


def hot_keys(facts: DataFrame, by: str, share: float = HOT_SHARE) -> list:
    """Values of ``by`` on at least ``share`` of the rows, found by a mergeable frequent-items sketch.

    Only the sketch meets in one task, and fewer than ``1 / share`` values reach the driver. The sketch never
    misses such a value; it may add one that is slightly rarer.
    """
    top, total = facts.where(F.col(by).isNotNull()).agg(F.expr(f"approx_top_k(`{by}`, {int(1 / share)}, {SKETCH_ITEMS})"), F.count(F.lit(1))).head()
    return [item["item"] for item in top or [] if item["count"] >= share * total]


def split_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", by: str | None = None, share: float = HOT_SHARE
) -> DataFrame:
    """Join of ``facts`` with ``lookup`` in which the rows of hot keys stay where they are.

    The lookup rows of hot keys are broadcast, all others are joined as Spark chooses. ``by`` is the column of ``on``
    that is examined (the first one otherwise). ``facts`` is read twice, so pass a table that is staged or cheap to
    read; ``lookup`` should hold few rows for a key. ``how`` is inner or left; rows whose key is null match nothing.
    """
    by = by or on[0]
    hot = hot_keys(facts, by, share)
    if not hot:
        return facts.join(lookup, list(on), how)
    is_hot = F.coalesce(F.col(by).isin(hot), F.lit(False))
    heavy = facts.where(is_hot).join(F.broadcast(lookup.where(is_hot)), list(on), how)
    return heavy.unionByName(facts.where(~is_hot).join(lookup.where(~is_hot), list(on), how))


#: Places over which the rows of a hot key are spread.
SALTS = 32


def salted_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], hot: Sequence, spread: Sequence[str], how: str = "inner", by: str | None = None, salts: int = SALTS
) -> DataFrame:
    """Join of ``facts`` with ``lookup`` in which rows of the keys ``hot`` meet in ``salts`` places each.

    Reads ``facts`` once, so it suits facts that are dear to compute; ``hot`` may come from ``hot_keys`` over their
    source. ``spread`` are columns of ``facts`` that differ between the rows of a key. Lookup rows of hot keys are
    repeated once for each place; with no hot key this is the plain join.
    """
    if not hot:
        return facts.join(lookup, list(on), how)
    is_hot = F.coalesce(F.col(by or on[0]).isin(list(hot)), F.lit(False))
    salted = facts.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int"))
    last = F.when(is_hot, salts - 1).otherwise(0)
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


#: Bits of the table of keys in ``may_hold``, sent to every executor as words of 64; bounds it, not the result of the join.
KEY_BITS = 1 << 26


def may_hold(facts: DataFrame, keys: DataFrame, fact_key: str, key: str, bits: int = KEY_BITS) -> DataFrame:
    """Rows of ``facts`` whose whole-number key may be in ``keys``; an inner join with ``keys`` must follow.

    A key sets one bit by its hash, so no row with a partner is lost. Others pass as often as their bit is set by chance
    (6 % for 4 million keys). It keeps rows without a partner out of the shuffle of a join that is too large to broadcast.
    """

    def place(column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))

    at = keys.select(place(key).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63L AS INT)))").alias("_bits"))
    placed = facts.withColumn("_at", place(fact_key)).withColumn("_word", F.shiftright("_at", 6))
    met = placed.join(F.broadcast(words), "_word")
    return met.where(F.getbit("_bits", F.col("_at").bitwiseAND(F.lit(63)).cast("int")) == 1).drop("_at", "_word", "_bits")


#: Days of one cell of the calendar in ``within_spans``.
CELL_DAYS = 8


def within_spans(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str, days: int = CELL_DAYS) -> DataFrame:
    """Pairs of a point and a span of the same key that holds its day, both ends included.

    The calendar is cut into cells. A span is repeated for each cell it reaches, a point is in one, so containment is an
    equi-join on key and cell, and a key's rows are spread over its cells. Null days and spans that end before they start match nothing.
    """

    def cell(day: str):
        return F.floor(F.unix_date(F.col(day)) / F.lit(days))

    cells = spans.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    pairs = points.withColumn("_cell", cell(at)).join(cells, [*on, "_cell"])
    return pairs.where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")
