"""Window anchors, labels and token sequences.

Windows are made from the data outward. A day's place on a person's calendar gives the ordinals of the
windows it falls in by arithmetic, so the window-by-token range join becomes an equi-join on person plus
a short explode (at most ceil(31 / stride) copies). Tokens are sorted once per person-day and packed into
an array; a window then only gathers its few days.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.config import BOS, DAY_SEP, EOS
from vitalstrand.functions.arrays import attention_mask, max_id, pad_right, tail

KEYS = ("person_id", "end_date")


def person_calendar(cohort: DataFrame, window_days: int, lookahead_days: int, stride: Mapping[str, int]) -> DataFrame:
    """First anchor, stride and last ordinal per person; persons without room for a window drop out."""
    step = None
    for split, days in stride.items():
        hit = F.col("split") == split
        step = F.when(hit, days) if step is None else step.when(hit, days)
    first = F.date_add(F.to_date("fitbit_start"), window_days)
    room = F.datediff(F.date_sub(F.to_date("fitbit_end"), lookahead_days), first)
    return (
        cohort.select("person_id", "split", first.alias("first_end"), step.alias("stride"), room.alias("room"))
        .where((F.col("room") >= 0) & F.col("stride").isNotNull())
        .withColumn("last_k", F.floor(F.col("room") / F.col("stride")).cast("int"))
        .drop("room")
    )


def end_date(k: str = "k") -> Column:
    return F.date_add(F.col("first_end"), (F.col(k) * F.col("stride")).cast("int"))


def window_anchors(calendar: DataFrame) -> DataFrame:
    """Every (person_id, end_date) the calendar allows."""
    ks = calendar.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last_k"))))
    return ks.select("person_id", "split", end_date().alias("end_date"))


def _ordinals(offset_lo: Column, offset_hi: Column) -> Column:
    """Ordinals k with lo <= k * stride <= hi (day offsets from the first anchor), within the calendar."""
    lo = F.greatest(F.ceil(offset_lo / F.col("stride")), F.lit(0)).cast("int")
    hi = F.least(F.floor(offset_hi / F.col("stride")), F.col("last_k")).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi))


def in_windows(days: DataFrame, calendar: DataFrame, window_days: int, day: str = "day") -> DataFrame:
    """Copy each dated row to the windows [end - window_days, end] that hold it."""
    at = F.datediff(F.col(day), F.col("first_end"))
    joined = days.join(calendar, "person_id")
    return joined.withColumn("k", F.explode(_ordinals(at, at + window_days))).withColumn("end_date", end_date()).drop(
        "first_end", "stride", "last_k", "k"
    )


def positive_windows(event_days: DataFrame, calendar: DataFrame, lookahead_days: int) -> DataFrame:
    """Distinct (person_id, end_date) with an event in [end + 1, end + lookahead]."""
    at = F.datediff(F.col("event_day"), F.col("first_end"))
    return (
        event_days.select("person_id", "event_day").distinct()
        .join(calendar, "person_id")
        .withColumn("k", F.explode(_ordinals(at - lookahead_days, at - 1)))
        .select("person_id", end_date().alias("end_date"))
        .distinct()
    )


def with_labels(windows: DataFrame, positives: DataFrame) -> DataFrame:
    hit = positives.withColumn("_hit", F.lit(1))
    return windows.join(hit, list(KEYS), "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


# --- token rows per window -------------------------------------------------------------------------


def window_tokens(tokens: DataFrame, calendar: DataFrame, window_days: int) -> DataFrame:
    """Token rows per window: (person_id, split, end_date, day, ts, stream_ord, tid, n)."""
    return in_windows(tokens.withColumn("day", F.to_date("ts")), calendar, window_days)


def merged_sequence(window_rows: DataFrame) -> DataFrame:
    """Chronological order of a window's tokens as ``seq`` = 1, 2, ...

    The running total is over counted rows (bounded per window); repeats are expanded only afterwards.
    """
    order = Window.partitionBy(*KEYS).orderBy("ts", "stream_ord", "tid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = window_rows.withColumn("last", F.sum("n").over(upto))
    return placed.withColumn("seq", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last")))).select(
        *KEYS, "seq", "ts", "stream_ord", "tid"
    )


def day_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("person_id", F.to_date("ts").alias("day")).agg(F.sum("n").alias("n"))


def day_index(window_days_rows: DataFrame, calendar_positions: bool = False, window_days: int = 30) -> DataFrame:
    """Position of each day that has tokens: dense index, or days since the window start."""
    if calendar_positions:
        pos = F.datediff("day", F.date_sub("end_date", window_days))
    else:
        # one row per (window, day), so at most window_days + 1 rows per partition
        pos = F.row_number().over(Window.partitionBy(*KEYS).orderBy("day")) - 1
    return window_days_rows.withColumn("position", pos.cast("int"))


def window_sizes(tokens: DataFrame, calendar: DataFrame, window_days: int, max_len: int) -> DataFrame:
    """Sequence length per non-empty window without building the sequence."""
    per_day = in_windows(day_counts(tokens), calendar, window_days)
    sums = per_day.groupBy(*KEYS, "split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))
    length = F.col("n") + F.col("days") - 1 + 2
    return sums.select(*KEYS, "split", F.least(length, F.lit(max_len)).cast("int").alias("n_tokens"))


# --- sequences -------------------------------------------------------------------------------------


def day_packs(tokens: DataFrame, max_len: int) -> DataFrame:
    """One row per person-day with its tokens in reading order: (person_id, day, ids).

    A day never needs more than its last ``max_len`` tokens, because the window keeps only its tail.
    """
    # collecting does not shrink anything before the shuffle, so rows are placed once and collected there
    placed = tokens.withColumn("day", F.to_date("ts")).repartition("person_id", "day")
    packed = placed.groupBy("person_id", "day").agg(
        F.sort_array(F.collect_list(F.struct("ts", "stream_ord", "tid", "n"))).alias("runs"),
        F.max("n").alias("most"),
    )
    repeated = F.flatten(
        F.transform("runs", lambda r: F.array_repeat(r["tid"], F.least(r["n"], F.lit(max_len)).cast("int")))
    )
    ids = F.when(F.col("most") == 1, F.col("runs.tid")).otherwise(repeated)
    # built in one projection and cut in the next, so the array is assembled once
    return packed.select("person_id", "day", ids.alias("ids")).withColumn("ids", tail(F.col("ids"), max_len))


def window_sequences(
    packs: DataFrame,
    calendar: DataFrame,
    window_days: int,
    max_len: int,
    calendar_positions: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """Token and position arrays per window: begin mark, days joined by separators, end mark, tail kept.

    ``only`` (person_id, end_date) restricts the windows that are built.
    """
    copies = in_windows(packs, calendar, window_days)
    if only is not None:
        copies = copies.join(only, list(KEYS), "left_semi")
    copies = copies.repartition(*KEYS)
    gathered = copies.groupBy(*KEYS, "split").agg(
        F.sort_array(F.collect_list(F.struct("day", "ids"))).alias("days")
    )
    return _assemble(gathered, max_len, window_days if calendar_positions else None)


def _assemble(gathered: DataFrame, max_len: int, window_days: int | None) -> DataFrame:
    def place(d, i):
        if window_days is None:
            return i.cast("int")
        return F.datediff(d["day"], F.date_sub(F.col("end_date"), window_days)).cast("int")

    def cut(d, i):
        sep = F.when(i > 0, F.array(F.lit(DAY_SEP))).otherwise(F.array().cast("array<int>"))
        return F.concat(sep, d["ids"])

    def spread(d, i):
        width = F.size(d["ids"]) + F.when(i > 0, 1).otherwise(0)
        return F.array_repeat(place(d, i), width)

    if window_days is None:
        last = F.size("days") - 1
    else:
        last = F.datediff(F.element_at("days", -1)["day"], F.date_sub("end_date", window_days))
    ids = F.concat(F.array(F.lit(BOS)), F.flatten(F.transform("days", cut)), F.array(F.lit(EOS)))
    positions = F.concat(F.array(F.lit(0)), F.flatten(F.transform("days", spread)), F.array(last))
    whole = gathered.select(*KEYS, "split", ids.alias("input_ids"), positions.alias("positions"))
    return truncate(whole, max_len)


def truncate(sequences: DataFrame, max_len: int) -> DataFrame:
    """Keep the tail of both arrays; positions are not re-based."""
    return sequences.withColumns(
        {"input_ids": tail(F.col("input_ids"), max_len), "positions": tail(F.col("positions"), max_len)}
    ).withColumn("n_tokens", F.size("input_ids"))


def padded(sequences: DataFrame, max_len: int) -> DataFrame:
    """Fixed-width rows for a model: ids and positions padded right with 0, and the attention mask."""
    return sequences.withColumns(
        {
            "attn_mask": attention_mask(F.col("input_ids"), max_len),
            "input_ids": pad_right(F.col("input_ids"), max_len),
            "positions": pad_right(F.col("positions"), max_len),
        }
    )


def id_range_violations(sequences: DataFrame, vocab_size: int | Column) -> DataFrame:
    """Windows that hold an id outside the vocabulary."""
    return sequences.withColumn("max_id", max_id(F.col("input_ids"))).where(F.col("max_id") >= vocab_size)


def id_range_report(sequences: DataFrame, vocab_size: int) -> DataFrame:
    """One row: windows, their highest id, the vocabulary's size and the windows that hold an id outside it."""
    top = sequences.select(max_id(F.col("input_ids")).alias("m"))
    return top.agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("m").alias("max_id"), F.lit(vocab_size).cast("long").alias("id_space"),
        F.count(F.when(F.col("m") >= vocab_size, 1)).alias("n_outside"),
    )


def trailing_window(
    samples: DataFrame, anchors: DataFrame, days: int = 30, strict_start: bool = True, strict_end: bool = True
) -> DataFrame:
    """Samples of the trailing period of each person's anchor ``at``.

    A strict edge asks that the sample's own edge lies inside the period; a loose one only that it overlaps.
    """
    start = F.col("at") - F.make_dt_interval(F.lit(days))
    first = F.col("start_ts") >= start if strict_start else F.col("end_ts") >= start
    last = F.col("end_ts") <= F.col("at") if strict_end else F.col("start_ts") <= F.col("at")
    return samples.join(anchors.select("person_id", "at"), "person_id").where(first & last)


def person_window(readings: DataFrame, requests: DataFrame, window_days: int = 30) -> DataFrame:
    """Readings with datetime between end - window_days and end (both midnights) of each requested window.

    A request is spread over its days and met by day, so a person's readings are never paired with windows
    they lie outside of.
    """
    first = F.date_sub("end_date", window_days)
    asked = requests.select(*KEYS, F.explode(F.sequence(first, F.col("end_date"))).alias("day"))
    met = readings.withColumn("day", F.to_date("datetime")).join(asked, ["person_id", "day"])
    return met.where(F.col("datetime") <= F.col("end_date").cast("timestamp")).drop("day")
