"""Binning of wearable streams and their quantile encoding."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.functions.scalars import bin_start, noon
from vitalstrand.operators.ranks import cumulate, distribution, hash_sample, order_statistics
from vitalstrand.session import stage

VALUE_SCALE = 9


def mean_value(col: str) -> Column:
    return F.round(F.avg(col), VALUE_SCALE)


def total_value(col: str) -> Column:
    return F.round(F.sum(col), VALUE_SCALE)


def hr_bin_sums(hr: DataFrame, minutes: int = 5) -> DataFrame:
    """Readings and their sum per person and bin; ``ts`` is the bin start."""
    v = F.col("heart_rate_value")
    return (
        hr.where(v.isNotNull())
        .groupBy("person_id", bin_start("datetime", minutes).alias("ts"))
        .agg(F.count(v).alias("n"), F.sum(v).alias("s"))
    )


def hr_bins(sums: DataFrame) -> DataFrame:
    """Mean heart rate per person and bin."""
    return sums.select("person_id", "ts", F.round(F.col("s") / F.col("n"), VALUE_SCALE).alias("v"))


def hr_pooled(sums: DataFrame, minutes: int = 5) -> DataFrame:
    """Mean per (person, day, minute slot) pooling all hours of the day, from the bin sums."""
    slot = F.floor(F.minute("ts") / F.lit(minutes)).cast("int")
    return sums.groupBy("person_id", F.to_date("ts").alias("day"), slot.alias("slot")).agg(
        F.round(F.sum("s") / F.sum("n"), VALUE_SCALE).alias("v")
    )


def steps_daily(steps: DataFrame) -> DataFrame:
    """Daily step total stamped at noon."""
    return (
        steps.where(F.col("steps").isNotNull())
        .groupBy("person_id", F.to_date("datetime").alias("day"))
        .agg(total_value("steps").alias("v"))
        .withColumn("ts", noon("day"))
    )


def daily_totals_filled(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """Daily totals on an unbroken calendar from ``first_day`` to ``last_day``; a missing day is 0."""
    days = spans.where(F.col("first_day") <= F.col("last_day")).select(
        "person_id", F.explode(F.sequence("first_day", "last_day")).alias("day")
    )
    totals = steps_daily(steps).select("person_id", "day", "v")
    return days.join(totals, ["person_id", "day"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


# --- quantile reference ----------------------------------------------------------------------------


def bounded_reference(values: DataFrame, key: list[str], limit: int | None, seed: int) -> DataFrame:
    """At most ``limit`` reference rows, chosen by hash rank rather than by arrival."""
    if limit is None:
        return values
    values = stage(values, "reference")
    return values if values.count() <= limit else hash_sample(values, key, limit, seed)


def hr_reference(sums: DataFrame, minutes: int, pool_hours: bool, limit: int | None, seed: int) -> DataFrame:
    """Heart-rate values the decile cuts are taken from: (stream, v)."""
    if pool_hours:
        values, key = hr_pooled(sums, minutes), ["person_id", "day", "slot"]
    else:
        values, key = hr_bins(sums), ["person_id", "ts"]
    return bounded_reference(values, key, limit, seed).select(F.lit("HR").alias("stream"), "v")


def decile_cuts(reference: DataFrame, by: str = "stream", value: str = "v") -> DataFrame:
    """Nine exact cut points per stream: cut ``d`` is the value at rank ceil(d*n/10).

    ``v >= cut[d]`` holds exactly when at least d tenths of the reference are <= v, so counting the cuts
    at or below a value equals its right-sided rank decile without shipping the reference.
    """
    dist = distribution(reference, value, [by])
    ranks = {f"c{d}": F.floor((F.col("n_total") * d + 9) / 10) - 1 for d in range(1, 10)}
    picked = order_statistics(dist, value, ranks, [by])
    return picked.select(by, "n", F.array(*[F.col(f"c{d}") for d in range(1, 10)]).alias("cuts"))


def decile_of(value: str | Column, cuts: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    c = F.col(cuts) if isinstance(cuts, str) else cuts
    return reduce(add, [(v >= c[i]).cast("int") for i in range(9)])


def encode_deciles(binned: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``dec`` to rows of (stream, v, ...); the cuts hold one row per stream, which bounds the broadcast."""
    joined = binned.join(F.broadcast(cuts.select("stream", "cuts")), "stream")
    return joined.withColumn("dec", decile_of("v", "cuts")).drop("cuts")


def reference_summary(reference: DataFrame, by: str = "stream", value: str = "v") -> DataFrame:
    """n and the values at sorted index n//10, n//2 and 9n//10."""
    n = F.col("n_total")
    ranks = {"q10": F.floor(n / 10), "q50": F.floor(n / 2), "q90": F.floor(n * 9 / 10)}
    return order_statistics(distribution(reference, value, [by]), value, ranks, [by])


def self_deciles(values: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Decile of each value within its own group, left-ranked: (by, value, n, dec)."""
    counts = stage(values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "self-deciles")
    ranked = cumulate(counts, value, ["n"], by)
    dec = F.least(F.lit(9), F.floor(F.col("n_before") * 10 / F.col("n_total")))
    return ranked.select(*by, value, "n", dec.cast("int").alias("dec"))


# --- variability proxy -----------------------------------------------------------------------------


MOMENTS = "struct<n: bigint, mean: double, m2: double>"


def _merged(a: str, b: str) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two groups together; a missing group counts as empty."""
    na, nb = (F.coalesce(F.col(f"{x}.n"), F.lit(0)) for x in (a, b))
    ma, mb = (F.coalesce(F.col(f"{x}.mean"), F.lit(0.0)) for x in (a, b))
    qa, qb = (F.coalesce(F.col(f"{x}.m2"), F.lit(0.0)) for x in (a, b))
    n = na + nb
    mean = F.when(n > 0, ma + (mb - ma) * nb / n)
    return n, mean, F.when(n > 0, qa + qb + (mb - ma) * (mb - ma) * na * nb / n)


def rolling_std(hr: DataFrame, minutes: int) -> DataFrame:
    """Trailing standard deviation at each reading: (person_id, datetime, n, std), ``n`` readings in the period.

    Time is cut into blocks as long as the period, so a period is the end of one block and the beginning of the next.
    Centred moments (count, mean, squared deviations) run forward and backward inside a block and the two are merged
    pairwise, so nothing large is subtracted and a reading costs the same however long the period is. No task needs
    more than two blocks of a person.
    """
    reach = minutes * 60 * 1_000_000
    v = F.col("heart_rate_value").cast("double")
    points = hr.where(v.isNotNull()).select("person_id", "datetime", v.alias("v"), F.unix_micros("datetime").alias("us"))
    points = points.withColumn("block", F.floor(F.col("us") / F.lit(reach)))

    def moments(order: Column) -> Column:
        run = Window.partitionBy("person_id", "block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        n = F.count("v").over(run)
        return F.struct(n.alias("n"), F.avg("v").over(run).alias("mean"), (F.var_pop("v").over(run) * n).alias("m2"))

    both = points.select(
        "person_id", "datetime", "us", "block", moments(F.col("us").asc()).alias("since"), moments(F.col("us").desc()).alias("until")
    )
    # what follows a reading in its block leaves the periods after this reading's time plus the length of a period
    leaving = both.select(
        "person_id",
        F.lit(None).cast("timestamp").alias("datetime"),
        (F.col("us") + reach).alias("us"),
        (F.col("block") + 1).alias("block"),
        F.lit(None).cast(MOMENTS).alias("since"),
        "until",
    )
    own = both.withColumn("datetime", F.col("datetime").cast("timestamp")).withColumn("until", F.lit(None).cast(MOMENTS))
    ahead = Window.partitionBy("person_id", "block").orderBy(F.col("us").desc()).rangeBetween(Window.unboundedPreceding, 0)
    met = own.unionByName(leaving).withColumn("still", F.last("until", ignorenulls=True).over(ahead)).where(F.col("since").isNotNull())
    n, _, m2 = _merged("still", "since")
    return met.select("person_id", "datetime", n.alias("n"), F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"))


def hrv_daily(hr: DataFrame, minutes: int) -> DataFrame:
    """Daily mean of the rolling deviation, stamped at noon like the steps."""
    rolled = rolling_std(hr, minutes).where(F.col("std").isNotNull())
    return (
        rolled.groupBy("person_id", F.to_date("datetime").alias("day"))
        .agg(F.round(F.avg("std"), 6).alias("v"))
        .withColumn("ts", noon("day"))
    )


# --- sleep -----------------------------------------------------------------------------------------


def sleep_percent(segments: DataFrame) -> DataFrame:
    """REM and deep share of each night, in whole percent; a night is named by its waking day."""
    seconds = (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")).cast("long")
    asleep = F.col("stage") != "AWAKE"
    night = F.to_date(F.timestamp_seconds(F.unix_seconds("start_ts") + 43_200))

    def share(stage_name: str) -> Column:
        part = F.sum(F.when(F.col("stage") == stage_name, seconds).otherwise(0))
        return F.floor(part * 100 / F.sum(F.when(asleep, seconds)))

    return (
        segments.groupBy("person_id", night.alias("night"))
        .agg(share("REM").alias("rem_pct"), share("DEEP").alias("deep_pct"))
        .where(F.col("rem_pct").isNotNull())
        .withColumn("rem_token", F.concat(F.lit("SLEEP_REM_"), F.col("rem_pct").cast("string")))
        .withColumn("deep_token", F.concat(F.lit("SLEEP_DEEP_"), F.col("deep_pct").cast("string")))
    )
