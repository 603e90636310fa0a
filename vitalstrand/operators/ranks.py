"""Exact ranks, samples and quantiles that never sort a whole table in one task.

Two ideas carry all of it. A hash order is split by the leading digits of the hash, which are uniform
by construction; a value order is split at approximate quantiles of its distinct values. In both cases
only one total per bucket is accumulated globally, and rows are ranked inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.session import stage

MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 200_000


def hash_text(seed, *cols) -> Column:
    """md5 of ``seed:col:col``; the same text in any engine gives the same order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def uniform(seed, *cols, digits: int = 8) -> Column:
    """Reproducible number in [0, 1) from the first ``digits`` hexadecimal digits of the hash; 13 fill a double."""
    return F.conv(F.substring(hash_text(seed, *cols), 1, digits), 16, 10).cast("double") / F.lit(16.0**digits)


def hash_digits(rows: int) -> int:
    """Leading hash digits that cut ``rows`` into buckets of at most about ``ROWS_PER_BUCKET``."""
    digits = 0
    while rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    return digits


def hash_ranked(df: DataFrame, key: Sequence[str], seed, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Add ``ordinal`` (0-based place in hash order inside ``by``) and ``group_size``.

    ``key`` must be unique inside ``by``. ``df`` is read twice, so pass a staged table when it is costly.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_text(seed, *key)).withColumn("_b", F.substring("_h", 1, digits))
    totals = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16**digits rows per group reach this window
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *key)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*by, "_b"])
        .withColumn("ordinal", F.col("_start") + F.col("_r") - 1)
        .drop("_h", "_b", "_r", "_start")
    )


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed, digits: int = 3) -> DataFrame:
    """Exactly the first ``n`` rows in hash order: a seeded sample without replacement."""
    return (
        hash_ranked(df, key, seed, digits=digits)
        .where(F.col("ordinal") < n)
        .drop("ordinal", "group_size")
    )


def cumulate(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running totals over ``value`` order: adds ``<c>_before`` and ``<c>_total`` for each of ``sums``.

    ``counts`` holds one row per (by, value), so a value shared by a third of the input is one row here.
    It must be a staged table: its row count decides how finely the order is cut.
    """
    by = list(by)
    counts = counts.where(F.col(value).isNotNull())
    group = by or [F.lit(0)]
    buckets = min(MAX_BUCKETS, counts.count() // rows_per_bucket + 1)
    splits: list[float] = []
    if buckets > 1:
        probs = [i / buckets for i in range(1, buckets)]
        splits = sorted(set(counts.approxQuantile(value, probs, 1.0 / (4 * buckets))))
    if not splits:
        whole = Window.partitionBy(*group)
        before = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        out = counts
        for c in sums:
            out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(before), F.lit(0)))
        for c in sums:
            out = out.withColumn(f"{c}_total", F.sum(c).over(whole))
        return out

    cutter = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_v", outputCol="_b", handleInvalid="keep")
    cut = cutter.transform(counts.withColumn("_v", F.col(value).cast("double"))).drop("_v")
    totals = cut.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_b",
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_off") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    before = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut
    for c in sums:
        out = out.withColumn(f"_{c}_in", F.coalesce(F.sum(c).over(before), F.lit(0)))
    out = out.join(offsets, [*by, "_b"])
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"_{c}_off") + F.col(f"_{c}_in"))
    return out.select(
        *counts.columns, *[f"{c}_before" for c in sums], *[f"{c}_total" for c in sums]
    )


def distribution(df: DataFrame, value: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Distinct values with ``n``, ``n_before`` (strictly smaller rows) and ``n_total``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return cumulate(stage(counts, "distribution"), value, ["n"], by, rows_per_bucket)


def _holding(dist: DataFrame, ranks: Column) -> DataFrame:
    """One row per wanted rank held by each distinct value; ``ranks`` is array<struct<q, k>>."""
    held = F.filter(ranks, lambda t: (t["k"] >= F.col("n_before")) & (t["k"] < F.col("n_before") + F.col("n")))
    return dist.withColumn("_hit", F.explode(held))


def order_statistics(dist: DataFrame, value: str, ranks: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """The values at 0-based ``ranks`` (expressions over ``n_total``), one column per name."""
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), k.cast("long").alias("k")) for name, k in ranks.items()])
    hits = _holding(dist, wanted)
    return hits.groupBy(*by).agg(
        F.max("n_total").alias("n"),
        *[F.max(F.when(F.col("_hit.q") == name, F.col(value))).alias(name) for name in ranks],
    )


def quantiles_linear(dist: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles (the numpy default), one column per name."""
    by = list(by)
    last = F.col("n_total") - 1
    ranks: dict[str, Column] = {}
    for name, q in probs.items():
        ranks[f"{name}_lo"] = F.floor(last * F.lit(q))
        ranks[f"{name}_hi"] = F.ceil(last * F.lit(q))
    picked = order_statistics(dist, value, ranks, by)
    at = F.col("n") - 1
    return picked.select(
        *by,
        "n",
        *[
            (
                F.col(f"{name}_lo")
                + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at * F.lit(q) - F.floor(at * F.lit(q)))
            ).alias(name)
            for name, q in probs.items()
        ],
    )
