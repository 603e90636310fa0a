"""Class balancing, reproducible draws, shuffles and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalstrand.operators.ranks import hash_ranked, hash_text, uniform


def class_weights(rows: DataFrame, label: str = "label", given: Mapping[int, float] | None = None) -> DataFrame:
    """One row: n, n_pos, pos_rate, weight_neg, weight_pos; ``given`` overrides the derived weights."""
    y = F.col(label)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("n_pos")
    ).withColumn("pos_rate", F.col("n_pos") / F.col("n"))
    p = F.col("pos_rate")
    derived = F.greatest(F.lit(1.0), (F.lit(1.0) - p) / F.greatest(p, F.lit(1e-6)))
    neg = F.lit(float(given[0])) if given else F.lit(1.0)
    pos = F.lit(float(given[1])) if given else derived
    return stats.select("n", "n_pos", "pos_rate", neg.alias("weight_neg"), pos.alias("weight_pos"))


def weighted_resample(
    rows: DataFrame,
    key: Sequence[str],
    seed,
    label: str = "label",
    given: Mapping[int, float] | None = None,
) -> DataFrame:
    """As many draws as rows, with replacement, each row weighted by its class.

    Every row also stands for one draw, which makes the draw count exact without numbering anything:
    its hash picks the class by total weight, a second hash picks the ordinal inside that class. Draws of
    the same row are merged before they meet the payload. ``rows`` should be a staged table.
    """
    key = list(key)
    w = class_weights(rows, label, given)
    mass_pos = F.col("n_pos") * F.col("weight_pos")
    mass = mass_pos + (F.col("n") - F.col("n_pos")) * F.col("weight_neg")
    odds = w.select("n", "n_pos", (mass_pos / mass).alias("share_pos"))
    drawn_label = F.when(uniform(f"{seed}:class", *key, digits=13) < F.col("share_pos"), 1).otherwise(0)
    draws = (
        rows.select(*key, F.lit(1).alias("_one"))
        .join(F.broadcast(odds.withColumn("_one", F.lit(1))), "_one")
        .withColumn("_label", drawn_label)
        .withColumn("_size", F.when(F.col("_label") == 1, F.col("n_pos")).otherwise(F.col("n") - F.col("n_pos")))
        .withColumn("ordinal", F.floor(uniform(f"{seed}:row", *key, digits=13) * F.col("_size")))
        .groupBy(F.col("_label").alias(label), "ordinal")
        .agg(F.count(F.lit(1)).alias("draws"))
    )
    placed = hash_ranked(rows, key, f"{seed}:order", [label])
    return placed.join(draws, [label, "ordinal"]).drop("ordinal", "group_size")


def expand_draws(drawn: DataFrame) -> DataFrame:
    """One row per draw."""
    return drawn.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws")))).drop("draws")


def seeded_shuffle(rows: DataFrame, key: Sequence[str], seed, by: Sequence[str] = ()) -> DataFrame:
    """Add ``ordinal``, the row's place in a reproducible random order."""
    return hash_ranked(rows, key, seed, by).drop("group_size")


def batch_assign(
    rows: DataFrame, key: Sequence[str], size: int, seed, by: Sequence[str] = ("split",), drop_last: bool = True
) -> DataFrame:
    """Add ``batch`` and ``slot``; an incomplete last batch is dropped on request."""
    ranked = hash_ranked(rows, key, seed, by)
    batched = ranked.withColumn("batch", F.floor(F.col("ordinal") / size)).withColumn("slot", F.col("ordinal") % size)
    if drop_last:
        batched = batched.where(F.col("batch") < F.floor(F.col("group_size") / size))
    return batched.drop("ordinal", "group_size")


def head_pos_rate(rows: DataFrame, order: Sequence[str] = (), n: int | None = None, label: str = "label") -> DataFrame:
    """Positive rate of all rows, or of the first ``n`` in key order."""
    head = rows.select(label) if n is None else rows.select(*order, label).orderBy(*order).limit(n)
    return head.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("pos_rate"))


def _hash_int(seed: str, key: Sequence[str], extra: Column, bound: int) -> Column:
    h = F.conv(F.substring(hash_text(seed, *key, extra.cast("string")), 1, 8), 16, 10).cast("long")
    return (h % F.lit(bound)).cast("int")


def probe_rows(
    keys: DataFrame, key: Sequence[str], max_len: int, vocab_size: int, min_len: int, seed, day_span: int = 32
) -> DataFrame:
    """A random full-width model input per key: ids, positions, mask with a random real length."""
    key = list(key)
    slots = F.sequence(F.lit(0), F.lit(max_len - 1))
    n_real = F.lit(min_len) + _hash_int(f"{seed}:len", key, F.lit("n"), max_len - min_len)
    return keys.select(
        *key,
        F.transform(slots, lambda i: _hash_int(f"{seed}:ids", key, i, vocab_size)).alias("input_ids"),
        F.transform(slots, lambda i: _hash_int(f"{seed}:pos", key, i, day_span)).alias("positions"),
        n_real.alias("n_real"),
    ).withColumn("attn_mask", F.transform(slots, lambda i: i < F.col("n_real")))
