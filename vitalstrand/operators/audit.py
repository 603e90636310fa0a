"""Membership-inference audit and score parity. Reports hold aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.config import AUDIT_MAX_AUROC, AUDIT_MAX_P95_DIFF, PARITY_TOLERANCE
from vitalstrand.functions.scalars import bce_with_logits
from vitalstrand.operators.metrics import auroc
from vitalstrand.operators.ranks import distribution, quantiles_linear


def fingerprint(rows: DataFrame, artefact: str) -> DataFrame:
    """One row (artefact, n_rows, hash_sum, hash_xor) that names the rows of a table whatever their order and partitions.

    Sum and xor of row hashes combine before the shuffle; repeated rows count in the sum. Columns enter by name.
    """
    columns = sorted(rows.columns)
    h = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    return rows.agg(
        F.lit(artefact).alias("artefact"), F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("hash_xor"),
    )


def leakage(fitted: DataFrame, allowed: DataFrame) -> DataFrame:
    """(artefact, n_rows, n_allowed, leaked): whether an artefact was fitted on other rows than it may read."""
    other = allowed.select("artefact", F.col("n_rows").alias("n_allowed"), F.struct("n_rows", "hash_sum", "hash_xor").alias("_may"))
    both = fitted.join(other, "artefact", "left")
    same = F.struct("n_rows", "hash_sum", "hash_xor").eqNullSafe(F.col("_may"))
    return both.select("artefact", "n_rows", "n_allowed", (~same).alias("leaked"))


def cap_persons(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` persons by id; each kept person keeps every row."""
    first = rows.select("person_id").distinct().orderBy("person_id").limit(n)
    return rows.join(first, "person_id", "left_semi")


def person_loss(scored: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    return scored.groupBy("split", "person_id").agg(
        F.avg(bce_with_logits(logit, label)).alias("loss"), F.count(F.lit(1)).alias("n_windows")
    )


def membership(losses: DataFrame, cap: int | None = None) -> DataFrame:
    """Per-person losses of members (train) and non-members (val); ``cap`` keeps that many persons of each side."""
    sides = [(losses.where(F.col("split") == s), m) for s, m in (("train", 1), ("val", 0))]
    sides = sides if cap is None else [(cap_persons(df, cap), m) for df, m in sides]
    parts = [df.select("person_id", F.lit(m).alias("is_member"), "loss") for df, m in sides]
    return parts[0].unionByName(parts[1])


def attack_auroc(members: DataFrame) -> DataFrame:
    """How well a low loss tells members apart: AUROC of the negated loss."""
    return auroc(members.withColumn("score", F.round(-F.col("loss"), 12)), "score", "is_member")


def loss_quantiles(losses: DataFrame, by: str) -> DataFrame:
    dist = distribution(losses, "loss", [by])
    return quantiles_linear(dist, "loss", {"median": 0.5, "p95": 0.95}, [by])


def mia_audit(members: DataFrame) -> DataFrame:
    """One-row audit report with its verdict; ``members`` should be a staged table."""
    q = loss_quantiles(members, "is_member")
    sides = q.agg(
        *[
            F.max(F.when(F.col("is_member") == side, F.col(c))).alias(f"{c}_{side}")
            for side in (0, 1)
            for c in ("n", "median", "p95")
        ]
    )
    both = sides.withColumn("_one", F.lit(1)).join(attack_auroc(members).withColumn("_one", F.lit(1)), "_one")
    p95 = F.col("p95_0") - F.col("p95_1")
    return both.select(
        F.col("n_1").alias("n_train_members"),
        F.col("n_0").alias("n_val_nonmembers"),
        F.col("auroc").alias("mia_holdout_auroc"),
        (F.col("median_0") - F.col("median_1")).alias("median_loss_diff"),
        p95.alias("p95_loss_diff"),
        F.lit(AUDIT_MAX_AUROC).alias("max_auroc"),
        F.lit(AUDIT_MAX_P95_DIFF).alias("max_p95_diff"),
        ((F.col("auroc") < AUDIT_MAX_AUROC) & (F.abs(p95) < AUDIT_MAX_P95_DIFF)).alias("passes"),
    )


def score_parity(left: DataFrame, right: DataFrame, key: list[str], score: str = "logit", tolerance: float = PARITY_TOLERANCE) -> DataFrame:
    """Compare two scorings of the same rows: max, mean and p95 of the absolute difference, and a verdict."""
    pairs = left.select(*key, F.col(score).alias("_a")).join(right.select(*key, F.col(score).alias("_b")), key)
    deltas = pairs.select(F.round(F.abs(F.col("_a") - F.col("_b")), 12).alias("delta"))
    dist = distribution(deltas, "delta")
    p95 = quantiles_linear(dist, "delta", {"p95_abs_delta": 0.95})
    means = dist.agg(
        F.max("delta").alias("max_abs_delta"), (F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("mean_abs_delta")
    )
    one = F.lit(1).alias("_one")
    both = p95.select("*", one).join(means.select("*", one), "_one").drop("_one")
    return both.select(
        F.col("n").alias("n_probes"),
        "max_abs_delta",
        "mean_abs_delta",
        "p95_abs_delta",
        F.lit(tolerance).alias("tolerance"),
        (F.col("max_abs_delta") < tolerance).alias("passes"),
    )
