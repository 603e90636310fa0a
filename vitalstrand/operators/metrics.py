"""Ranking metrics, calibration and epoch selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.config import CALIBRATION_GAP
from vitalstrand.functions.scalars import bce_with_logits, sigmoid
from vitalstrand.operators.ranks import ROWS_PER_BUCKET, cumulate
from vitalstrand.session import stage


def score_curve(
    scored: DataFrame, score: str, label: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Distinct scores with their positives and negatives and the running totals below each score."""
    y = F.col(label)
    counts = (
        scored.where(F.col(score).isNotNull())
        .groupBy(*by, score)
        .agg(
            F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
            F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"),
        )
    )
    return cumulate(stage(counts, "score-curve"), score, ["pos", "neg"], by, rows_per_bucket)


def _auroc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return wins / F.nullif(F.max(F.col("pos_total").cast("double") * F.col("neg_total")), F.lit(0.0))


def _average_precision() -> Column:
    pos_upto = F.col("pos_total") - F.col("pos_before")
    all_upto = pos_upto + F.col("neg_total") - F.col("neg_before")
    return F.sum(F.col("pos") * pos_upto / all_upto) / F.nullif(F.max("pos_total"), F.lit(0))


def auroc(scored: DataFrame, score: str, label: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing."""
    return score_curve(scored, score, label, by, **kw).groupBy(*by).agg(_auroc().alias("auroc"))


def average_precision(scored: DataFrame, score: str, label: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Step-wise average precision over distinct thresholds."""
    return score_curve(scored, score, label, by, **kw).groupBy(*by).agg(_average_precision().alias("auprc"))


def evaluate(scored: DataFrame, by: Sequence[str] = (), logit: str = "logit", label: str = "y") -> DataFrame:
    """auroc, auprc, pos_rate, mean_pred_prob and n per group, all from one pass over distinct logits."""
    by = list(by)
    curve = score_curve(scored, logit, label, by)
    rows = F.col("pos") + F.col("neg")
    return curve.groupBy(*by).agg(
        _auroc().alias("auroc"),
        _average_precision().alias("auprc"),
        (F.sum("pos") / F.sum(rows)).alias("pos_rate"),
        (F.sum(sigmoid(logit) * rows) / F.sum(rows)).alias("mean_pred_prob"),
        F.sum(rows).alias("n"),
    )


def best_epoch(log: DataFrame) -> DataFrame:
    """The epoch with the strictly greatest AUROC above 0, the earliest on a tie."""
    usable = log.where(F.col("auroc") > 0)
    order = Window.orderBy(F.desc("auroc"), "epoch")
    # one row per epoch
    return usable.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def epoch_loss(scored: DataFrame, by: str = "epoch", logit: str = "logit", label: str = "y") -> DataFrame:
    loss = bce_with_logits(logit, label)
    return scored.groupBy(by).agg(
        (F.sum(loss) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("train_loss"), F.count(F.lit(1)).alias("n_seen")
    )


def calibration(scored: DataFrame, by: Sequence[str], logit: str = "logit", label: str = "y") -> DataFrame:
    """Gap between mean predicted probability and positive rate, flagged when too wide."""
    return (
        scored.groupBy(*by)
        .agg(
            F.avg(sigmoid(logit)).alias("mean_pred_prob"),
            F.avg(F.col(label).cast("double")).alias("pos_rate"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("cal_gap", F.abs(F.col("mean_pred_prob") - F.col("pos_rate")))
        .withColumn("flagged", F.col("cal_gap") > CALIBRATION_GAP)
    )
