"""Per-person risk surface built from scored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.functions.scalars import report_text, risk_band, risk_points, sigmoid, trend_text
from vitalstrand.operators.ranks import distribution, order_statistics



def _history():
    # a person has at most one window per calendar day, which bounds the partition
    return Window.partitionBy("person_id").orderBy("end_date")


def with_prob(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prob", sigmoid("logit"))


def risk_trend(risks: DataFrame) -> DataFrame:
    """Change against the person's previous window; 0 when there is none."""
    before = F.lag("prob").over(_history())
    return risks.withColumn("trend_delta", F.coalesce(F.col("prob") - before, F.lit(0.0)))


def risk_sparkline(risks: DataFrame, days: int = 30) -> DataFrame:
    """Risks of the last ``days`` days up to each window, oldest first."""
    day = F.datediff("end_date", F.lit("1970-01-01").cast("date"))
    recent = Window.partitionBy("person_id").orderBy(day).rangeBetween(-(days - 1), 0)
    points = F.sort_array(F.collect_list(F.struct("end_date", "prob")).over(recent))
    return risks.withColumn("sparkline", F.transform(points, lambda p: p["prob"]))


def percentile_cuts(train: DataFrame, steps: int = 100) -> DataFrame:
    """``steps - 1`` cut points of the training risks, as one row."""
    dist = distribution(train, "prob")
    n = F.col("n_total")
    ranks = {f"c{d}": F.floor((n * d + (steps - 1)) / steps) - 1 for d in range(1, steps)}
    return order_statistics(dist, "prob", ranks).select(F.array(*[F.col(c) for c in ranks]).alias("cuts"))


def risk_percentile(risks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Percentile of a risk within the training distribution; ``cuts`` is a single row."""
    one = cuts.withColumn("_one", F.lit(1))
    return (
        risks.withColumn("_one", F.lit(1))
        .join(F.broadcast(one), "_one")
        .withColumn("percentile", F.size(F.filter("cuts", lambda c: F.col("prob") >= c)))
        .drop("_one", "cuts")
    )


def top_drivers(contributions: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` tokens with the largest absolute contribution per window, ties by id."""
    order = Window.partitionBy("person_id", "end_date").orderBy(F.desc(F.abs("contribution")), "tid")
    return contributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def risk_report(risks: DataFrame, drivers: DataFrame) -> DataFrame:
    """Report per window: score, points, band, trend, drivers and text."""
    listed = drivers.groupBy("person_id", "end_date").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("label"), "contribution"))).alias("_d")
    )
    top = F.transform("_d", lambda d: F.struct(d["label"].alias("label"), d["contribution"].alias("contribution")))
    return (
        risk_trend(risks)
        .join(listed, ["person_id", "end_date"], "left")
        .select(
            "person_id",
            "end_date",
            F.col("prob").alias("risk_score"),
            risk_points("prob").alias("points"),
            risk_band("prob").alias("band"),
            "trend_delta",
            trend_text("trend_delta").alias("trend_text"),
            top.alias("top_features"),
            F.transform("_d", lambda d: d["label"]).alias("_labels"),
        )
        .withColumn("text", report_text("points", "_labels"))
        .drop("_labels")
    )


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest report per person, as a combining aggregate."""
    cols = [c for c in reports.columns if c != "person_id"]
    newest = F.max_by(F.struct(*cols), "end_date")
    return reports.groupBy("person_id").agg(newest.alias("_r")).select("person_id", "_r.*")
