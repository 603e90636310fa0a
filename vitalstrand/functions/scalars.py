"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalstrand.config import INPATIENT_VISITS, RISK_BAND_TOP, RISK_BANDS


def encounter_type(visit_concept: str | Column) -> Column:
    col = F.col(visit_concept) if isinstance(visit_concept, str) else visit_concept
    return F.when(col.isin(*INPATIENT_VISITS), "inpatient").otherwise("outpatient")


def bin_start(ts: str | Column, minutes: int) -> Column:
    """Start of the ``minutes``-long bin that holds ``ts``."""
    width = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(width)) * F.lit(width))


def noon(day: str | Column) -> Column:
    col = F.col(day) if isinstance(day, str) else day
    return col.cast("timestamp") + F.expr("INTERVAL 12 HOURS")


def token_text(prefix: str, code: str | Column, chars: int | None = None) -> Column:
    col = F.col(code) if isinstance(code, str) else code
    return F.concat(F.lit(f"{prefix}:"), F.substring(col, 1, chars) if chars else col)


def sigmoid(logit: str | Column) -> Column:
    col = F.col(logit) if isinstance(logit, str) else logit
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def bce_with_logits(logit: str | Column, y: str | Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy on a logit, stable for large magnitudes."""
    x = F.col(logit) if isinstance(logit, str) else logit
    t = (F.col(y) if isinstance(y, str) else y).cast("double")
    if pos_weight == 1.0:
        return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    softplus_neg = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return (F.lit(1.0) - t) * x + (F.lit(1.0) + F.lit(pos_weight - 1.0) * t) * softplus_neg


def risk_points(prob: str | Column) -> Column:
    col = F.col(prob) if isinstance(prob, str) else prob
    return F.floor(col * 100).cast("long")


def risk_band(prob: str | Column) -> Column:
    col = F.col(prob) if isinstance(prob, str) else prob
    chain = None
    for upper, name in RISK_BANDS:
        chain = F.when(col < upper, name) if chain is None else chain.when(col < upper, name)
    return chain.otherwise(RISK_BAND_TOP)


def hashed_code(prefix: str, code: str | Column, base: int = 1000, buckets: int = 9000) -> Column:
    """Bucket a code into ``base .. base + buckets - 1`` with an engine-neutral hash."""
    col = F.col(code) if isinstance(code, str) else code
    head = F.substring(F.md5(F.concat(F.lit(f"{prefix}:"), col)), 1, 8)
    return (F.lit(base) + F.conv(head, 16, 10).cast("long") % F.lit(buckets)).cast("long")


def record_field(json: str | Column, path: str) -> Column:
    """A field of a clinical record kept as JSON text."""
    return F.get_json_object(json, path)


def signed_points(delta: str | Column) -> Column:
    """``delta`` x 100 as signed whole points, ties to even."""
    col = F.col(delta) if isinstance(delta, str) else delta
    points = F.bround(col * 100, 0).cast("long")
    sign = F.when((points < 0) | ((points == 0) & (col < 0)), "-").otherwise("+")
    return F.concat(sign, F.abs(points).cast("string"))


def report_text(points: str, drivers: str) -> Column:
    """Plain-language summary of a report; ``drivers`` is array<string>."""
    bullets = F.array_join(F.transform(F.col(drivers), lambda d: F.concat(F.lit("• "), d)), "\n")
    return F.concat(
        F.lit("Estimated 30-day risk: "),
        F.col(points).cast("string"),
        F.lit(" of 100 points.\nStrongest factors in this window:\n"),
        bullets,
        F.lit("\nAn estimate from recorded data and no diagnosis; talk to a clinician about it."),
    )


def trend_text(delta: str | Column) -> Column:
    return F.concat(signed_points(delta), F.lit(" points since the window before"))
