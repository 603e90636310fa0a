import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstrand.functions.scalars import bce_with_logits, risk_band, risk_points, signed_points
from vitalstrand.operators import audit, metrics


def brute_auroc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(score, y):
    total, before = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        total += (recall - before) * (y[hit] == 1).mean()
        before = recall
    return total


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(4)
    score = np.concatenate([np.full(200, 0.25), rng.normal(size=300).round(1)])
    y = (rng.random(500) < 0.3).astype(int)
    return score, y


@pytest.mark.parametrize("rows_per_bucket", [7, 1_000_000])
def test_ranking_metrics(spark, scored, rows_per_bucket):
    score, y = scored
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "s DOUBLE, y INT")
    kw = {"rows_per_bucket": rows_per_bucket}
    a = metrics.auroc(df, "s", "y", **kw).first()[0]
    assert a == pytest.approx(brute_auroc(score, y))
    assert metrics.average_precision(df, "s", "y", **kw).first()[0] == pytest.approx(brute_ap(score, y))
    flipped = metrics.auroc(df.withColumn("s", -F.col("s")), "s", "y", **kw).first()[0]
    assert flipped == pytest.approx(1 - a)


def test_single_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s DOUBLE, y INT")
    assert metrics.auroc(df, "s", "y").first()[0] is None
    none = df.withColumn("y", F.lit(0))
    assert metrics.average_precision(none, "s", "y").first()[0] is None


def test_best_epoch_strict_and_first(spark):
    log = spark.createDataFrame([(0, 0.6), (1, 0.7), (2, 0.7), (3, None), (4, 0.0)], "epoch INT, auroc DOUBLE")
    assert metrics.best_epoch(log).first().epoch == 1
    assert metrics.best_epoch(log.where("epoch = 4")).count() == 0


def test_bce_is_stable(spark):
    df = spark.createDataFrame([(800.0, 0), (-800.0, 1), (0.0, 1), (2.0, 1)], "x DOUBLE, y INT")
    got = [r[0] for r in df.select(bce_with_logits("x", "y")).collect()]
    assert got == pytest.approx([800.0, 800.0, np.log(2), np.log1p(np.exp(-2))])
    three = [r[0] for r in df.select(bce_with_logits("x", "y", 3.0)).collect()]
    assert three == pytest.approx([800.0, 2400.0, 3 * np.log(2), 3 * np.log1p(np.exp(-2))])


def test_risk_display(spark):
    df = spark.createDataFrame([(0.0,), (0.199,), (0.2,), (0.5,), (0.75,), (0.999,)], "p DOUBLE")
    rows = df.select(risk_points("p"), risk_band("p")).collect()
    assert [tuple(r) for r in rows] == [
        (0, "low"), (19, "low"), (20, "moderate"), (50, "elevated"), (75, "high"), (99, "high"),
    ]
    d = spark.createDataFrame([(0.025,), (-0.035,), (0.0,), (-0.001,), (0.12,)], "d DOUBLE")
    assert [r[0] for r in d.select(signed_points("d")).collect()] == ["+2", "-4", "+0", "-0", "+12"]


def test_audit_caps_and_verdict(spark):
    rng = np.random.default_rng(1)
    rows = [("train", i, float(v)) for i, v in enumerate(rng.random(60).round(3))]
    rows += [("val", 1000 + i, float(v)) for i, v in enumerate(rng.random(40).round(3) + 0.5)]
    losses = spark.createDataFrame(rows, "split STRING, person_id BIGINT, loss DOUBLE")
    members = audit.membership(losses, 50).cache()
    got = audit.mia_audit(members).first()
    tr = np.array([r[2] for r in rows[:50]])
    va = np.array([r[2] for r in rows[60:]])
    score, y = -np.concatenate([tr, va]), np.array([1] * 50 + [0] * 40)
    assert (got.n_train_members, got.n_val_nonmembers) == (50, 40)
    assert got.mia_holdout_auroc == pytest.approx(brute_auroc(score, y))
    assert got.median_loss_diff == pytest.approx(np.median(va) - np.median(tr))
    assert got.p95_loss_diff == pytest.approx(np.percentile(va, 95) - np.percentile(tr, 95))
    assert got.passes is False


def test_parity(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=20)
    b = a + rng.normal(scale=0.01, size=20)
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "k INT, logit DOUBLE")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "k INT, logit DOUBLE")
    got = audit.score_parity(left, right, ["k"]).first()
    d = np.abs(a - b)
    assert got.n_probes == 20 and got.passes is True
    assert got.max_abs_delta == pytest.approx(d.max(), abs=1e-9)
    assert got.mean_abs_delta == pytest.approx(d.mean(), abs=1e-9)
    assert got.p95_abs_delta == pytest.approx(np.percentile(d, 95), abs=1e-9)
