import pytest
from pyspark.sql import functions as F

from vitalstrand.operators import sampling as sa
from vitalstrand.session import stage


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit("train").alias("split"))
    return stage(df, "rows")


def test_class_weights(rows, spark):
    w = sa.class_weights(rows).first()
    assert (w.n, w.n_pos, w.weight_neg) == (4000, 400, 1.0) and w.weight_pos == pytest.approx(9.0)
    given = sa.class_weights(rows, given={0: 2.0, 1: 3.0}).first()
    assert (given.weight_neg, given.weight_pos) == (2.0, 3.0)
    none = sa.class_weights(rows.where("label = 0")).first()
    assert none.weight_pos == pytest.approx(1e6)


def test_resample_size_balance_and_replacement(rows):
    drawn = sa.weighted_resample(rows, ["k"], 3)
    stats = {r.label: r.n for r in drawn.groupBy("label").agg(F.sum("draws").alias("n")).collect()}
    assert stats[0] + stats[1] == 4000
    assert abs(stats[1] / 4000 - 0.5) < 0.03
    assert drawn.agg(F.max("draws")).first()[0] > 1
    assert sa.expand_draws(drawn).count() == 4000
    assert drawn.join(rows, ["k", "label"], "left_anti").count() == 0
    again = sa.weighted_resample(rows.repartition(5), ["k"], 3)
    assert {tuple(r) for r in again.select("k", "draws").collect()} == {tuple(r) for r in drawn.select("k", "draws").collect()}


def test_single_class_resample(rows):
    only = rows.where("label = 0")
    assert sa.weighted_resample(only, ["k"], 3).agg(F.sum("draws")).first()[0] == only.count()


def test_shuffle_is_a_permutation(rows):
    got = sorted(r.ordinal for r in sa.seeded_shuffle(rows, ["k"], 1).collect())
    assert got == list(range(4000))


def test_batches(rows):
    full = sa.batch_assign(rows, ["k"], 64, 1)
    sizes = [r["count"] for r in full.groupBy("batch").count().collect()]
    assert len(sizes) == 62 and set(sizes) == {64}
    assert sa.batch_assign(rows, ["k"], 64, 1, drop_last=False).count() == 4000


def test_head_pos_rate(rows):
    r = sa.head_pos_rate(rows, ["k"], 15).first()
    assert (r.n, r.pos_rate) == (15, pytest.approx(2 / 15))


def test_probe_rows(spark):
    got = sa.probe_rows(spark.range(5), ["id"], 32, 100, 4, 1).collect()
    for r in got:
        assert len(r.input_ids) == len(r.positions) == len(r.attn_mask) == 32
        assert 0 <= min(r.input_ids) and max(r.input_ids) < 100 and max(r.positions) < 32
        assert 4 <= r.n_real < 32 and sum(r.attn_mask) == r.n_real
    assert len({tuple(r.input_ids) for r in got}) == 5
