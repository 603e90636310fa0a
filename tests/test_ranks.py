import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstrand.operators.ranks import (
    cumulate,
    distribution,
    hash_ranked,
    hash_sample,
    order_statistics,
    quantiles_linear,
    uniform,
)
from vitalstrand.operators.signals import decile_cuts, decile_of, encode_deciles, self_deciles
from vitalstrand.session import stage


def _md5(seed, *key):
    return hashlib.md5(":".join([str(seed), *map(str, key)]).encode()).hexdigest()


def test_hash_ranked_orders_each_group(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "id BIGINT, g STRING")
    got = {(r.g, r.id): (r.ordinal, r.group_size) for r in hash_ranked(df, ["id"], 5, ["g"], digits=1).collect()}
    for g in "ab":
        ids = sorted((i for i, x in rows if x == g), key=lambda i: _md5(5, i))
        assert [got[(g, i)] for i in ids] == [(k, len(ids)) for k in range(len(ids))]


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_hash_sample_is_exact(spark, n):
    df = spark.range(500)
    got = sorted(r.id for r in hash_sample(df, ["id"], n, 9).collect())
    assert got == sorted(sorted(range(500), key=lambda i: _md5(9, i))[:n])


def test_uniform_in_unit_interval(spark):
    stats = spark.range(4000).select(uniform(1, "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= stats[0] and stats[1] < 1 and abs(stats[2] - 0.5) < 0.03


@pytest.mark.parametrize("rows_per_bucket", [10, 1_000_000])
def test_cumulate_matches_sorted_prefix_sums(spark, rows_per_bucket):
    rng = np.random.default_rng(0)
    # a third of the rows share one value
    values = np.concatenate([np.full(300, 5.0), rng.normal(0, 100, 500).round(1), rng.exponential(1e6, 100)])
    df = spark.createDataFrame([(float(v), "x" if i % 2 else "y") for i, v in enumerate(values)], "v DOUBLE, g STRING")
    counts = stage(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "t")
    got = cumulate(counts, "v", ["n"], ["g"], rows_per_bucket).collect()
    for g, parity in (("x", 1), ("y", 0)):
        mine = np.sort(values[parity::2])
        for r in got:
            if r.g == g:
                assert r.n_before == int((mine < r.v).sum())
                assert r.n == int((mine == r.v).sum())
                assert r.n_total == len(mine)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 97, 400])
def test_quantiles_match_numpy(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(1)
    dist = distribution(spark.createDataFrame([(float(x),) for x in v], "v DOUBLE"), "v", rows_per_bucket=20)
    got = quantiles_linear(dist, "v", {"median": 0.5, "p95": 0.95}).first()
    assert got.n == n
    assert got.median == pytest.approx(np.median(v))
    assert got.p95 == pytest.approx(np.percentile(v, 95))
    pick = order_statistics(dist, "v", {"q": F.floor(F.col("n_total") / 2)}).first()
    assert pick.q == np.sort(v)[n // 2]


@pytest.mark.parametrize("n", [1, 3, 10, 11, 70, 97, 300])
def test_deciles_equal_right_sided_rank(spark, n):
    rng = np.random.default_rng(n)
    ref = np.sort(rng.integers(0, 40, n).astype(float))
    probe = np.concatenate([ref, rng.integers(-5, 45, 30).astype(float)])
    cuts = decile_cuts(spark.createDataFrame([("HR", float(v)) for v in ref], "stream STRING, v DOUBLE"))
    df = spark.createDataFrame([("HR", float(v)) for v in probe], "stream STRING, v DOUBLE")
    for r in encode_deciles(df, cuts).collect():
        expect = min(9, int(np.searchsorted(ref, r.v, side="right")) * 10 // n)
        assert r.dec == expect


def test_all_tied_reference(spark):
    cuts = decile_cuts(spark.createDataFrame([("HR", 4.0)] * 25, "stream STRING, v DOUBLE"))
    got = cuts.select(*[decile_of(F.lit(x), "cuts").alias(c) for c, x in (("lo", 3.9), ("eq", 4.0), ("hi", 4.1))]).first()
    assert tuple(got) == (0, 9, 9)


def test_self_deciles_left_rank(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in (1, 2) for v in rng.integers(0, 12, 37 * g)]
    out = self_deciles(spark.createDataFrame(rows, "g INT, v DOUBLE"), ["g"]).collect()
    for r in out:
        mine = sorted(v for g, v in rows if g == r.g)
        assert r.dec == min(9, mine.index(r.v) * 10 // len(mine))
        assert r.n == mine.count(r.v)
