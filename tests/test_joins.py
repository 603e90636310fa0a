"""Joins with hot keys against the plain join, and how evenly they deal rows."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from vitalstrand.operators.joins import hot_keys, may_hold, salted_join, split_join


@pytest.fixture(scope="module")
def facts(spark):
    # one key on a third of the rows, some null, the others spread
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 5000)
    return spark.range(1_000_000).select(F.col("id").alias("row"), key.cast("long").alias("k"))


@pytest.fixture(scope="module")
def lookup(spark):
    twice = F.explode(F.when(F.col("id") % 50 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    return spark.range(4000).select(F.col("id").alias("k"), twice.alias("v"))


def test_hot_keys_are_found(spark, facts):
    assert hot_keys(facts, "k") == [7]
    assert hot_keys(facts.where("k <> 7"), "k") == []
    assert hot_keys(facts.limit(0), "k") == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_equal_the_plain_join(facts, lookup, how):
    part = facts.where("row < 20000")
    want = sorted(map(tuple, part.join(lookup, ["k"], how).select("row", "k", "v").collect()), key=str)
    for got in (split_join(part, lookup, ["k"], how), salted_join(part, lookup, ["k"], [7], ["row"], how)):
        assert sorted(map(tuple, got.select("row", "k", "v").collect()), key=str) == want


@pytest.mark.parametrize("kind", ["split", "salted"])
def test_no_task_gets_twice_the_median(spark, facts, lookup, kind):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        joined = split_join(facts, lookup, ["k"]) if kind == "split" else salted_join(facts, lookup, ["k"], hot_keys(facts, "k"), ["row"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        if kind == "split":  # the hot part stays in its scan tasks, the rest is dealt by key
            sizes = sorted(sizes)[-8:]
        assert max(sizes) <= 2 * median(sizes)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_without_a_partner_stay_out_of_the_join(spark):
    facts = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id") - 10_000).alias("k"), F.col("id").alias("v"))
    keys = spark.range(0, 20_000, 40).select((F.col("id") - 10_000).cast("int").alias("key"))
    held = may_hold(facts, keys, "k", "key", bits=1 << 14)
    want = facts.join(keys, F.col("k") == F.col("key"), "left_semi")
    assert held.columns == facts.columns
    assert want.exceptAll(held).isEmpty() and want.count() == held.join(keys, F.col("k") == F.col("key")).count()
    assert held.count() < want.count() + 1_500
