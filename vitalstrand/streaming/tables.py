"""Keyed tables that streams write: newest row per key, and the readings behind them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstrand.sources.snapshots import Snapshots

BUCKETS = 16
FOLD_EVERY = 8


def bucket_of(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class LatestTable:
    """Newest row per key over the batches of a stream.

    A batch is one committed version. After ``fold_every`` batches they are folded with the last fold into one table
    bucketed by key, so reading costs that table and the open batches. A retried batch is committed again and changes
    nothing: the newest batch wins whole rows, and batches a fold already holds are not read.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        self.spark, self.keys, self.buckets, self.fold_every = spark, list(keys), buckets, fold_every
        self.versions = Snapshots(spark, f"{folder}/latest")

    def parts(self) -> tuple[tuple[int, str] | None, list[tuple[int, str]]]:
        """The newest fold, and the batches after it."""
        committed = self.versions.committed()
        fold = max(((v, p) for v, kind, p in committed if kind == "fold"), default=None)
        return fold, [(v, p) for v, kind, p in committed if kind == "batch" and (fold is None or v > fold[0])]

    def exists(self) -> bool:
        fold, batches = self.parts()
        return fold is not None or bool(batches)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        self.versions.commit(rows, batch_id, "batch")
        if len(self.parts()[1]) >= self.fold_every:
            self.fold()

    def fold(self) -> None:
        _, batches = self.parts()
        if batches:
            rows = self.current().withColumn("_bucket", bucket_of(self.keys, self.buckets))
            rows = rows.repartition(self.buckets, "_bucket").sortWithinPartitions("_bucket", *self.keys)
            self.versions.commit(rows, batches[-1][0], "fold", ["_bucket"])

    def current(self) -> DataFrame:
        fold, batches = self.parts()
        tables = [self.spark.read.parquet(path).withColumn("_batch", F.lit(v)) for v, path in batches]
        if fold is not None:
            tables.insert(0, self.spark.read.parquet(fold[1]).drop("_bucket").withColumn("_batch", F.lit(fold[0])))
        rows = tables[0]
        for more in tables[1:]:
            rows = rows.unionByName(more)
        if len(tables) == 1:
            return rows.drop("_batch")
        rest = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        newest = F.max_by(F.struct(*rest), "_batch").alias("_r")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_r.*")


class ReadingLog:
    """All readings of a stream by batch, bucket of person and day, so that few of them are read again."""

    def __init__(self, spark: SparkSession, folder: str, ts: str, person: str = "person_id", buckets: int = BUCKETS):
        self.spark, self.home, self.ts, self.person, self.buckets = spark, f"{folder}/readings", ts, person, buckets

    def append(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch, over an earlier try of it, and read it back."""
        rows = batch.withColumn("_day", F.to_date(self.ts)).withColumn("_bucket", bucket_of([self.person], self.buckets))
        rows.repartition("_bucket", "_day").write.mode("overwrite").partitionBy("_bucket", "_day").parquet(f"{self.home}/batch={batch_id}")
        return self.spark.read.parquet(f"{self.home}/batch={batch_id}")

    def until(self, batch_id: int) -> DataFrame:
        return self.spark.read.option("basePath", self.home).parquet(self.home).where(F.col("batch") <= batch_id)

    def of_days(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        """All readings so far of the person-days that ``fresh`` touches.

        Only folders of these buckets and days are read; there are at most as many as buckets times days in the batch.
        """
        touched = fresh.select(self.person, "_day", "_bucket").distinct()
        pairs = [(r["_bucket"], r["_day"]) for r in touched.select("_bucket", "_day").distinct().collect()]
        rows = self.until(batch_id).where(_any_of(pairs, lambda b, days: (F.col("_bucket") == b) & F.col("_day").isin(days)))
        return rows.join(touched.drop("_bucket"), [self.person, "_day"], "left_semi").drop("_day", "_bucket", "batch")

    def since(self, fresh: DataFrame, reach_days: int, batch_id: int) -> DataFrame:
        """Readings so far of each touched person from ``reach_days`` before that person's own earliest fresh day on.

        A bucket is read from its earliest such day on: an old row makes no other bucket's history be read.
        """
        earliest = fresh.groupBy(self.person, "_bucket").agg(F.date_sub(F.min("_day"), reach_days).alias("_since"))
        starts = {r["_bucket"]: r["_since"] for r in earliest.groupBy("_bucket").agg(F.min("_since").alias("_since")).collect()}
        pairs = list(starts.items())
        rows = self.until(batch_id).where(_any_of(pairs, lambda b, days: (F.col("_bucket") == b) & (F.col("_day") >= F.lit(days[0]))))
        return rows.join(earliest.drop("_bucket"), self.person).where("_day >= _since").drop("_day", "_bucket", "_since", "batch")


def _any_of(pairs: list[tuple], test: Callable):
    by: dict = {}
    for bucket, day in pairs:
        by.setdefault(bucket, []).append(day)
    out = F.lit(False)
    for bucket, days in sorted(by.items()):
        out = out | test(bucket, days)
    return out
