"""Streaming twins of the binning, tokenising and refresh jobs.

Aggregates run in update mode and land each micro-batch as one version of a keyed table, so a retried batch changes
nothing; the current view is the newest row per key. The watermarked jobs leave later rows out; ``reconcile`` takes
rows of any age and ends equal to the batch jobs.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vitalstrand.functions.scalars import noon
from vitalstrand.operators.signals import mean_value, total_value
from vitalstrand.streaming.tables import LatestTable, ReadingLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def land(
    stream: DataFrame,
    folder: str,
    mode: str = "update",
    each: Callable[[DataFrame, int], DataFrame] | None = None,
    keys: Sequence[str] | None = None,
) -> None:
    """Run all available input through ``stream`` into ``folder``; a restart resumes from its checkpoint.

    With ``keys`` the rows are upserts of a keyed table, else every batch is a folder of its own.
    """
    table = LatestTable(stream.sparkSession, folder, keys) if keys else None

    def write(batch: DataFrame, batch_id: int) -> None:
        out = each(batch, batch_id) if each else batch
        if table:
            table.upsert(out, batch_id)
        else:
            out.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all batches that were landed without keys."""
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def current(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key: of the keyed table where there is one, else of all landed batches."""
    table = LatestTable(spark, folder, keys)
    if table.exists():
        return table.current()
    rows = landed(spark, folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def reconcile(
    stream: DataFrame, folder: str, rebuild: Callable[[DataFrame], DataFrame], keys: Sequence[str], ts: str = "datetime", person: str = "person_id"
) -> None:
    """Keep the keyed table of ``rebuild`` right under readings of any age, order and repetition.

    A batch joins the log of readings, and the person-days it touches are rebuilt from all their readings and upserted.
    ``rebuild`` maps readings, repeats included, to rows whose key decides person and day.
    """
    log = ReadingLog(stream.sparkSession, folder, ts, person)

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        return rebuild(log.of_days(log.append(batch, batch_id), batch_id))

    land(stream, folder, "append", each, keys)


def once(stream: DataFrame, id_col: str, ts: str, delay: str) -> DataFrame:
    """Drop repeats of the same reading that arrive within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def hr_bins_stream(readings: DataFrame, minutes: int = 5, delay: str = "1 hour", id_col: str = "event_id") -> DataFrame:
    """(person_id, datetime, heart_rate_value, id) -> mean per person and bin."""
    return (
        once(readings, id_col, "datetime", delay)
        .where(F.col("heart_rate_value").isNotNull())
        .groupBy("person_id", F.window("datetime", f"{minutes} minutes").alias("w"))
        .agg(mean_value("heart_rate_value").alias("v"))
        .select("person_id", F.col("w.start").alias("ts"), "v")
    )


def steps_daily_stream(readings: DataFrame, delay: str = "1 day", id_col: str = "event_id") -> DataFrame:
    """(person_id, datetime, steps, id) -> total per person and day, stamped at noon."""
    return (
        once(readings, id_col, "datetime", delay)
        .where(F.col("steps").isNotNull())
        .groupBy("person_id", F.window("datetime", "1 day").alias("w"))
        .agg(total_value("steps").alias("v"))
        .select("person_id", F.to_date("w.start").alias("day"), "v")
        .withColumn("ts", noon("day"))
    )


def refresh(
    stream: DataFrame,
    folder: str,
    report_for: Callable[[DataFrame, DataFrame], DataFrame],
    reach_days: int,
    person: str = "person_id",
    ts: str = "ts",
) -> None:
    """Rescore the persons each micro-batch touches and keep their newest report.

    The batch joins the history first (idempotently, by batch id). ``report_for`` receives the history of the touched
    persons up to and including this batch, each from ``reach_days`` before the person's own earliest fresh row on.
    """
    log = ReadingLog(stream.sparkSession, folder, ts, person)

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        fresh = log.append(batch, batch_id)
        return report_for(log.since(fresh, reach_days, batch_id), fresh.select(person).distinct())

    land(stream, folder, "append", each, [person])


DAY_MS = 86_400_000
TREND_SCHEMA = "person_id BIGINT, end_date DATE, prob DOUBLE, trend_delta DOUBLE"
EPOCH = dt.date(1970, 1, 1)


class TrendState(StatefulProcessor):
    """Risks of a person's windows by day, as one value, so a batch costs a person the same few calls however many windows it has.

    A window is placed among the known ones whenever it comes; its delta and its successor's are emitted. When the
    watermark has passed a window none can come before it, and the windows before it are forgotten: with the person's
    next rows, or by the timer of the newest window.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.risks = handle.getValueState("risks", "days ARRAY<INT>, probs ARRAY<DOUBLE>")

    def known(self) -> dict[int, float]:
        held = self.risks.get()
        return dict(zip(*held, strict=True)) if held else {}

    def keep(self, risks: dict[int, float], days: list[int]) -> None:
        self.risks.update((days, [risks[day] for day in days]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = {(row["end_date"] - EPOCH).days: row["prob"] for row in rows}
        known = self.known()
        newest = max(fresh)
        if newest > max(known, default=newest - 1):
            self.handle.registerTimer(newest * DAY_MS)
        known.update(fresh)
        days = sorted(known)
        passed = bisect_right(days, timerValues.getCurrentWatermarkInMs() // DAY_MS)
        self.keep(known, days[max(passed - 1, 0) :])
        for i, day in enumerate(days):
            before = days[i - 1] if i else None
            if day in fresh or before in fresh:
                delta = known[day] - known[before] if i else 0.0
                yield Row(person_id=key[0], end_date=EPOCH + dt.timedelta(days=day), prob=known[day], trend_delta=delta)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        known = self.known()
        days = sorted(day for day in known if day >= passed)
        if len(days) < len(known):
            self.keep(known, days)
        return iter(())

    def close(self) -> None:
        pass


def risk_trend_stream(risks: DataFrame, delay: str = "400 days") -> DataFrame:
    """Change against the person's previous risk as rows (person_id, end_date) to upsert.

    Needs the RocksDB state store (``ROCKSDB`` as ``spark.sql.streaming.stateStore.providerClass``). Windows may come in
    any order within ``delay`` of the newest one; a person's state is the windows of that time and the one before.
    """
    stamped = risks.withColumn("end_ts", F.col("end_date").cast("timestamp")).withWatermark("end_ts", delay)
    return stamped.groupBy("person_id").transformWithState(TrendState(), TREND_SCHEMA, "Update", "EventTime")
