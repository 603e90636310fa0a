import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalstrand.operators import risk as rk
from vitalstrand.operators import signals as sg
from vitalstrand.sources.snapshots import Snapshots
from vitalstrand.streaming import jobs
from vitalstrand.streaming.tables import LatestTable, ReadingLog

SCHEMA = "event_id BIGINT, person_id BIGINT, datetime TIMESTAMP, heart_rate_value DOUBLE"
T0 = dt.datetime(2024, 1, 1)


def readings(lo, hi):
    return [(i, i % 3, T0 + dt.timedelta(minutes=2 * i), float(i % 11)) for i in range(lo, hi)]


@pytest.fixture()
def drop(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(rows, name, schema=SCHEMA):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return str(folder)

    return add


def batch_bins(spark, rows):
    return {(r.person_id, r.ts): r.v for r in sg.hr_bins(sg.hr_bin_sums(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_bins_across_batches_with_repeats(spark, drop, tmp_path):
    first, second = readings(0, 100), readings(100, 160)
    folder = drop(first, "a")
    home = str(tmp_path / "out")

    def run():
        jobs.land(jobs.hr_bins_stream(jobs.read_stream(spark, folder, SCHEMA, files_per_batch=1)), home)
        return {(r.person_id, r.ts): r.v for r in jobs.current(spark, home, ["person_id", "ts"]).collect()}

    assert run() == batch_bins(spark, first)
    # a restart sees only the new file; its repeats of recent readings are dropped
    drop(second + first[-20:], "b")
    assert run() == batch_bins(spark, first + second)
    assert run() == batch_bins(spark, first + second)


def test_rows_behind_the_watermark_are_left_out(spark, drop, tmp_path):
    rows = readings(0, 200)
    folder = drop(rows, "a")
    home = str(tmp_path / "out")
    go = lambda: jobs.land(jobs.hr_bins_stream(jobs.read_stream(spark, folder, SCHEMA)), home)
    go()
    drop([(9001, 1, T0, 500.0)], "late")
    go()
    got = {(r.person_id, r.ts): r.v for r in jobs.current(spark, home, ["person_id", "ts"]).collect()}
    assert got == batch_bins(spark, rows)


def test_late_rows_are_reconciled(spark, drop, tmp_path):
    first, second = readings(100, 200), readings(0, 130)
    rng = random.Random(2)
    rng.shuffle(first)
    folder = drop(first, "a")
    home = str(tmp_path / "out")
    keys = ["person_id", "ts"]

    def rebuild(rows):
        return sg.hr_bins(sg.hr_bin_sums(rows.dropDuplicates(["event_id"])))

    def go():
        jobs.reconcile(jobs.read_stream(spark, folder, SCHEMA, files_per_batch=1), home, rebuild, keys)
        return {(r.person_id, r.ts): r.v for r in jobs.current(spark, home, keys).collect()}

    assert go() == batch_bins(spark, first)
    # every row of the second file is older than the newest of the first, and some are repeats
    drop(second, "b")
    want = batch_bins(spark, readings(0, 200))
    assert go() == want
    # a batch that is tried again changes nothing
    log = ReadingLog(spark, home, "datetime")
    again = spark.createDataFrame(second, SCHEMA)
    LatestTable(spark, home, keys).upsert(rebuild(log.of_days(log.append(again, 1), 1)), 1)
    assert go() == want


def test_latest_table_reads_the_fold_and_open_batches(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path), ["k"], buckets=2, fold_every=3)
    want = {}
    for batch in range(8):
        rows = [(k, batch * 10 + k) for k in range(batch % 3, 5)]
        want.update(rows)
        table.upsert(spark.createDataFrame(rows, "k INT, v INT"), batch)
        assert {r.k: r.v for r in table.current().collect()} == want
    fold, batches = table.parts()
    assert fold[0] == 5 and [v for v, _ in batches] == [6, 7]
    read = {f.split("/data/")[1].split("/")[0].rsplit("-", 1)[0] for f in table.current().inputFiles()}
    assert read == {"fold-5", "batch-6", "batch-7"}
    # a batch that a fold holds already is not read when it is tried again
    table.upsert(spark.createDataFrame([(0, -1)], "k INT, v INT"), 4)
    assert {r.k: r.v for r in table.current().collect()} == want


def test_snapshots_are_seen_once_committed(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "s"))
    one, two = (spark.createDataFrame([(i,)], "v INT") for i in (1, 2))
    assert table.read(fallback=one).first().v == 1
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(one, table.next_version())
    # a version that is written but not committed yet
    two.write.parquet(str(tmp_path / "s" / "data" / "table-1-half"))
    assert table.read(fallback=two).first().v == 1 and table.next_version() == 1
    table.commit(two, 1)
    assert table.read().first().v == 2


def test_trend_places_late_windows(spark, drop, tmp_path):
    schema = "person_id BIGINT, end_date DATE, prob DOUBLE"
    day = lambda d: dt.date(2024, 1, d)
    rows = [(1, day(2), 0.4), (1, day(9), 0.1), (2, day(1), 0.5), (1, day(3), 0.2), (1, day(1), 0.9), (1, day(5), 0.3), (2, day(4), 0.7)]
    home, keys = str(tmp_path / "out"), ["person_id", "end_date"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        for part in (rows[:3], rows[3:5], rows[5:]):
            folder = drop(part, "p", schema)
            jobs.land(jobs.risk_trend_stream(jobs.read_stream(spark, folder, schema)), home, keys=keys)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.person_id, r.end_date): r.trend_delta for r in jobs.current(spark, home, keys).collect()}
    want = {(r.person_id, r.end_date): r.trend_delta for r in rk.risk_trend(spark.createDataFrame(rows, schema)).collect()}
    assert got == pytest.approx(want) and len(got) == len(rows)


def test_trend_state_forgets_what_the_watermark_passed(spark, drop, tmp_path):
    schema = "person_id BIGINT, end_date DATE, prob DOUBLE"
    start = dt.date(2024, 1, 1)
    home, keys = str(tmp_path / "out"), ["person_id", "end_date"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        for lo in (0, 40, 80):
            folder = drop([(1, start + dt.timedelta(days=d), d / 200) for d in range(lo, lo + 40)], "p", schema)
            jobs.land(jobs.risk_trend_stream(jobs.read_stream(spark, folder, schema), "5 days"), home, keys=keys)
        state = spark.read.format("statestore").option("stateVarName", "risks").load(f"{home}/checkpoint")
        assert state.count() <= 46
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    deltas = [r.trend_delta for r in jobs.current(spark, home, keys).orderBy("end_date").collect()]
    assert deltas == pytest.approx([0.0] + [0.005] * 119)


def test_refresh_rescores_only_touched_persons(spark, drop, tmp_path):
    schema = "person_id BIGINT, ts TIMESTAMP, value DOUBLE"
    rows = [(p, T0 + dt.timedelta(days=d), float(d)) for p in (1, 2) for d in range(5)]
    folder = drop(rows, "a", schema)
    home = str(tmp_path / "out")

    def report(history, _touched):
        return history.groupBy("person_id").agg(F.max("ts").alias("last"), F.sum("value").alias("total"))

    go = lambda: jobs.refresh(jobs.read_stream(spark, folder, schema), home, report, 2)
    go()
    drop([(2, T0 + dt.timedelta(days=6), 10.0)], "b", schema)
    go()
    newest = LatestTable(spark, home, ["person_id"]).parts()[1]
    assert [spark.read.parquet(path).count() for _, path in newest] == [2, 1]
    now = {r.person_id: (r["last"], r.total) for r in jobs.current(spark, home, ["person_id"]).collect()}
    assert now[1] == (T0 + dt.timedelta(days=4), 10.0)
    # the second report reads two days before its batch: day 4 and day 6
    assert now[2] == (T0 + dt.timedelta(days=6), 14.0)


def test_an_old_row_reads_its_own_history_only(spark, tmp_path):
    log = ReadingLog(spark, str(tmp_path), "ts", buckets=64)
    schema = "person_id BIGINT, ts TIMESTAMP"
    rows = [(p, T0 + dt.timedelta(days=d)) for p in range(8) for d in range(50)]
    log.append(spark.createDataFrame(rows, schema), 0)
    fresh = log.append(spark.createDataFrame([(3, T0), *[(p, T0 + dt.timedelta(days=50)) for p in range(8)]], schema), 1)
    counts = {r.person_id: r["count"] for r in log.since(fresh, 2, 1).groupBy("person_id").count().collect()}
    assert counts.pop(3) == 52
    assert set(counts.values()) == {3}
    # the scan opens the other persons' last days alone: one file for each bucket and day
    plan = log.since(fresh, 2, 1)
    buckets = {r[0] for r in fresh.select("_bucket").distinct().collect()}
    scanned = log.until(1).where(F.col("_bucket").isin(list(buckets))).count()
    assert plan.count() == 52 + 7 * 3 < scanned
