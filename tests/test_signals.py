import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstrand.operators import signals as sg
from vitalstrand.operators import tokens as tk

HR = "person_id BIGINT, datetime TIMESTAMP, heart_rate_value DOUBLE"


def test_bins_and_pooling(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [
        (1, t + dt.timedelta(minutes=4, seconds=59), 60.0),
        (1, t, 70.0),
        (1, t + dt.timedelta(minutes=5), 80.0),
        (1, t + dt.timedelta(hours=3, minutes=2), 100.0),
        (1, t + dt.timedelta(minutes=1), None),
    ]
    sums = sg.hr_bin_sums(spark.createDataFrame(rows, HR))
    bins = {(r.ts - t).total_seconds() / 60: r.v for r in sg.hr_bins(sums).collect()}
    assert bins == {0: 65.0, 5: 80.0, 182 // 5 * 5: 100.0}
    pooled = {r.slot: r.v for r in sg.hr_pooled(sums).collect()}
    assert pooled == {0: pytest.approx(230 / 3), 1: 80.0}


def test_daily_totals_zero_fill(spark):
    steps = spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 1, 9), 5.0), (1, dt.datetime(2020, 1, 3, 9), 7.0), (1, dt.datetime(2020, 1, 3, 10), 1.0)],
        "person_id BIGINT, datetime TIMESTAMP, steps DOUBLE",
    )
    span = spark.createDataFrame(
        [(1, dt.date(2020, 1, 1), dt.date(2020, 1, 4)), (2, dt.date(2020, 1, 2), dt.date(2020, 1, 1))],
        "person_id BIGINT, first_day DATE, last_day DATE",
    )
    got = {r.day.day: r.v for r in sg.daily_totals_filled(steps, span).collect()}
    assert got == {1: 5.0, 2: 0.0, 3: 8.0, 4: 0.0}
    assert {r.ts.hour for r in sg.steps_daily(steps).collect()} == {12}


@pytest.mark.parametrize("minutes", [30, 3000])
def test_rolling_std_matches_loop(spark, minutes):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2020, 1, 1)
    rows = [(p, t0 + dt.timedelta(minutes=int(m)), float(v)) for p, k in ((1, 400), (2, 30)) for m, v in zip(rng.integers(0, 4000, k), rng.normal(70, 9, k).round(1))]
    got = {(r.person_id, r.datetime): r.std for r in sg.rolling_std(spark.createDataFrame(rows, HR), minutes).collect()}
    assert len(got) == len({(p, t) for p, t, _ in rows})
    for (p, t), std in got.items():
        near = [v for q, u, v in rows if q == p and t - dt.timedelta(minutes=minutes) <= u <= t]
        assert (std is None) if len(near) < 2 else std == pytest.approx(np.std(near, ddof=1), abs=1e-6)


def test_sleep_share(spark):
    t = dt.datetime(2020, 1, 1, 23)
    hour = dt.timedelta(hours=1)
    rows = [(1, s, t + i * hour, t + (i + 1) * hour) for i, s in enumerate(["LIGHT", "REM", "DEEP", "AWAKE"])]
    rows.append((2, "AWAKE", t, t + hour))
    df = spark.createDataFrame(rows, "person_id BIGINT, stage STRING, start_ts TIMESTAMP, end_ts TIMESTAMP")
    got = sg.sleep_percent(df).collect()
    assert [(r.person_id, str(r.night), r.rem_token, r.deep_token) for r in got] == [(1, "2020-01-02", "SLEEP_REM_33", "SLEEP_DEEP_33")]


def test_encounter_days_separate_visits_and_keep_tail(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, day, 10, 1000), (1, day, 10, 1000), (1, day, 11, 1001), (1, day, 12, 1000), (1, day, 12, 1002)]
    df = spark.createDataFrame(rows, "person_id BIGINT, day DATE, visit_id BIGINT, tid INT")
    assert tk.encounter_days(df).first().ids == [1000, 1000, 4, 1001, 4, 1000, 1002]


def test_repeats_are_counted(spark):
    ts = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, ts, "a", 1000)] * 500 + [(1, ts, "b", 1001)], "person_id BIGINT, ts TIMESTAMP, token STRING, tid INT")
    assert {(r.tid, r.n) for r in tk.ehr_tokens(df).collect()} == {(1000, 500), (1001, 1)}


def test_lab_deciles_per_item(spark):
    rows = [(i, "a", float(i)) for i in range(100)] + [(i, "b", float(i) * 1000) for i in range(100)]
    df = spark.createDataFrame(rows, "person_id BIGINT, item STRING, v DOUBLE").withColumn("ts", F.lit("2020-01-01").cast("date"))
    for r in tk.lab_deciles(df, tk.lab_cuts(df)).collect():
        assert r.dec == min(9, (r.person_id + 1) * 10 // 100)
        assert r.token == f"LAB:{r.item}_D{r.dec}"


def test_rolling_std_keeps_digits_of_large_values(spark):
    rng, start = np.random.default_rng(4), dt.datetime(2020, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=7 * i), 1e9 + float(d)) for i, d in enumerate(rng.normal(0, 1, 2000))]
    got = {r.datetime: r.std for r in sg.rolling_std(spark.createDataFrame(rows, HR), 5).collect()}
    for i in range(1, 2000, 37):
        near = [v for _, t, v in rows[: i + 1] if t >= rows[i][1] - dt.timedelta(minutes=5)]
        assert got[rows[i][1]] == pytest.approx(np.std(near, ddof=1), abs=1e-6)
