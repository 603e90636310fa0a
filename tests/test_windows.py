"""Window assembly against a plain per-person loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalstrand.functions.arrays import positions_from_separators
from vitalstrand.operators import scoring as sc
from vitalstrand.operators import windows as wi

W, L, MAX = 5, 4, 40
STRIDE = {"train": 2, "val": 3, "test": 3}
D0 = dt.date(2020, 1, 1)


def build(seed=0):
    rng = random.Random(seed)
    people, tokens, events = [], [], []
    for pid in range(12):
        split = ("train", "val", "test")[pid % 3]
        span = rng.choice([3, 8, 9, 10, 25, 40])
        people.append((pid, split, dt.datetime(2020, 1, 1, 7, 30), dt.datetime(2020, 1, 1, 3) + dt.timedelta(days=span)))
        # person 0 holds most of the rows
        for _ in range(3000 if pid == 0 else 60):
            at = dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(span + 3), seconds=rng.choice([0, 43200, 86399, 300]))
            tokens.append((pid, at, rng.randrange(4), rng.choice([100, 101, 110, 1000, 5000])))
        for _ in range(rng.randrange(3)):
            events.append((pid, D0 + dt.timedelta(days=rng.randrange(span + 10))))
    return people, tokens, events


def loop(people, tokens, events, max_len, calendar=False):
    out = {}
    for pid, split, start, end in people:
        cur = start.date() + dt.timedelta(days=W)
        while cur <= end.date() - dt.timedelta(days=L):
            lo = cur - dt.timedelta(days=W)
            mine = sorted((t[1], t[2], t[3]) for t in tokens if t[0] == pid and lo <= t[1].date() <= cur)
            if mine:
                ids, pos, day, prev = [1], [0], -1, None
                for ts, _, tid in mine:
                    if ts.date() != prev:
                        day = (ts.date() - lo).days if calendar else day + 1
                        if prev is not None:
                            ids.append(3)
                            pos.append(day)
                        prev = ts.date()
                    ids.append(tid)
                    pos.append(day)
                ids.append(2)
                pos.append(day)
                label = int(any(e[0] == pid and 1 <= (e[1] - cur).days <= L for e in events))
                out[(pid, cur)] = (ids[-max_len:], pos[-max_len:], label)
            cur += dt.timedelta(days=STRIDE[split])
    return out


@pytest.fixture(scope="module")
def data(spark):
    people, tokens, events = build()
    cohort = spark.createDataFrame(people, "person_id BIGINT, split STRING, fitbit_start TIMESTAMP, fitbit_end TIMESTAMP")
    raw = spark.createDataFrame(tokens, "person_id BIGINT, ts TIMESTAMP, stream_ord INT, tid INT")
    runs = raw.groupBy("person_id", "ts", "stream_ord", "tid").agg(F.count(F.lit(1)).alias("n"))
    days = spark.createDataFrame(events, "person_id BIGINT, event_day DATE")
    return (people, tokens, events), wi.person_calendar(cohort, W, L, STRIDE), runs, days


@pytest.mark.parametrize("max_len,calendar", [(MAX, False), (10_000, False), (10_000, True), (3, False)])
def test_sequences_match_loop(data, max_len, calendar):
    raw, cal, runs, days = data
    seqs = wi.window_sequences(wi.day_packs(runs, max_len), cal, W, max_len, calendar)
    rows = wi.with_labels(seqs, wi.positive_windows(days, cal, L)).collect()
    got = {(r.person_id, r.end_date): (r.input_ids, r.positions, r.label) for r in rows}
    assert got == loop(*raw, max_len, calendar)
    assert all(r.n_tokens == len(r.input_ids) for r in rows)


def test_sizes_agree_with_sequences(data):
    _, cal, runs, _ = data
    sizes = {(r.person_id, r.end_date): r.n_tokens for r in wi.window_sizes(runs, cal, W, MAX).collect()}
    seqs = wi.window_sequences(wi.day_packs(runs, MAX), cal, W, MAX).collect()
    assert sizes == {(r.person_id, r.end_date): r.n_tokens for r in seqs}


def test_merged_sequence_expands_repeats(data):
    raw, cal, runs, _ = data
    rows = wi.merged_sequence(wi.window_tokens(runs, cal, W)).collect()
    byw = {}
    for r in sorted(rows, key=lambda r: (r.person_id, r.end_date, r.seq)):
        byw.setdefault((r.person_id, r.end_date), []).append((r.seq, r.tid))
    want = loop(*raw, 10**9)
    for key, (ids, _, _) in want.items():
        plain = [t for t in ids[1:-1] if t != 3]
        assert [s for s, _ in byw[key]] == list(range(1, len(plain) + 1))
        assert [t for _, t in byw[key]] == plain


def test_position_properties(data):
    _, cal, runs, _ = data
    seqs = wi.window_sequences(wi.day_packs(runs, 10_000), cal, W, 10_000)
    for r in seqs.withColumn("again", positions_from_separators(F.col("input_ids"))).collect():
        assert r.input_ids[0] == 1 and r.input_ids[-1] == 2
        assert r.positions == sorted(r.positions)
        assert r.input_ids.count(3) == r.positions[-1]
        assert r.again == r.positions


def test_padding(data):
    _, cal, runs, _ = data
    seqs = wi.window_sequences(wi.day_packs(runs, 10_000), cal, W, 10_000)
    before = {(r.person_id, r.end_date): r for r in seqs.collect()}
    for r in wi.padded(seqs, MAX).collect():
        real = min(MAX, before[(r.person_id, r.end_date)].n_tokens)
        assert len(r.input_ids) == len(r.positions) == len(r.attn_mask) == MAX
        assert sum(r.attn_mask) == real and all(r.attn_mask[:real])
        assert r.input_ids[:real] == before[(r.person_id, r.end_date)].input_ids[-real:]
        assert set(r.input_ids[real:]) <= {0}


def test_label_edges(spark):
    cohort = spark.createDataFrame(
        [(1, "train", dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1))],
        "person_id BIGINT, split STRING, fitbit_start TIMESTAMP, fitbit_end TIMESTAMP",
    )
    cal = wi.person_calendar(cohort, 30, 30, {"train": 14})
    anchors = [r.end_date for r in wi.window_anchors(cal).collect()]
    assert anchors == [dt.date(2020, 1, 31)]
    for offset, hit in ((0, 0), (1, 1), (30, 1), (31, 0)):
        day = spark.createDataFrame([(1, dt.date(2020, 1, 31) + dt.timedelta(days=offset))], "person_id BIGINT, event_day DATE")
        assert wi.positive_windows(day, cal, 30).count() == hit


def test_no_room_for_a_window(spark):
    cohort = spark.createDataFrame(
        [(1, "train", dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 29))],
        "person_id BIGINT, split STRING, fitbit_start TIMESTAMP, fitbit_end TIMESTAMP",
    )
    assert wi.window_anchors(wi.person_calendar(cohort, 30, 30, {"train": 14})).count() == 0


def test_window_holds_31_days(spark):
    cohort = spark.createDataFrame(
        [(1, "train", dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1))],
        "person_id BIGINT, split STRING, fitbit_start TIMESTAMP, fitbit_end TIMESTAMP",
    )
    cal = wi.person_calendar(cohort, 30, 30, {"train": 14})
    edge = [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 31, 23, 59, 59, 999999), dt.datetime(2019, 12, 31, 23, 59, 59), dt.datetime(2020, 2, 1)]
    toks = spark.createDataFrame([(1, t, 0, 100 + i, 1) for i, t in enumerate(edge)], "person_id BIGINT, ts TIMESTAMP, stream_ord INT, tid INT, n BIGINT")
    assert sorted(r.tid for r in wi.window_tokens(toks, cal, 30).collect()) == [100, 101]


def test_trailing_window_edges(spark):
    at = dt.datetime(2020, 2, 1)
    rows = [
        (1, "inside", at - dt.timedelta(days=2), at),
        (1, "ends late", at - dt.timedelta(hours=1), at + dt.timedelta(seconds=1)),
        (1, "starts early", at - dt.timedelta(days=31), at - dt.timedelta(days=29)),
    ]
    samples = spark.createDataFrame(rows, "person_id INT, name STRING, start_ts TIMESTAMP, end_ts TIMESTAMP")
    anchors = spark.createDataFrame([(1, at)], "person_id INT, at TIMESTAMP")
    names = lambda **kw: {r.name for r in wi.trailing_window(samples, anchors, 30, **kw).collect()}
    assert names() == {"inside"}
    assert names(strict_start=False) == {"inside", "starts early"}
    assert names(strict_end=False) == {"inside", "ends late"}


def test_id_range(spark):
    df = spark.createDataFrame([(1, [1, 7]), (2, [9]), (3, [])], "person_id INT, input_ids ARRAY<INT>")
    assert [r.person_id for r in wi.id_range_violations(df, 8).collect()] == [2]


@pytest.mark.parametrize("max_len", [10_000, 12])
def test_span_scores_equal_sequence_scores(spark, data, max_len):
    _, cal, runs, _ = data
    ids = runs.select("tid").distinct()
    weights = ids.union(spark.createDataFrame([(1,), (2,), (3,)], "tid INT")).distinct()
    weights = weights.withColumn("weight", F.sin(F.col("tid").cast("double"))).where("tid % 5 <> 4")
    seqs = wi.window_sequences(wi.day_packs(runs, 10_000), cal, W, 10_000)
    want = {(r.person_id, r.end_date): r.logit for r in sc.score_windows(seqs, weights, -0.5).collect()}
    spans = sc.score_spans(runs, cal, weights, -0.5, W)
    got = {(r.person_id, r.end_date): (r.n_tokens, r.logit) for r in spans.collect()}
    assert {k: v for k, (_, v) in got.items()} == pytest.approx(want, abs=1e-8)
    assert {k: n for k, (n, _) in got.items()} == {(r.person_id, r.end_date): r.n_tokens for r in seqs.collect()}
    cut = spans.where(F.col("n_tokens") > max_len).select("person_id", "end_date")
    built = wi.window_sequences(wi.day_packs(runs, max_len), cal, W, max_len, only=cut)
    assert built.count() == sum(n > max_len for n, _ in got.values())
    assert "input_ids" not in spans._jdf.queryExecution().toString()
