import datetime as dt
import random

import pytest

from check_oracles import compare, oracle_connection
from vitalstrand.operators import audit as au
from vitalstrand.operators import cohort as co
from vitalstrand.operators.joins import within_spans
from vitalstrand.plans.study import Study
from vitalstrand.sources import bindings as b

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
D = dt.date


@pytest.mark.parametrize("name, sf_dir", [("endpoint_hf", MIDDLE), ("leakage_audit", SMALL), ("vocab_totals", SMALL), ("id_range_report", SMALL), ("split_overlap_reserved", SMALL)])
def test_queries_match_their_oracles(spark, name, sf_dir):
    ok, note = compare(spark, oracle_connection(sf_dir), name, sf_dir)
    assert ok and not note.startswith("0 rows"), note


def test_spans_against_all_pairs(spark):
    rng = random.Random(2)
    day = lambda: D(1969, 12, 1) + dt.timedelta(days=rng.randint(0, 90))
    points = [(rng.randint(0, 3), k, day()) for k in range(200)] + [(None, 900, day()), (1, 901, None)]
    spans = [(rng.randint(0, 3), k, s, s + dt.timedelta(days=rng.randint(-1, 30))) for k in range(60) for s in [day()]]
    spans += [(None, 800, D(1970, 1, 1), D(1971, 1, 1)), (1, 801, None, D(1971, 1, 1))]
    want = {(p[1], s[1]) for p in points for s in spans if None not in (p[0], p[2], s[2]) and p[0] == s[0] and s[2] <= p[2] <= s[3]}
    a = spark.createDataFrame(points, "k INT, p INT, at DATE")
    c = spark.createDataFrame(spans, "k INT, s INT, lo DATE, hi DATE")
    for days in (1, 8, 400):
        pairs = [tuple(r) for r in within_spans(a, c, ["k"], "at", "lo", "hi", days).select("p", "s").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_admitted_primary_events(spark):
    cond = spark.createDataFrame(
        [
            (1, D(2020, 1, 5), 7, 7, None, 32902), (1, D(2020, 1, 5), 7, 7, None, 32901), (1, D(2020, 1, 6), 7, 7, None, 32902),
            (1, D(2020, 1, 3), 7, 7, None, 32908), (1, D(2020, 1, 3), 7, 7, None, None), (2, D(2020, 1, 4), 7, 7, None, 32902),
            (3, D(2020, 1, 4), 8, 8, None, 32902), (4, D(2020, 1, 4), 7, 7, None, 32903), (4, D(2020, 1, 5), 7, 7, None, 32903),
        ],
        "person_id BIGINT, condition_start_date DATE, condition_concept_id BIGINT, condition_source_concept_id BIGINT, "
        "visit_occurrence_id BIGINT, condition_status_concept_id BIGINT",
    )
    visits = spark.createDataFrame(
        [
            (1, 9201, D(2020, 1, 2), D(2020, 1, 5), 1), (2, 9201, D(2020, 1, 4), D(2020, 1, 5), 1), (3, 9202, D(2020, 1, 1), D(2020, 1, 9), 2),
            (4, 9201, D(2020, 1, 1), D(2020, 1, 9), 3), (5, 262, D(2020, 1, 4), None, 4),
        ],
        "visit_occurrence_id BIGINT, visit_concept_id BIGINT, visit_start_date DATE, visit_end_date DATE, person_id BIGINT",
    )
    ids = spark.createDataFrame([(7,)], "concept_id BIGINT")
    got = sorted(tuple(r) for r in co.admitted_primary_events(cond, ids, visits).collect())
    assert got == [(1, D(2020, 1, 5), 7, D(2020, 1, 2)), (4, D(2020, 1, 4), 7, D(2020, 1, 4))]
    assert co.admitted_primary_events(cond.limit(0), ids, visits).count() == 0


def test_fingerprint_names_rows_not_their_order(spark):
    rows = [(1, None), (None, "x"), (2, "y"), (2, "y")]
    of = lambda r, n=1: au.fingerprint(spark.createDataFrame(r, "a INT, b STRING").repartition(n), "t").head()
    assert of(rows) == of(rows[::-1], 3)
    assert len({of(rows), of(rows[:3]), of([*rows[:3], (3, "y")]), of([(1, "x"), (None, None), *rows[2:]])}) == 4
    assert tuple(of([]))[1:] == (0, 0, 0)


class Leaky(Study):
    """Fits on every person."""

    def training(self, df):
        return self.members(df)

    def reference_persons(self):
        return self.splits.select("person_id")


def test_leakage_is_reported(spark):
    study = Leaky(b.clinical_history(spark, SMALL), b.HISTORY_PARAMS, b.LAB_PREFIXES)
    got = {r["artefact"]: r for r in study.leakage().collect()}
    assert set(got) == {"hr_cuts", "steps_cuts", "vocab"}
    assert all(r["leaked"] and r["n_rows"] > r["n_allowed"] > 0 for r in got.values())


def test_sampled_reference_is_no_leak(spark):
    study = Study(b.clinical_history(spark, SMALL), b.HISTORY_PARAMS.with_(reference_persons=5), b.LAB_PREFIXES)
    assert [r["leaked"] for r in study.leakage().collect()] == [False] * 3
