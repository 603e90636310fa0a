import pytest

import __spark_entry__ as entry
from check_oracles import compare, oracle_connection

SMALL = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()
CHECKED = (
    "cohort", "first_event", "stratified_split", "vocab", "window_labels", "window_sequences", "padded_windows",
    "weighted_resample", "eval_report", "mia_audit", "risk_report", "hrv_proxy", "stream_hr_5min", "daily_refresh",
)


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


def test_every_query_has_an_oracle():
    own = {n for n in entry.queries() if not (n == "pipeline" or n[:2] == "op" and n[2].isdigit())}
    assert own - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["person_id", "end_date", "split", "n_tokens", "label"]
    assert df.count() == 4875


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle(spark, con, name):
    ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def test_binding_counts(spark, con):
    anchors, positive = con.execute(
        f"SELECT COUNT(*), SUM(label) FROM ({entry.oracle_sql()['window_labels']})"
    ).fetchone()
    assert (anchors, int(positive)) == (10_396, 461)
