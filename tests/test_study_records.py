"""Records of a study are joined once, whatever reads them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vitalstrand.plans.registry import history
from vitalstrand.plans.study import Study

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("artefact", ["vocab_rows", "ehr_tokens", "event_days"])
def test_line_items_are_joined_once(spark, artefact):
    study = history(spark, SMALL)
    assert not [f for f in getattr(study, artefact)().inputFiles() if "lineitem" in f]


def test_records_are_those_of_the_cohort(spark):
    study = history(spark, SMALL)
    for table, rows in study.records.items():
        want = study.members(getattr(study.tables, table)).select(*rows.columns)
        assert rows.count() and rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
        assert rows.schema.simpleString() == want.schema.simpleString()


def test_records_are_counted_once(spark):
    study = history(spark, SMALL)
    assert not [f for f in study.token_counts().inputFiles() if "/records-" in f or "lineitem" in f]
    assert study.token_counts() is study.token_counts()


def test_cohort_comes_from_the_joined_records(spark):
    study = history(spark, SMALL)
    want = study.cohort_plan()
    study.tables = replace(study.tables, condition_occurrence=None)
    assert want.count() and study.cohort.exceptAll(want).isEmpty() and want.exceptAll(study.cohort).isEmpty()


def test_candidates_without_a_condition_have_no_records(spark):
    whole = history(spark, SMALL)
    odd = F.col("person_id") % 2 == 1

    def records_of(persons):
        found = whole.records_of(persons)
        return found | {"condition_occurrence": found["condition_occurrence"].where(odd)}

    study = Study(whole.tables, whole.params, whole.lab_prefixes, records_of)
    assert study.cohort.exceptAll(whole.cohort.where(odd)).isEmpty() and whole.cohort.where(odd).exceptAll(study.cohort).isEmpty()
    for table, rows in study.records.items():
        want = whole.records[table].where(odd)
        assert rows.count() and rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
