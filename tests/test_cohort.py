import datetime as dt
import math

from pyspark.sql import functions as F

from vitalstrand.operators import cohort as co
from vitalstrand.operators import vocab as vo
from vitalstrand.sources.tables import codeset_table

D = dt.date
T = dt.datetime


def test_codeset_prefixes(spark):
    concept = spark.createDataFrame(
        [(1, "I48.1", "ICD10CM"), (2, "I4", "ICD10CM"), (3, "I21", "ICD10CM"), (4, "I48", "LOINC"), (5, "", "ICD10CM"), (6, None, "ICD10CM")],
        "concept_id BIGINT, concept_code STRING, vocabulary_id STRING",
    )
    sets = codeset_table(spark, {"afib": ["I48", "I48.1"], "mi": ["I21", "I22"], "none": []})
    got = {tuple(r) for r in co.expand_codeset(concept, sets).collect()}
    assert got == {("afib", 1), ("mi", 3)}
    assert {tuple(r) for r in co.codeset_sizes(co.expand_codeset(concept, sets)).collect()} == {("afib", 1), ("mi", 1)}


def test_cohort_boundaries(spark):
    rows = []
    for pid, days in ((1, 180), (2, 179), (3, 200), (4, 200)):
        rows += [(pid, T(2010, 1, 1, 23, 59), 60.0), (pid, T(2010, 1, 1) + dt.timedelta(days=days), 61.0)]
    hr = spark.createDataFrame(rows, "person_id BIGINT, datetime TIMESTAMP, heart_rate_value DOUBLE")
    cond = spark.createDataFrame([(1,), (1,), (2,), (3,)], "person_id BIGINT")
    person = spark.createDataFrame([(1, 1970), (2, 1950), (3, 1971), (4, 1950)], "person_id BIGINT, year_of_birth INT")
    got = co.build_cohort(hr, cond, person).collect()
    assert [(r.person_id, r.age_at_fitbit_start) for r in got] == [(1, 40)]


EVENTS = "person_id BIGINT, condition_start_date DATE, condition_concept_id BIGINT, condition_source_concept_id BIGINT, visit_occurrence_id BIGINT"
VISITS = "visit_occurrence_id BIGINT, visit_concept_id BIGINT, visit_start_date DATE, visit_end_date DATE"


def joined(spark):
    events = spark.createDataFrame(
        [
            (1, D(2020, 1, 1), 7, 7, 10),
            (1, D(2020, 1, 2), 8, 8, None),
            (1, D(2020, 1, 2), 6, 6, 12),
            (1, D(2020, 1, 3), 5, 5, 11),
            (2, D(2020, 1, 1), 7, 7, 10),
        ],
        EVENTS,
    )
    visits = spark.createDataFrame(
        [(10, 9201, D(2020, 1, 1), D(2020, 1, 2)), (11, 9202, D(2020, 1, 3), D(2020, 1, 4)), (12, None, None, None)], VISITS
    )
    cohort = spark.createDataFrame(
        [(1, T(2020, 1, 1, 8), T(2020, 9, 1)), (2, T(2020, 1, 1), T(2020, 9, 1))],
        "person_id BIGINT, fitbit_start TIMESTAMP, fitbit_end TIMESTAMP",
    )
    return co.after_start(co.cohort_events(co.events_with_visit(events, visits), cohort))


def test_first_event_variants(spark):
    kept = joined(spark)
    # midnight of the start day is before a start at 08:00, and kept when the start is midnight
    assert {(r.person_id, r.event_date.day) for r in kept.collect()} == {(1, 2), (1, 3), (2, 1)}
    row = {r.person_id: r for r in co.first_event(kept).collect()}
    assert (row[1].condition_concept_id, row[1].visit_concept_id, row[1].encounter_type) == (6, None, "outpatient")
    assert (row[2].condition_concept_id, row[2].encounter_type) == (7, "inpatient")
    nonnull = {r.person_id: r for r in co.first_event(kept, "first_nonnull").collect()}
    assert (nonnull[1].condition_concept_id, nonnull[1].visit_concept_id) == (6, 9202)
    assert nonnull[1].visit_start_date == D(2020, 1, 3)


def test_split_sizes_and_disjointness(spark):
    cohort = spark.range(237).select(F.col("id").alias("person_id"), (F.col("id") % 5 == 0).cast("int").alias("has_event"))
    split = co.stratified_split(cohort, 1)
    for flag, n in ((1, 48), (0, 189)):
        sizes = {r.split: r["count"] for r in split.where(F.col("has_event") == flag).groupBy("split").count().collect()}
        n_test = math.ceil(n * 0.15)
        assert sizes["test"] == n_test
        assert abs(sizes["val"] - n * 0.15) <= 1
        assert sum(sizes.values()) == n
    assert co.split_overlap(split).count() == 0
    assert co.split_overlap(split.unionByName(split.withColumn("split", F.lit("other")))).count() == 237
    again = {tuple(r) for r in co.stratified_split(cohort.repartition(7), 1).select("person_id", "split").collect()}
    assert again == {tuple(r) for r in split.select("person_id", "split").collect()}


def test_threshold_split_is_roughly_proportional(spark):
    df = spark.range(8000).select(F.col("id").alias("person_id"))
    share = {r.split: r["count"] / 8000 for r in co.threshold_split(df, 1).groupBy("split").count().collect()}
    assert abs(share["train"] - 0.70) < 0.03 and abs(share["val"] - 0.15) < 0.03


def test_vocab_caps_ranges_and_ties(spark):
    counts = spark.createDataFrame(
        [("MED", f"MED:{i:04d}", 5) for i in range(1200)] + [("PX10", "PX10:b", 2), ("PX10", "PX10:a", 2)],
        "stream STRING, token STRING, n BIGINT",
    )
    vocab = {r.token: r.tid for r in vo.build_vocab(counts).collect()}
    assert vocab["<UNK>"] == 5 and vocab["PX10:a"] == 5000 and vocab["PX10:b"] == 5001
    meds = {t: i for t, i in vocab.items() if t.startswith("MED")}
    assert len(meds) == 1000 and max(meds.values()) == 4999 and "MED:1000" not in meds
    stats = {r.stream: (r.n_unique, r.n_kept, r.id_space) for r in vo.vocab_stats(counts).collect()}
    assert stats == {"MED": (1200, 1000, 5000), "PX10": (2, 2, 5002)}


def test_unknown_code_is_unk(spark):
    concepts = spark.createDataFrame([(1, "DX10:a"), (2, "DX10:z")], "concept_id BIGINT, token STRING")
    vocab = spark.createDataFrame([("DX10:a", 1000)], "token STRING, tid INT")
    assert {r.concept_id: r.tid for r in vo.with_ids(concepts, vocab).collect()} == {1: 1000, 2: 5}


def test_hot_concept_counts(spark):
    rows = [(i, "DX10", 1 if i % 3 else 2) for i in range(3000)]
    records = spark.createDataFrame(rows, "person_id BIGINT, stream STRING, concept_id BIGINT")
    concepts = spark.createDataFrame([("DX10", 1, "DX10:a"), ("DX10", 2, "DX10:a")], "stream STRING, concept_id BIGINT, token STRING")
    assert [tuple(r) for r in vo.count_tokens(records, concepts).collect()] == [("DX10", "DX10:a", 3000)]
