"""Queries: sources, code sets, cohort, events, splits and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalstrand.config import SAMPLE_KINDS
from vitalstrand.functions.scalars import encounter_type, hashed_code, record_field
from vitalstrand.operators import cohort as co
from vitalstrand.operators import signals as sg
from vitalstrand.operators import vocab as vo
from vitalstrand.operators.ranks import hash_sample
from vitalstrand.plans.oracle import cols, compose
from vitalstrand.plans.registry import dense, history, query
from vitalstrand.session import fresh_path
from vitalstrand.sources import bindings as b
from vitalstrand.sources import sinks
from vitalstrand.sources.snapshots import Snapshots
from vitalstrand.sources.tables import codeset_table

H, D = "history", "dense"
COHORT = "person_id:i fitbit_start:t fitbit_end:t year_of_birth:i age_at_fitbit_start:i"


# --- sources and sinks -----------------------------------------------------------------------------


@query(
    "restrict_ids",
    compose(H, f"SELECT {cols('person_id:i dt:t val:f')} FROM hr WHERE person_id IN (SELECT person_id FROM train)"),
)
def restrict_ids(spark, sf_dir):
    s = history(spark, sf_dir)
    kept = s.training(s.tables.heart_rate_minute_level)
    return kept.select("person_id", F.col("datetime").alias("dt"), F.col("heart_rate_value").alias("val"))


@query("cohort_roundtrip", compose(H, f"SELECT {cols(COHORT)} FROM cohort"))
def cohort_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "cohort-file")
    plan = history(spark, sf_dir).cohort_plan()
    sinks.write_table(plan, path)
    return sinks.read_table(spark, path, plan.schema)


@query("vocab_manifest", compose(H, "SELECT token, CAST(tid AS BIGINT) AS tid FROM vocab"))
def vocab_manifest(spark, sf_dir):
    """Write the vocabulary as one token -> id document, read it back, list its entries."""
    path = fresh_path(spark, "vocab-manifest")
    sinks.write_manifest(sinks.vocab_document(history(spark, sf_dir).vocab), path)
    back = sinks.read_manifest(spark, path, "vocab MAP<STRING, INT>")
    return back.select(F.explode("vocab").alias("token", "tid"))


@query("endpoint_manifest", compose(H, "SELECT name, CAST(concept_id AS BIGINT) AS concept_id FROM endpoint"))
def endpoint_manifest(spark, sf_dir):
    """Endpoint ids as a committed snapshot; a newer version that was written but never committed is not seen."""
    home, endpoints = fresh_path(spark, "endpoint-manifest"), history(spark, sf_dir).endpoint_concepts
    manifest = Snapshots(spark, home)
    manifest.commit(endpoints.limit(1), manifest.next_version())
    manifest.commit(endpoints, manifest.next_version())
    endpoints.limit(2).write.parquet(f"{home}/data/table-{manifest.next_version()}-unfinished")
    return manifest.read().select("name", "concept_id")


@query("split_manifest", compose(H, "SELECT CAST(person_id AS BIGINT) AS person_id, split FROM splits"))
def split_manifest(spark, sf_dir):
    """Split of each person from the committed manifest; persons of before the first commit come from the given table."""
    splits = history(spark, sf_dir).splits.select("person_id", "split")
    manifest = Snapshots(spark, fresh_path(spark, "split-manifest"))
    given = manifest.read(fallback=splits)
    manifest.commit(given.where("split <> 'test'"), manifest.next_version())
    manifest.commit(manifest.read().unionByName(splits.where("split = 'test'")), manifest.next_version(), partition_by=["split"])
    return manifest.read().select("person_id", "split")


@query(
    "sample_ids",
    compose(H, "SELECT CAST(person_id AS BIGINT) AS person_id FROM train ORDER BY md5('42:' || person_id) LIMIT 60"),
)
def sample_ids(spark, sf_dir):
    return hash_sample(history(spark, sf_dir).persons("train"), ["person_id"], 60, 42)


@query(
    "bounded_reference",
    compose(
        D,
        f"SELECT {cols('person_id:i day:d slot:i v:f')} FROM (SELECT * FROM hr_pool WHERE person_id IN "
        "(SELECT person_id FROM train) ORDER BY md5('42:' || person_id || ':' || strftime(day, '%Y-%m-%d') || ':' || slot) LIMIT 1000)",
    ),
)
def bounded_reference(spark, sf_dir):
    s = dense(spark, sf_dir)
    pooled = sg.hr_pooled(s.training(s.hr_sums))
    return sg.bounded_reference(pooled, ["person_id", "day", "slot"], 1000, 42)


_KINDS = ", ".join(f"('{k}', '{c}')" for k, c in SAMPLE_KINDS.items())


@query(
    "kind_filter",
    compose(
        D,
        f"SELECT {cols('event_id:i person_id:i')}, s.kind, class, {cols('start_ts:t value:f')} FROM samples s "
        f"JOIN (VALUES {_KINDS}) k(kind, class) ON s.kind = k.kind",
    ),
)
def kind_filter(spark, sf_dir):
    catalogue = spark.createDataFrame(list(SAMPLE_KINDS.items()), "kind STRING, class STRING")
    # fixed catalogue of a few dozen rows
    found = b.samples(spark, sf_dir).join(F.broadcast(catalogue), "kind")
    return found.select("event_id", "person_id", "kind", "class", "start_ts", "value")


# --- code sets -------------------------------------------------------------------------------------


@query("expand_codeset", compose(H, "SELECT name, CAST(concept_id AS BIGINT) AS concept_id FROM endpoint"))
def expand_codeset(spark, sf_dir):
    return history(spark, sf_dir).endpoint_plan()


@query("codeset_sizes", compose(H, "SELECT name, COUNT(*) AS n_concepts FROM endpoint GROUP BY name"))
def codeset_sizes(spark, sf_dir):
    return co.codeset_sizes(history(spark, sf_dir).endpoint_plan())


@query("endpoint_ids", compose(H, "SELECT CAST(concept_id AS BIGINT) AS concept_id FROM endpoint_ids"))
def endpoint_ids(spark, sf_dir):
    return co.endpoint_ids(history(spark, sf_dir).endpoint_plan())


@query("lab_prefix_filter", compose(H, "SELECT CAST(concept_id AS BIGINT) AS concept_id, concept_code, token FROM labc"))
def lab_prefix_filter(spark, sf_dir):
    return vo.lab_concepts(b.concept(spark, sf_dir), b.LAB_PREFIXES)


@query(
    "atc_class_filter",
    compose(
        H,
        "SELECT CAST(concept_id AS BIGINT) AS concept_id, concept_code FROM concept "
        "WHERE vocabulary_id = 'ATC' AND length(concept_code) = 4",
    ),
)
def atc_class_filter(spark, sf_dir):
    return vo.atc_classes(b.concept(spark, sf_dir))


@query(
    "hashed_codes",
    compose(
        D,
        "SELECT event_id, k AS code, 1000 + CAST('0x' || substr(md5('DX10:' || k), 1, 8) AS BIGINT) % 9000 AS bucket FROM ev_k",
    ),
)
def hashed_codes(spark, sf_dir):
    code = record_field("props", "$.k")
    return b.read(spark, sf_dir, "events").select(
        "event_id", code.cast("long").alias("code"), hashed_code("DX10", code).alias("bucket")
    )


@query("json_code", "SELECT event_id, json_extract_string(props, '$.k') AS code FROM events")
def json_code(spark, sf_dir):
    return b.read(spark, sf_dir, "events").select("event_id", record_field("props", "$.k").alias("code"))


# --- cohort ----------------------------------------------------------------------------------------


@query("person_span", compose(H, f"SELECT {cols('person_id:i fitbit_start:t fitbit_end:t')} FROM span"))
def person_span(spark, sf_dir):
    return co.observation_span(history(spark, sf_dir).tables.heart_rate_minute_level)


@query("span_filter", compose(H, f"SELECT {cols('person_id:i fitbit_start:t fitbit_end:t')} FROM long_span"))
def span_filter(spark, sf_dir):
    s = history(spark, sf_dir)
    return co.with_min_span(co.observation_span(s.tables.heart_rate_minute_level), s.params.min_span_days)


@query("ehr_persons", compose(H, "SELECT CAST(person_id AS BIGINT) AS person_id FROM ehr"))
def ehr_persons(spark, sf_dir):
    return co.ehr_persons(history(spark, sf_dir).tables.condition_occurrence)


@query(
    "age_filter",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, CAST(year(fitbit_start) - year_of_birth AS BIGINT) AS age_at_fitbit_start "
        "FROM span JOIN person USING (person_id) WHERE year(fitbit_start) - year_of_birth >= 40",
    ),
)
def age_filter(spark, sf_dir):
    t = history(spark, sf_dir).tables
    spans = co.observation_span(t.heart_rate_minute_level).join(t.person, "person_id")
    return co.with_age(spans, 40).select("person_id", "age_at_fitbit_start")


@query("cohort", compose(H, f"SELECT {cols(COHORT)} FROM cohort"))
def cohort(spark, sf_dir):
    return history(spark, sf_dir).cohort_plan()


# --- events ----------------------------------------------------------------------------------------

VISIT = "visit_concept_id:i visit_start_date:d visit_end_date:d encounter_type:s"


@query(
    "encounter_type",
    compose(
        H,
        "SELECT CAST(visit_id AS BIGINT) AS visit_occurrence_id, CASE WHEN visit_concept_id IN (9201, 9203, 262) "
        "THEN 'inpatient' ELSE 'outpatient' END AS encounter_type FROM visit",
    ),
)
def encounter_types(spark, sf_dir):
    visits = history(spark, sf_dir).tables.visit_occurrence
    return visits.select("visit_occurrence_id", encounter_type("visit_concept_id").alias("encounter_type"))


@query(
    "endpoint_events",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, strftime(day, '%Y-%m-%d') AS condition_start_date, "
        "CAST(concept_id AS BIGINT) AS condition_concept_id FROM endcond",
    ),
)
def endpoint_events(spark, sf_dir):
    found = history(spark, sf_dir).endpoint_conditions()
    return found.select("person_id", "condition_start_date", "condition_concept_id")


@query(
    "events_with_visit",
    compose(H, f"SELECT {cols('person_id:i condition_start_date:d condition_concept_id:i ' + VISIT)} FROM ev_visit"),
)
def events_with_visit(spark, sf_dir):
    s = history(spark, sf_dir)
    joined = co.events_with_visit(s.endpoint_conditions(), s.tables.visit_occurrence)
    return joined.drop("condition_source_concept_id")


_EVENT = "person_id:i event_date:t condition_concept_id:i encounter_type:s fitbit_start:t"


@query("cohort_events", compose(H, f"SELECT {cols(_EVENT)} FROM ev"))
def cohort_events(spark, sf_dir):
    return history(spark, sf_dir).events().select(
        "person_id", "event_date", "condition_concept_id", "encounter_type", "fitbit_start"
    )


@query("events_after_start", compose(H, f"SELECT {cols(_EVENT)} FROM ev_after"))
def events_after_start(spark, sf_dir):
    return history(spark, sf_dir).events_after_start().select(
        "person_id", "event_date", "condition_concept_id", "encounter_type", "fitbit_start"
    )


@query(
    "first_event",
    compose(
        H,
        f"SELECT {cols('person_id:i event_date:t condition_concept_id:i ' + VISIT)} FROM (SELECT *, row_number() OVER "
        "(PARTITION BY person_id ORDER BY event_date, condition_concept_id, visit_concept_id, visit_start_date) AS r "
        "FROM ev_after) WHERE r = 1",
    ),
)
def first_event(spark, sf_dir):
    return co.first_event(history(spark, sf_dir).events_after_start())


@query(
    "first_event_nonnull",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, "
        + ", ".join(
            f"(list({c} ORDER BY event_date, condition_concept_id, visit_concept_id, visit_start_date) "
            f"FILTER (WHERE {c} IS NOT NULL))[1] AS {c}"
            for c in ("visit_concept_id", "encounter_type")
        )
        + " FROM ev_after GROUP BY person_id",
    ).replace("[1] AS visit_concept_id", "[1]::BIGINT AS visit_concept_id"),
)
def first_event_nonnull(spark, sf_dir):
    first = co.first_event(history(spark, sf_dir).events_after_start(), "first_nonnull")
    return first.select("person_id", "visit_concept_id", "encounter_type")


@query("has_event", compose(H, f"SELECT {cols('person_id:i has_event:i')} FROM flagged"))
def has_event(spark, sf_dir):
    return history(spark, sf_dir).flagged.select("person_id", "has_event")


@query(
    "endpoint_inpatient",
    compose(
        H,
        "SELECT name, CAST(person_id AS BIGINT) AS person_id, strftime(condition_start_date, '%Y-%m-%d') AS condition_start_date, "
        "CAST(condition_concept_id AS BIGINT) AS condition_concept_id, encounter_type FROM ev_visit "
        "JOIN endpoint ON condition_concept_id = concept_id WHERE name <> 'mi' OR encounter_type = 'inpatient'",
    ),
)
def endpoint_inpatient(spark, sf_dir):
    s = history(spark, sf_dir)
    events = co.events_with_visit(s.endpoint_conditions(), s.tables.visit_occurrence)
    return co.qualified_events(events, s.endpoint_concepts).select(
        "name", "person_id", "condition_start_date", "condition_concept_id", "encounter_type"
    )


@query(
    "endpoint_hf",
    compose(
        H,
        "SELECT CAST(li.person_id AS BIGINT) AS person_id, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS condition_start_date, "
        "CAST(l_partkey AS BIGINT) AS condition_concept_id, strftime(MIN(CAST(v.o_orderdate AS DATE)), '%Y-%m-%d') AS admission_date "
        "FROM li JOIN orders v ON v.o_custkey = li.person_id AND substr(v.o_orderpriority, 1, 1) IN ('1', '2', '3') "
        "AND CAST(l_shipdate AS DATE) BETWEEN CAST(v.o_orderdate AS DATE) AND CAST(v.o_orderdate AS DATE) + 2 "
        "WHERE l_returnflag IN ('A', 'R') AND l_linenumber % 2 = 1 AND l_partkey IN (SELECT concept_id FROM concept "
        "WHERE vocabulary_id = 'ICD10CM' AND (concept_code LIKE 'S%' OR concept_code LIKE 'E1%' OR concept_code LIKE 'E2%')) "
        "GROUP BY li.person_id, CAST(l_shipdate AS DATE), l_partkey",
    ),
)
def endpoint_hf(spark, sf_dir):
    """Heart failure as primary diagnosis during an admission."""
    t = history(spark, sf_dir).tables
    ids = co.endpoint_ids(co.expand_codeset(t.concept, codeset_table(spark, b.HF_CODESET)))
    return co.admitted_primary_events(t.condition_occurrence, ids, t.visit_occurrence)


@query(
    "death_endpoint",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, strftime(day, '%Y-%m-%d') AS event_day, kind FROM "
        "(SELECT person_id, day, 'condition' AS kind FROM endcond UNION ALL SELECT person_id, death_date, 'death' FROM death "
        "WHERE cause_concept_id IN (SELECT concept_id FROM endpoint_ids))",
    ),
)
def death_endpoint(spark, sf_dir):
    s = history(spark, sf_dir)
    conditions = s.endpoint_conditions().select("person_id", F.col("condition_start_date").alias("event_day"))
    deaths = co.death_events(s.tables.death, s.endpoint_ids)
    return conditions.withColumn("kind", F.lit("condition")).unionByName(deaths.withColumn("kind", F.lit("death")))


@query(
    "device_afib",
    compose(
        D,
        "SELECT CAST(person_id AS BIGINT) AS person_id, strftime(day, '%Y-%m-%d') AS event_day, source FROM "
        "(SELECT DISTINCT person_id, day, 'record' AS source FROM endcond UNION ALL "
        "SELECT DISTINCT user_id, CAST(ts AS DATE), 'device' FROM ev_k WHERE event_type = 'error' AND k < 10)",
    ),
)
def device_afib(spark, sf_dir):
    """Endpoint days from records and from device-detected atrial fibrillation."""
    recorded = dense(spark, sf_dir).endpoint_conditions().select("person_id", F.col("condition_start_date").alias("event_day"))
    detected = co.device_afib_events(b.ecg_records(spark, sf_dir))
    return recorded.distinct().withColumn("source", F.lit("record")).unionByName(detected.withColumn("source", F.lit("device")))


# --- splits ----------------------------------------------------------------------------------------


@query("stratified_split", compose(H, f"SELECT {cols('person_id:i has_event:i')}, split FROM splits"))
def stratified_split(spark, sf_dir):
    return history(spark, sf_dir).splits.select("person_id", "has_event", "split")


@query(
    "threshold_split",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, CASE WHEN u < 15 THEN 'test' WHEN u < 30 THEN 'val' ELSE 'train' END AS split "
        "FROM (SELECT person_id, 100 * (CAST('0x' || substr(md5('20260606:' || person_id), 1, 8) AS BIGINT) / 4294967296.0) AS u FROM cohort)",
    ),
)
def threshold_split(spark, sf_dir):
    s = history(spark, sf_dir)
    return co.threshold_split(s.cohort_plan(), s.params.split_seed).select("person_id", "split")


@query(
    "split_overlap",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, MIN(split) AS first_split, MAX(split) AS last_split FROM splits "
        "GROUP BY person_id HAVING COUNT(DISTINCT split) > 1",
    ),
)
def split_overlap(spark, sf_dir):
    return co.split_overlap(history(spark, sf_dir).splits)


@query(
    "split_overlap_reserved",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, MIN(split) AS first_split, MAX(split) AS last_split FROM (SELECT person_id, split "
        "FROM splits UNION ALL SELECT person_id, 'test' FROM splits WHERE has_event = 1) GROUP BY person_id HAVING COUNT(DISTINCT split) > 1",
    ),
)
def split_overlap_reserved(spark, sf_dir):
    """Persons that a second list, which reserves everyone with an event for testing, places in another split."""
    splits = history(spark, sf_dir).splits
    reserved = splits.where("has_event = 1").select("person_id", F.lit("test").alias("split"))
    return co.split_overlap(splits.select("person_id", "split").unionByName(reserved))


_TRAIN = "person_id IN (SELECT person_id FROM train)"


@query(
    "leakage_audit",
    compose(
        H,
        "SELECT artefact, n AS n_rows, n AS n_allowed, CAST(0 AS BIGINT) AS leaked FROM (SELECT 'hr_cuts' AS artefact, COUNT(*) AS n FROM "
        f"(SELECT DISTINCT person_id, date_trunc('hour', dt), minute(dt) // 5 FROM hr WHERE val IS NOT NULL AND {_TRAIN}) "
        f"UNION ALL SELECT 'steps_cuts', COUNT(*) FROM steps_day WHERE {_TRAIN} "
        "UNION ALL SELECT 'vocab', COUNT(*) FROM (SELECT person_id FROM cond UNION ALL SELECT person_id FROM proc "
        f"UNION ALL SELECT person_id FROM drug UNION ALL SELECT person_id FROM meas) WHERE {_TRAIN})",
    ),
)
def leakage_audit(spark, sf_dir):
    """Fitted artefacts and whether they read other rows than those of training persons."""
    return history(spark, sf_dir).leakage()


@query(
    "split_stats",
    compose(H, "SELECT split, COUNT(*) AS n, ROUND(AVG(has_event), 6) AS pos_rate FROM splits GROUP BY split"),
)
def split_stats(spark, sf_dir):
    return co.split_stats(history(spark, sf_dir).splits, "has_event")


# --- codes and vocabulary --------------------------------------------------------------------------


def _coded(name, facts, concepts):
    return query(
        name,
        compose(H, f"SELECT CAST(person_id AS BIGINT) AS person_id, strftime(day, '%Y-%m-%d') AS day, token FROM {facts} JOIN {concepts} USING (concept_id)"),
    )


@_coded("dx_codes", "cond", "dxc")
def dx_codes(spark, sf_dir):
    t = history(spark, sf_dir).tables
    return vo.with_codes(t.condition_occurrence, "condition_source_concept_id", vo.dx_concepts(t.concept)).select(
        "person_id", F.col("condition_start_date").alias("day"), "token"
    )


@_coded("px_codes", "proc", "pxc")
def px_codes(spark, sf_dir):
    t = history(spark, sf_dir).tables
    return vo.with_codes(t.procedure_occurrence, "procedure_concept_id", vo.px_concepts(t.concept)).select(
        "person_id", F.col("procedure_date").alias("day"), "token"
    )


@_coded("lab_codes", "meas", "labc")
def lab_codes(spark, sf_dir):
    t = history(spark, sf_dir).tables
    return vo.with_codes(t.measurement, "measurement_concept_id", vo.lab_concepts(t.concept, b.LAB_PREFIXES)).select(
        "person_id", F.col("measurement_date").alias("day"), "token"
    )


@_coded("med_classes", "drug", "medc")
def med_classes(spark, sf_dir):
    t = history(spark, sf_dir).tables
    return vo.with_codes(t.drug_exposure, "drug_concept_id", vo.med_concepts(t.concept, t.concept_ancestor)).select(
        "person_id", F.col("drug_exposure_start_date").alias("day"), "token"
    )


@query("token_counts", compose(H, "SELECT stream, token, n FROM token_counts"))
def token_counts(spark, sf_dir):
    return history(spark, sf_dir).token_counts()


@query("top_tokens", compose(H, f"SELECT stream, token, {cols('n:i rank:i')} FROM token_rank WHERE rank <= 5"))
def top_tokens(spark, sf_dir):
    return vo.top_tokens(history(spark, sf_dir).token_counts(), 5)


@query("vocab", compose(H, f"SELECT token, {cols('tid:i')}, stream, {cols('n:i')} FROM vocab"))
def vocab(spark, sf_dir):
    return history(spark, sf_dir).vocab


@query(
    "vocab_stats",
    compose(
        H,
        "SELECT stream, COUNT(*) AS n_unique, CAST(MIN(LEAST(cnt, width)) AS BIGINT) AS n_kept, "
        "CAST(MIN(lo + LEAST(cnt, width)) AS BIGINT) AS id_space FROM (SELECT t.stream, lo, hi - lo + 1 AS width, "
        "COUNT(*) OVER (PARTITION BY t.stream) AS cnt FROM token_counts t JOIN id_ranges i ON t.stream = i.stream) GROUP BY stream",
    ),
)
def vocab_stats(spark, sf_dir):
    return vo.vocab_stats(history(spark, sf_dir).token_counts())


@query(
    "vocab_totals",
    compose(
        H,
        "SELECT n_unique, n_kept, n_unique - n_kept AS n_dropped, CAST(top AS BIGINT) AS id_space FROM "
        "(SELECT COUNT(*) AS n_unique FROM token_counts), (SELECT COUNT(n) AS n_kept, MAX(tid) + 1 AS top FROM vocab)",
    ),
)
def vocab_totals(spark, sf_dir):
    s = history(spark, sf_dir)
    return vo.vocab_totals(s.token_counts(), s.vocab)
