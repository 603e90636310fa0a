"""Cohort selection, endpoint events and participant splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.config import PRIMARY_STATUSES
from vitalstrand.functions.scalars import encounter_type
from vitalstrand.operators.joins import within_spans
from vitalstrand.operators.ranks import hash_ranked, uniform


# ids up to this many (a few MB) are sent to every executor instead of shuffling the signal table
BROADCAST_IDS = 500_000


def restrict(df: DataFrame, ids: DataFrame, on: str = "person_id", n_ids: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``; the ids stay a table, never a literal list.

    ``n_ids`` is the known row count of ``ids``. Small enough, they are broadcast and the signal table is
    filtered where it is read; otherwise the optimizer chooses from the sizes it sees.
    """
    keys = ids.select(on)
    if n_ids is not None and n_ids <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


# --- code sets -------------------------------------------------------------------------------------


def expand_codeset(concept: DataFrame, codeset: DataFrame, vocabulary: str = "ICD10CM") -> DataFrame:
    """(name, concept_id) for every code that starts with one of the set's prefixes.

    A code is matched through its own leading substrings, so the join is an equi-join on text.
    """
    codes = concept.where((F.col("vocabulary_id") == vocabulary) & (F.length("concept_code") > 0))
    heads = codes.select("concept_id", "concept_code", F.explode(F.sequence(F.lit(1), F.length("concept_code"))).alias("len"))
    cut = heads.select("concept_id", F.expr("substring(concept_code, 1, len)").alias("prefix"))
    return cut.join(codeset.where(F.length("prefix") > 0), "prefix").select("name", "concept_id").distinct()


def prefix_filter(df: DataFrame, column: str, prefixes) -> DataFrame:
    """Rows whose code starts with one of a short constant list of prefixes."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col(column).startswith(p)
    return df.where(keep)


def codeset_sizes(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("name").agg(F.count(F.lit(1)).alias("n_concepts"))


def endpoint_ids(expanded: DataFrame) -> DataFrame:
    return expanded.select("concept_id").distinct()


# --- cohort ----------------------------------------------------------------------------------------


def observation_span(hr: DataFrame) -> DataFrame:
    return hr.groupBy("person_id").agg(
        F.min("datetime").alias("fitbit_start"), F.max("datetime").alias("fitbit_end")
    )


def with_min_span(span: DataFrame, days: int) -> DataFrame:
    return span.where(F.datediff(F.to_date("fitbit_end"), F.to_date("fitbit_start")) >= days)


def ehr_persons(conditions: DataFrame) -> DataFrame:
    return conditions.select("person_id").distinct()


def with_age(df: DataFrame, min_age: int | None) -> DataFrame:
    aged = df.withColumn("age_at_fitbit_start", F.year("fitbit_start") - F.col("year_of_birth"))
    return aged if min_age is None else aged.where(F.col("age_at_fitbit_start") >= min_age)


def build_cohort(
    hr: DataFrame, conditions: DataFrame, person: DataFrame, min_span_days: int = 180, min_age: int | None = 40
) -> DataFrame:
    """Persons with a long enough signal, at least one condition record, and the minimum age."""
    return restrict(candidates(hr, person, min_span_days, min_age), ehr_persons(conditions))


def candidates(hr: DataFrame, person: DataFrame, min_span_days: int = 180, min_age: int | None = 40) -> DataFrame:
    """Persons with a long enough signal and the minimum age."""
    spans = with_min_span(observation_span(hr), min_span_days)
    joined = spans.join(person.select("person_id", "year_of_birth"), "person_id")
    return with_age(joined, min_age).select(
        "person_id", "fitbit_start", "fitbit_end", "year_of_birth", "age_at_fitbit_start"
    )


# --- endpoint events -------------------------------------------------------------------------------


def endpoint_conditions(conditions: DataFrame, ids: DataFrame, n_ids: int | None = None) -> DataFrame:
    """Condition records whose source concept is an endpoint."""
    keys = ids.withColumnRenamed("concept_id", "condition_source_concept_id")
    return restrict(conditions, keys, "condition_source_concept_id", n_ids)


def events_with_visit(events: DataFrame, visits: DataFrame | None) -> DataFrame:
    """Left-join the visit and classify the encounter; an event without a visit is outpatient."""
    if visits is None:
        blank = events.select(
            "*",
            F.lit(None).cast("long").alias("visit_concept_id"),
            F.lit(None).cast("date").alias("visit_start_date"),
            F.lit(None).cast("date").alias("visit_end_date"),
        )
    else:
        # events without a visit share one null key; the salt spreads them, and they match nothing anyway
        salt = F.when(F.col("visit_occurrence_id").isNull(), F.pmod(F.xxhash64("person_id"), F.lit(64))).otherwise(0)
        known = visits.select("visit_occurrence_id", "visit_concept_id", "visit_start_date", "visit_end_date")
        blank = events.withColumn("_salt", salt).join(
            known.withColumn("_salt", F.lit(0).cast("long")), ["visit_occurrence_id", "_salt"], "left"
        )
    return blank.select(
        "person_id",
        "condition_start_date",
        "condition_concept_id",
        "condition_source_concept_id",
        "visit_concept_id",
        "visit_start_date",
        "visit_end_date",
        encounter_type("visit_concept_id").alias("encounter_type"),
    )


def cohort_events(events: DataFrame, cohort: DataFrame) -> DataFrame:
    return events.join(cohort.select("person_id", "fitbit_start", "fitbit_end"), "person_id").withColumn(
        "event_date", F.col("condition_start_date").cast("timestamp")
    )


def after_start(events: DataFrame) -> DataFrame:
    """Events at or after the first signal; a date counts as its midnight."""
    return events.where(F.col("event_date") >= F.col("fitbit_start"))


EVENT_FIELDS = ("condition_concept_id", "visit_concept_id", "visit_start_date", "visit_end_date", "encounter_type")


def first_event(events: DataFrame, variant: str = "first_row") -> DataFrame:
    """Earliest event per person as a combining aggregate, so a hot person never meets one sort.

    ``first_row`` keeps the whole earliest row (ties by concept, then visit);
    ``first_nonnull`` takes each field from the earliest row where it is present.
    """
    order = F.struct("event_date", "condition_concept_id", "visit_concept_id", "visit_start_date", "visit_end_date")
    if variant == "first_row":
        best = F.min(F.struct("event_date", *EVENT_FIELDS)).alias("e")
        return events.groupBy("person_id").agg(best).select("person_id", "e.*")
    if variant == "first_nonnull":
        return events.groupBy("person_id").agg(
            F.min("event_date").alias("event_date"),
            *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in EVENT_FIELDS],
        )
    raise ValueError(f"unknown variant {variant!r}")


def flag_events(cohort: DataFrame, persons_with_event: DataFrame) -> DataFrame:
    flagged = persons_with_event.select("person_id").distinct().withColumn("_hit", F.lit(1))
    return cohort.join(flagged, "person_id", "left").withColumn("has_event", F.coalesce("_hit", F.lit(0))).drop("_hit")


def qualified_events(events: DataFrame, expanded: DataFrame, inpatient_only=("mi", "hf")) -> DataFrame:
    """Endpoint events by code set; the sets named in ``inpatient_only`` need an inpatient encounter."""
    named = events.join(
        expanded.select("name", F.col("concept_id").alias("condition_source_concept_id")), "condition_source_concept_id"
    )
    return named.where(~F.col("name").isin(*inpatient_only) | (F.col("encounter_type") == "inpatient"))


def admitted_primary_events(conditions: DataFrame, ids: DataFrame, visits: DataFrame, statuses=PRIMARY_STATUSES) -> DataFrame:
    """Primary diagnoses of a code set within an inpatient stay of the person, with the earliest such stay's first day.

    One row for each (person_id, condition_start_date, condition_concept_id). The stay is found by its days, so a condition
    needs no visit id; a stay without an end is one day.
    """
    day, stay = "condition_start_date", ("visit_start_date", "visit_end_date")
    coded = conditions.where(F.col("condition_status_concept_id").isin(*statuses)).join(
        ids.select(F.col("concept_id").alias("condition_source_concept_id")), "condition_source_concept_id", "left_semi"
    )
    stays = visits.where(encounter_type("visit_concept_id") == "inpatient").select(
        "person_id", stay[0], F.coalesce(stay[1], stay[0]).alias(stay[1])
    )
    keys = ["person_id", day, "condition_concept_id"]
    held = within_spans(coded.select(*keys).distinct(), stays.distinct(), ["person_id"], day, *stay)
    return held.groupBy(*keys).agg(F.min(stay[0]).alias("admission_date"))


def device_afib_events(records: DataFrame) -> DataFrame:
    """Days on which a device recorded atrial fibrillation, as endpoint events (person_id, event_day)."""
    found = records.where(F.col("classification") == "atrialFibrillation")
    return found.select("person_id", F.to_date("ts").alias("event_day")).distinct()


def death_events(death: DataFrame, cause_ids: DataFrame) -> DataFrame:
    """Deaths whose cause is in a code set, as endpoint events (person_id, event_day)."""
    return death.join(
        cause_ids.select(F.col("concept_id").alias("cause_concept_id")), "cause_concept_id", "left_semi"
    ).select("person_id", F.col("death_date").alias("event_day"))


# --- splits ----------------------------------------------------------------------------------------


def _ceil_share(n, part: int, whole: int):
    return F.floor((n * part + (whole - 1)) / whole)


def stratified_split(
    cohort: DataFrame, seed: int, test_percent: int = 15, val_percent: int = 15, stratum: str = "has_event"
) -> DataFrame:
    """Exact stratified split by hash rank: test first, then validation, the rest is training."""
    ranked = hash_ranked(cohort, ["person_id"], seed, [stratum])
    n_test = _ceil_share(F.col("group_size"), test_percent, 100)
    n_val = _ceil_share(F.col("group_size") - n_test, val_percent, 100 - test_percent)
    split = (
        F.when(F.col("ordinal") < n_test, "test").when(F.col("ordinal") < n_test + n_val, "val").otherwise("train")
    )
    return ranked.withColumn("split", split).drop("ordinal", "group_size")


def threshold_split(cohort: DataFrame, seed: int, test_percent: int = 15, val_percent: int = 15) -> DataFrame:
    """Split by hash value alone: no shuffle, stable as persons join, sizes only approximate."""
    u = uniform(seed, "person_id") * 100
    split = F.when(u < test_percent, "test").when(u < test_percent + val_percent, "val").otherwise("train")
    return cohort.withColumn("split", split)


def split_overlap(assignments: DataFrame) -> DataFrame:
    """Persons found in more than one split; empty when the splits are disjoint."""
    return (
        assignments.groupBy("person_id")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def split_stats(rows: DataFrame, label: str, by: str = "split") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("pos_rate"))
