"""Views that present the generated star schema as clinical and wearable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstrand.config import StudyParams, uniform_stride
from vitalstrand.operators.joins import may_hold
from vitalstrand.session import stage
from vitalstrand.sources.tables import ClinicalTables, codeset_table, conform

CODESETS = {"afib": ["E0"], "mi": ["M1", "P2"], "cardio_mortality": []}
HF_CODESET = {"hf": ["S", "E1", "E2"]}
LAB_PREFIXES = ("E1", "L0", "M2", "P0", "S1")

HISTORY_PARAMS = StudyParams()
STREAM_PARAMS = StudyParams(
    min_span_days=20, min_age=None, window_days=7, lookahead_days=7, stride_days=uniform_stride(3)
)

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # wall-clock semantics throughout: zone-less timestamps are read as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    brand = F.lpad(F.substring("p_brand", 7, 10), 2, "0")
    coded = part.select(
        key.alias("concept_id"),
        F.concat(F.substring("p_type", 1, 1), brand, F.lit("."), F.col("p_size").cast("string")).alias("concept_code"),
        F.col("p_name").alias("concept_name"),
        F.when(key % 4 == 2, "ICD10PCS").when(key % 4 == 3, "LOINC").otherwise("ICD10CM").alias("vocabulary_id"),
    )
    slot = (key % 50).alias("slot")
    classes = part.select(slot).distinct().select(
        (F.lit(1_000_000) + F.col("slot")).alias("concept_id"),
        F.concat(
            F.lit("C"),
            F.lpad(F.col("slot").cast("string"), 2, "0"),
            F.lit("A"),
            F.when(F.col("slot") % 5 == 0, "B").otherwise(""),
        ).alias("concept_code"),
        F.lit("class").alias("concept_name"),
        F.lit("ATC").alias("vocabulary_id"),
    )
    return conform(coded.unionByName(classes), "concept")


def concept_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    both = read(spark, sf_dir, "part").select(
        key.alias("descendant_concept_id"),
        F.explode(
            F.array_distinct(F.array(F.lit(1_000_000) + key % 50, F.lit(1_000_000) + (key * 7) % 50))
        ).alias("ancestor_concept_id"),
    )
    return conform(both, "concept_ancestor")


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return conform(
        read(spark, sf_dir, "customer").select(key.alias("person_id"), (F.lit(1930) + key % 60).alias("year_of_birth")),
        "person",
    )


def clinical_history(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    """Long clinical history: orders are heart-rate readings and visits, line items are records."""
    orders = read(spark, sf_dir, "orders")
    items = read(spark, sf_dir, "lineitem")
    who = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id"))
    day = F.col("l_shipdate").cast("date")

    def records(keep=None) -> DataFrame:
        return (items if keep is None else items.where(keep)).join(who, "l_orderkey")

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    code = F.col("l_partkey")
    priority = F.substring("o_orderpriority", 1, 1)
    return ClinicalTables(
        concept=concept(spark, sf_dir),
        concept_ancestor=concept_ancestor(spark, sf_dir),
        person=person(spark, sf_dir),
        codeset=codeset_table(spark, CODESETS),
        heart_rate_minute_level=conform(
            orders.select(
                F.col("o_custkey").alias("person_id"),
                F.col("o_orderdate").alias("datetime"),
                F.col("o_totalprice").alias("heart_rate_value"),
            ),
            "heart_rate_minute_level",
        ),
        steps_intraday=conform(
            records().select(
                "person_id", F.col("l_shipdate").alias("datetime"), F.col("l_quantity").alias("steps")
            ),
            "steps_intraday",
        ),
        condition_occurrence=conform(
            records(flag.isin("A", "R")).select(
                "person_id",
                day.alias("condition_start_date"),
                code.alias("condition_concept_id"),
                code.alias("condition_source_concept_id"),
                F.col("l_orderkey").alias("visit_occurrence_id"),
                F.when(F.col("l_linenumber") % 2 == 1, 32902).otherwise(32908).alias("condition_status_concept_id"),
            ),
            "condition_occurrence",
        ),
        procedure_occurrence=conform(
            records(flag == "N").select(
                "person_id", day.alias("procedure_date"), code.alias("procedure_concept_id")
            ),
            "procedure_occurrence",
        ),
        drug_exposure=conform(
            records(status == "F").select(
                "person_id", day.alias("drug_exposure_start_date"), code.alias("drug_concept_id")
            ),
            "drug_exposure",
        ),
        measurement=conform(
            records(status == "O").select(
                "person_id",
                day.alias("measurement_date"),
                code.alias("measurement_concept_id"),
                F.col("l_extendedprice").alias("value_as_number"),
            ),
            "measurement",
        ),
        visit_occurrence=conform(
            orders.select(
                F.col("o_orderkey").alias("visit_occurrence_id"),
                F.when(priority == "1", 9201)
                .when(priority == "2", 9203)
                .when(priority == "3", 262)
                .otherwise(9202)
                .alias("visit_concept_id"),
                F.col("o_orderdate").cast("date").alias("visit_start_date"),
                F.date_add(F.col("o_orderdate").cast("date"), 2).alias("visit_end_date"),
                F.col("o_custkey").alias("person_id"),
            ),
            "visit_occurrence",
        ),
        death=conform(
            orders.join(
                read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey")),
                "o_custkey",
            )
            .groupBy(F.col("o_custkey").alias("person_id"))
            .agg(F.max(F.col("o_orderdate").cast("date")).alias("death_date"))
            .withColumn("cause_concept_id", F.col("person_id")),
            "death",
        ),
    )


def history_records(spark: SparkSession, sf_dir: str, persons: DataFrame) -> dict[str, DataFrame]:
    """Step and coded records of ``persons`` from one join of line items with orders, by table.

    The joined rows are written once and every table is a filter of them; columns that a study does not read are left out.
    Line items of other persons are mostly left out before the join.
    """
    who = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("bigint").alias("person_id"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    asked = stage(who.join(persons.select("person_id"), "person_id", "left_semi"), "asked-orders")
    mine = may_hold(items, asked, "l_orderkey", "l_orderkey").join(asked, "l_orderkey").drop("l_orderkey")
    rows = stage(mine, "records")
    who, day, code = F.col("person_id"), F.col("l_shipdate").cast("date"), F.col("l_partkey").cast("bigint")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    at, steps = F.col("l_shipdate").cast("timestamp"), F.col("l_quantity").cast("double")
    return {
        "steps_intraday": rows.select(who, at.alias("datetime"), steps.alias("steps")),
        "condition_occurrence": rows.where(flag.isin("A", "R")).select(
            who, day.alias("condition_start_date"), code.alias("condition_source_concept_id")
        ),
        "procedure_occurrence": rows.where(flag == "N").select(who, day.alias("procedure_date"), code.alias("procedure_concept_id")),
        "drug_exposure": rows.where(status == "F").select(who, day.alias("drug_exposure_start_date"), code.alias("drug_concept_id")),
        "measurement": rows.where(status == "O").select(who, day.alias("measurement_date"), code.alias("measurement_concept_id")),
    }


def event_key(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("long")


def dense_stream(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    """Dense short stream: every table is a slice of ``events``."""
    return event_tables(spark, sf_dir, read(spark, sf_dir, "events"))


def event_tables(spark: SparkSession, sf_dir: str, events: DataFrame) -> ClinicalTables:
    kind = F.col("event_type")
    who = F.col("user_id").alias("person_id")
    day = F.col("ts").cast("date")
    return ClinicalTables(
        concept=concept(spark, sf_dir),
        person=person(spark, sf_dir),
        codeset=codeset_table(spark, CODESETS),
        heart_rate_minute_level=conform(
            events.where(kind.isin("click", "view")).select(
                who, F.col("ts").alias("datetime"), F.col("value").alias("heart_rate_value")
            ),
            "heart_rate_minute_level",
        ),
        steps_intraday=conform(
            events.where(kind == "view").select(who, F.col("ts").alias("datetime"), F.col("value").alias("steps")),
            "steps_intraday",
        ),
        condition_occurrence=conform(
            events.where(kind.isin("purchase", "error")).select(
                who,
                day.alias("condition_start_date"),
                event_key().alias("condition_concept_id"),
                event_key().alias("condition_source_concept_id"),
            ),
            "condition_occurrence",
        ),
        procedure_occurrence=conform(
            events.where(kind == "signup").select(
                who, day.alias("procedure_date"), event_key().alias("procedure_concept_id")
            ),
            "procedure_occurrence",
        ),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone samples: one per event, lasting ``k`` minutes."""
    kind = F.col("event_type")
    start = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("person_id"),
        F.when(kind == "click", "heartRate")
        .when(kind == "view", "stepCount")
        .when(kind == "purchase", "conditionRecord")
        .when(kind == "signup", "sleepAnalysis")
        .otherwise("unlistedKind")
        .alias("kind"),
        start.alias("start_ts"),
        F.timestamp_seconds(F.unix_seconds(start) + event_key() * 60).alias("end_ts"),
        "value",
        "props",
    )


def sleep_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = event_key() % 4
    start = F.col("ts").cast("timestamp")
    return (
        read(spark, sf_dir, "events")
        .where(F.col("event_type") == "view")
        .select(
            F.col("user_id").alias("person_id"),
            F.when(stage == 0, "AWAKE").when(stage == 1, "LIGHT").when(stage == 2, "DEEP").otherwise("REM").alias("stage"),
            start.alias("start_ts"),
            F.timestamp_seconds(F.unix_seconds(start) + (event_key() + 1) * 60).alias("end_ts"),
        )
    )


def ecg_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("user_id").alias("person_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(event_key() < 10, "atrialFibrillation").otherwise("sinusRhythm").alias("classification"),
        )
    )


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows for the metric queries: labelled documents with a length-based logit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "lang",
        (F.col("doc_id") % 6).cast("int").alias("epoch"),
        "y",
        F.round(F.log(F.lit(1.0) + F.col("n_chars")) - F.lit(5.0), 6).alias("logit"),
    )
