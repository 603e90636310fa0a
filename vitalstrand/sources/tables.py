"""Clinical and wearable source tables with their declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "concept": "concept_id BIGINT, concept_code STRING, concept_name STRING, vocabulary_id STRING",
    "concept_ancestor": "ancestor_concept_id BIGINT, descendant_concept_id BIGINT",
    "person": "person_id BIGINT, year_of_birth INT, gender_concept_id BIGINT, race_concept_id BIGINT, "
    "ethnicity_concept_id BIGINT",
    "heart_rate_minute_level": "person_id BIGINT, datetime TIMESTAMP, heart_rate_value DOUBLE",
    "steps_intraday": "person_id BIGINT, datetime TIMESTAMP, steps DOUBLE",
    "condition_occurrence": "person_id BIGINT, condition_start_date DATE, condition_concept_id BIGINT, "
    "condition_source_concept_id BIGINT, visit_occurrence_id BIGINT, condition_status_concept_id BIGINT",
    "visit_occurrence": "visit_occurrence_id BIGINT, visit_concept_id BIGINT, visit_start_date DATE, "
    "visit_end_date DATE, person_id BIGINT",
    "drug_exposure": "person_id BIGINT, drug_exposure_start_date DATE, drug_concept_id BIGINT",
    "procedure_occurrence": "person_id BIGINT, procedure_date DATE, procedure_concept_id BIGINT",
    "measurement": "person_id BIGINT, measurement_date DATE, measurement_concept_id BIGINT, value_as_number DOUBLE",
    "death": "person_id BIGINT, death_date DATE, cause_concept_id BIGINT",
    "codeset": "name STRING, prefix STRING",
}


@dataclass
class ClinicalTables:
    """The tables a study reads; a table the source lacks stays ``None``."""

    concept: DataFrame
    person: DataFrame
    heart_rate_minute_level: DataFrame
    steps_intraday: DataFrame
    condition_occurrence: DataFrame
    procedure_occurrence: DataFrame
    codeset: DataFrame
    concept_ancestor: DataFrame | None = None
    visit_occurrence: DataFrame | None = None
    drug_exposure: DataFrame | None = None
    measurement: DataFrame | None = None
    death: DataFrame | None = None

    def register(self, prefix: str = "") -> None:
        """Expose every present table to ``spark.sql``."""
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None:
                df.createOrReplaceTempView(f"{prefix}{f.name}")


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Scan one clinical table with its declared schema; only the columns used later are read."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{root.rstrip('/')}/{table}")


def load_tables(spark: SparkSession, root: str, present: tuple[str, ...] = tuple(SCHEMAS)) -> ClinicalTables:
    return ClinicalTables(**{name: scan(spark, root, name) for name in present})


def codeset_table(spark: SparkSession, codesets: dict[str, list[str]]) -> DataFrame:
    """Long table (name, prefix); a set without prefixes contributes no row."""
    rows = [(name, prefix) for name, prefixes in codesets.items() for prefix in prefixes]
    return spark.createDataFrame(rows, SCHEMAS["codeset"])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast and order the columns of ``df`` to a declared schema; missing columns become null."""
    out = []
    for part in SCHEMAS[table].split(", "):
        name, dtype = part.split(" ")
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(dtype).alias(name))
    return df.select(*out)
