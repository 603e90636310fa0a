"""Registered queries: a DataFrame callable and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalstrand.config import StudyParams
from vitalstrand.plans.study import Study
from vitalstrand.sources import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Engine-neutral column types: long, double rounded to 6 places, and text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, (T.IntegralType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " ")
        out.append(c.alias(f.name))
    return df.select(*out)


def history(spark: SparkSession, sf_dir: str, **changes) -> Study:
    """Study over the long clinical history."""
    return Study(
        b.clinical_history(spark, sf_dir), b.HISTORY_PARAMS.with_(**changes), b.LAB_PREFIXES, lambda persons: b.history_records(spark, sf_dir, persons)
    )


def dense(spark: SparkSession, sf_dir: str, **changes) -> Study:
    """Study over the dense short stream."""
    return Study(b.dense_stream(spark, sf_dir), b.STREAM_PARAMS.with_(**changes), b.LAB_PREFIXES)


def params_of(binding: str) -> StudyParams:
    return b.HISTORY_PARAMS if binding == "history" else b.STREAM_PARAMS
