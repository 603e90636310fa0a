"""Cohort files, window shards, manifests and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstrand.operators.ranks import hash_digits, hash_ranked


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


# --- window shards ---------------------------------------------------------------------------------


def number_shards(windows: DataFrame, rows: int, seed="shards", key: Sequence[str] = ("person_id", "end_date")) -> DataFrame:
    """Add ``shard``: consecutive blocks of ``rows`` windows per split, in hash order.

    The hash order is cut by the row count, so a bucket holds many shards. Buckets are counted first, on the keys alone;
    then the arrays move once, to their bucket, where they are numbered. Pass a staged table, as it is read twice.
    """
    ranked = hash_ranked(windows, list(key), seed, ["split"], hash_digits(windows.count()))
    return ranked.withColumn("shard", F.floor(F.col("ordinal") / rows).cast("int")).drop("ordinal", "group_size")


def write_shards(windows: DataFrame, path: str, rows: int = 5000) -> None:
    """Parquet shards of at most ``rows`` windows, in one folder per split.

    Windows are written where they were numbered, by (split, bucket), so a split that holds most rows does not meet one writer.
    """
    (
        number_shards(windows, rows)
        .sortWithinPartitions("split", "shard")
        .write.mode("overwrite")
        .partitionBy("split")
        .option("maxRecordsPerFile", rows)
        .parquet(path)
    )


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The shards of one split by partition pruning; an absent split is an error."""
    found = spark.read.parquet(path).where(F.col("split") == split)
    if found.isEmpty():
        raise ValueError(f"no shards found for split={split} in {path}")
    return found


BINARY_SCHEMA = (
    "person_id BIGINT, end_date STRING, input_ids BINARY, positions BINARY, n_tokens INT, label INT, split STRING"
)
ARRAY_SCHEMA = (
    "person_id BIGINT, end_date STRING, input_ids ARRAY<INT>, positions ARRAY<INT>, n_tokens INT, label INT, split STRING"
)
_ARRAY_FIELDS = ("input_ids", "positions")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {}
        for name in batch.schema.names:
            col = batch.column(name)
            if name in _ARRAY_FIELDS:
                flat = col.flatten().to_numpy(zero_copy_only=False).astype("<i4")
                edges = np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))))
                raw = flat.tobytes()
                col = pa.array([raw[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            cols[name] = col
        yield pa.RecordBatch.from_pydict(cols)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {}
        for name in batch.schema.names:
            col = batch.column(name)
            if name in _ARRAY_FIELDS:
                values = col.to_pylist()
                flat = np.frombuffer(b"".join(values), dtype="<i4")
                edges = np.concatenate(([0], np.cumsum([len(v) // 4 for v in values]))).astype("int32")
                col = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))
            cols[name] = col
        yield pa.RecordBatch.from_pydict(cols)


def to_binary(windows: DataFrame) -> DataFrame:
    """Token arrays as little-endian int32 bytes, for readers of the binary shard format."""
    cols = [c.split(" ")[0] for c in BINARY_SCHEMA.split(", ")]
    ready = windows.withColumn("end_date", F.col("end_date").cast("string")).select(*cols)
    return ready.mapInArrow(_pack, BINARY_SCHEMA)


def from_binary(shards: DataFrame) -> DataFrame:
    return shards.mapInArrow(_unpack, ARRAY_SCHEMA)


# --- manifests and reports -------------------------------------------------------------------------


def write_manifest(df: DataFrame, path: str) -> None:
    """A long table as JSON lines, such as splits or endpoint ids."""
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None) -> DataFrame:
    """Read a manifest back; a missing one gives ``fallback`` when there is one."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        if fallback is None:
            raise
        return fallback


def vocab_document(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one token -> id map; its size is bounded by the id space."""
    entries = F.sort_array(F.collect_list(F.struct("token", "tid")))
    return vocab.agg(F.map_from_entries(entries).alias("vocab"))


def as_json(report: DataFrame, column: str = "report") -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias(column))


def write_report(report: DataFrame, path: str) -> None:
    """Aggregate-only report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
