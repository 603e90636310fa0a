"""Token ids of documents in ORC shards.

Documents are dealt to ranges of ``doc_id``, tokenised where they land and written in ascending order. ORC keeps
the ids as run-length encoded integer lists; stripes are the unit of parallel reads, and the row index and Bloom
filter on ``doc_id`` let a lookup skip stripes and row groups. A row carries its shard and its offset inside the
shard; the offset of a shard is the running sum of the shards before it, one number for each shard.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first; repeated ids are ordered
by their text; an empty table gives an empty folder that reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vitalstrand.llm.encoding import encoder_of, groups

END_ID = 0
FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
}


def tokenise(path: str, end_id: int = END_ID):
    """Batches of (doc_id, text) to the file's rows, in the order they come."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, shard = encoder_of(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in groups(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                ids, n = encoder.of(texts.slice(lo, hi - lo).to_pylist())
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.full(hi - lo, shard, dtype=np.int32)),
                    pa.array(at + offsets[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ]
                at += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path`` in ascending ``doc_id`` order.

    ``tokenizer`` is the vocabulary file. One shuffle, by range of ``doc_id``; a worker keeps a group of texts and the piece memo.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(tokenise(tokenizer, end_id), FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``, the ids of all documents before."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    # One row for each shard: as many as there were write tasks, whatever the rows.
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the Bloom filters and row indexes skip stripes without them."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        ends = ids.offsets.to_numpy() * 4
        crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows from ``read_tokens``."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _crc, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
