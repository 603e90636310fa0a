import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vitalstrand.config import StudyParams
from vitalstrand.sources import sinks
from vitalstrand.sources.tables import SCHEMAS, conform, load_tables


@pytest.fixture(scope="module")
def windows(spark):
    return spark.range(230).select(
        F.col("id").alias("person_id"),
        F.lit(dt.date(2020, 1, 1)).alias("end_date"),
        F.when(F.col("id") < 200, "train").otherwise("val").alias("split"),
        F.sequence(F.lit(0), (F.col("id") % 7).cast("int")).alias("input_ids"),
        F.array_repeat(F.lit(3), (F.col("id") % 7 + 1).cast("int")).alias("positions"),
        (F.col("id") % 7 + 1).cast("int").alias("n_tokens"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def test_shards_hold_at_most_the_limit(spark, windows, tmp_path):
    path = str(tmp_path / "shards")
    sinks.write_shards(windows, path, 40)
    files = glob.glob(f"{path}/split=*/*.parquet")
    assert all(pq.read_metadata(f).num_rows <= 40 for f in files)
    train = sinks.read_split(spark, path, "train")
    assert train.count() == 200
    sizes = sorted(r["count"] for r in train.groupBy("shard").count().collect())
    assert sizes == [40] * 5
    with pytest.raises(ValueError):
        sinks.read_split(spark, path, "test")


def test_arrays_move_once_into_shards(spark, windows):
    numbered = sinks.number_shards(windows.repartition(3), 40)
    moves = numbered.select("input_ids", "shard")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in moves.splitlines() if "Exchange hashpartitioning" in line]
    # one for the windows by (split, bucket), one for the counts, one for their offsets
    assert len(exchanges) <= 3


def test_binary_roundtrip(windows):
    packed = sinks.to_binary(windows)
    first = packed.where("person_id = 2").first()
    assert bytes(first.input_ids) == b"\0\0\0\0\1\0\0\0\2\0\0\0" and first.end_date == "2020-01-01"
    back = {r.person_id: (r.input_ids, r.positions) for r in sinks.from_binary(packed).collect()}
    assert back == {r.person_id: (r.input_ids, r.positions) for r in windows.collect()}


def test_manifest_fallback(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1)], "split STRING, person_id BIGINT")
    path = str(tmp_path / "splits")
    schema = "split STRING, person_id BIGINT"
    assert sinks.read_manifest(spark, path, schema, rows).collect() == rows.collect()
    with pytest.raises(Exception):
        sinks.read_manifest(spark, path, schema).collect()
    sinks.write_manifest(rows, path)
    assert sinks.read_manifest(spark, path, schema).collect() == rows.collect()


def test_report_and_vocab_documents(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "token STRING, tid INT")
    assert sinks.vocab_document(vocab).first().vocab == {"a": 1, "b": 2}
    assert sinks.as_json(spark.createDataFrame([(1, 0.5)], "n INT, auroc DOUBLE")).first().report == '{"n":1,"auroc":0.5}'


def test_declared_schemas(spark, tmp_path):
    for name in SCHEMAS:
        conform(spark.range(2).withColumnRenamed("id", "person_id"), name).write.parquet(str(tmp_path / name))
    tables = load_tables(spark, str(tmp_path))
    assert tables.measurement.columns == ["person_id", "measurement_date", "measurement_concept_id", "value_as_number"]
    tables.register("t_")
    assert spark.sql("SELECT COUNT(*) FROM t_heart_rate_minute_level").first()[0] == 2
    assert StudyParams().with_(min_age=None).min_age is None
