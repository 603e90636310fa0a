"""Code tokens: concept lookups, training-only counts and id allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalstrand.config import ID_RANGES, SPECIAL_TOKENS, UNK
from vitalstrand.functions.scalars import token_text
from vitalstrand.operators.cohort import prefix_filter
from vitalstrand.operators.joins import hot_keys, salted_join

VOCAB_SCHEMA = "token STRING, tid INT, stream STRING, n BIGINT"


def dx_concepts(concept: DataFrame) -> DataFrame:
    return _coded(concept, "ICD10CM").withColumn("token", token_text("DX10", "concept_code", 3))


def px_concepts(concept: DataFrame) -> DataFrame:
    return _coded(concept, "ICD10PCS").withColumn("token", token_text("PX10", "concept_code", 3))


def lab_concepts(concept: DataFrame, prefixes) -> DataFrame:
    return prefix_filter(_coded(concept, "LOINC"), "concept_code", prefixes).withColumn(
        "token", token_text("LAB", "concept_code")
    )


def atc_classes(concept: DataFrame) -> DataFrame:
    """Drug classes: ATC codes of four characters."""
    return _coded(concept, "ATC").where(F.length("concept_code") == 4)


def med_concepts(concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Drug concept -> class, two hops; one drug may belong to several classes."""
    classes = atc_classes(concept).select(F.col("concept_id").alias("ancestor_concept_id"), "concept_code")
    return ancestor.join(classes, "ancestor_concept_id").select(
        F.col("descendant_concept_id").alias("concept_id"),
        "concept_code",
        token_text("MED", "concept_code").alias("token"),
    )


def _coded(concept: DataFrame, vocabulary: str) -> DataFrame:
    return concept.where((F.col("vocabulary_id") == vocabulary) & F.col("concept_code").isNotNull()).select(
        "concept_id", "concept_code"
    )


def with_codes(facts: DataFrame, key: str, concepts: DataFrame) -> DataFrame:
    """Attach code and token to each record of a coded table; a concept on a large share of the records is spread over tasks."""
    keyed = facts.withColumnRenamed(key, "concept_id")
    rest = [c for c in keyed.columns if c != "concept_id"]
    return salted_join(keyed, concepts, ["concept_id"], hot_keys(keyed, "concept_id"), rest)


def coded_records(sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Union of coded tables, given as (stream, records, concept column): (person_id, stream, concept_id)."""
    return reduce(
        DataFrame.unionByName,
        [df.select("person_id", F.lit(stream).alias("stream"), F.col(key).alias("concept_id")) for stream, df, key in sources],
    )


def streams_of(concepts: dict[str, DataFrame]) -> DataFrame:
    """One lookup (stream, concept_id, token) from a lookup per stream."""
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(stream).alias("stream"), "concept_id", "token") for stream, df in concepts.items()],
    )


def count_tokens(records: DataFrame, concepts: DataFrame) -> DataFrame:
    """(stream, token, n). Records are counted per concept before the lookup, so a concept that holds a
    third of all records is one row when it is joined."""
    per_concept = records.groupBy("stream", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    return per_concept.join(concepts, ["stream", "concept_id"]).groupBy("stream", "token").agg(F.sum("n").alias("n"))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens per stream, ties by token text."""
    order = Window.partitionBy("stream").orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def special_rows(spark: SparkSession) -> DataFrame:
    rows = [(token, tid, "SPECIAL", None) for token, tid in SPECIAL_TOKENS.items()]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def _range_bound(which: int):
    chain = None
    for stream, bounds in ID_RANGES.items():
        hit = F.col("stream") == stream
        chain = F.when(hit, bounds[which]) if chain is None else chain.when(hit, bounds[which])
    return chain


def build_vocab(counts: DataFrame) -> DataFrame:
    """Allocate ids by frequency inside each stream's reserved range; what does not fit is dropped."""
    order = Window.partitionBy("stream").orderBy(F.desc("n"), "token")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    lo, hi = _range_bound(0), _range_bound(1)
    kept = ranked.where(F.col("rank") <= hi - lo + 1).select(
        "token", (lo + F.col("rank") - 1).cast("int").alias("tid"), "stream", "n"
    )
    return special_rows(counts.sparkSession).unionByName(kept)


def vocab_stats(counts: DataFrame) -> DataFrame:
    """Per stream: distinct tokens, tokens kept, and the highest id in use plus one."""
    lo, hi = _range_bound(0), _range_bound(1)
    per = counts.groupBy("stream").agg(F.count(F.lit(1)).alias("n_unique"))
    kept = F.least(F.col("n_unique"), (hi - lo + 1).cast("long"))
    return per.select("stream", "n_unique", kept.alias("n_kept"), (lo + kept).cast("long").alias("id_space"))


def vocab_totals(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: distinct tokens counted, those that got an id, those dropped for want of room, and the highest id plus one."""
    counted = counts.select(F.lit(1).alias("counted"), F.lit(None).cast("int").alias("tid"), F.lit(0).alias("kept"))
    held = vocab.select(F.lit(0).alias("counted"), "tid", F.col("n").isNotNull().cast("int").alias("kept"))
    sums = counted.unionByName(held).agg(F.sum("counted").alias("n_unique"), F.sum("kept").alias("n_kept"), F.max("tid").alias("top"))
    return sums.select("n_unique", "n_kept", (F.col("n_unique") - F.col("n_kept")).alias("n_dropped"), (F.col("top") + 1).cast("long").alias("id_space"))


def with_ids(concepts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(concept_id, tid): the lookup a record joins once; a token outside the vocabulary is unknown."""
    ids = concepts.join(vocab.select("token", "tid"), "token", "left")
    return ids.select(*concepts.columns, F.coalesce("tid", F.lit(UNK)).cast("int").alias("tid"))
