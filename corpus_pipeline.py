"""Corpus pipeline: reject toxic documents, deduplicate, decontaminate, mix sources, write token ids.

Every stage takes (spark, docs, sf_dir); ``run`` writes each stage's rows as Parquet to the shared folder and
reads them again for the next. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstrand.llm import decontaminate, mixing, near_dedup, token_orc, toxicity
from vitalstrand.llm.common import table
from vitalstrand.llm.queries import MAX_REPEATS, TOXIC, tokenizer
from vitalstrand.session import fresh_path, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is more likely above none than not go; the model is fitted on ``labels``."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model).filter(F.col("p_toxic") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Rows without an id stay."""
    copies = near_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(stage(copies, "near_copies"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources are repeated up to the limit."""
    mixed = mixing.mix(docs, max_repeats=MAX_REPEATS)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC shards; returns doc_id, start, n_tokens, ids_crc32 read back from them."""
    path = fresh_path(spark, "pipeline_tokens")
    token_orc.write_tokens(docs, path, *tokenizer())
    return token_orc.checksums(token_orc.read_tokens(spark, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The classifier, the verification by edit distance and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
