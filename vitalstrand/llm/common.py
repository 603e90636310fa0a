"""Helpers shared by the corpus operators: staged tables, word hashing and connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalstrand.session import stage

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Distinct words of one generation of a worker's memo; bounds its memory, not the result.
WORD_MEMO = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hash of a word, remembered for two generations of words, so frequent words stay known."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def compute(self, word) -> int:
        return xxhash.xxh64_intdigest(word)

    def __missing__(self, word) -> int:
        if len(self) >= WORD_MEMO:
            self.before = {}  # no third generation while this one is copied
            self.before = dict(self)
            self.clear()
        value = self.before.get(word)
        if value is None:
            value = self.compute(word)
        self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` words; a shorter, non-empty text is one run."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i]
        return np.unique(mix(h))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Smallest reachable node of every node in ``edges`` (u, v), as (node, component).

    Alternates two star contractions: each node's larger neighbours move to its smallest neighbour, then each
    node and its smaller neighbours do. Every round is a combining minimum and an equi-join, so the hub of a
    large component costs one row per edge and no task sees a whole component. Each round is written, which
    cuts the lineage; rounds grow with the logarithm of the longest chain.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = stage(edges, label)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stage(small, label)
        same = after.exceptAll(edges).limit(1).count() == 0 and edges.exceptAll(after).limit(1).count() == 0
        edges = after
        if same:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
