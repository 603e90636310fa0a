"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a lower-case run of letters are the whole term (``term$``) and its beginnings of 4 to 8 letters
(``begin*``), which stand for a stem whatever its ending. A bounded sample of labelled rows counts each feature in toxic and
other rows. The vocabulary is chosen greedily: the feature whose smoothed log-odds stand out most, then again
with less count for toxic rows that a chosen feature is in, so features that merely accompany a chosen one stay out. Rows
that share a min-hash of their word pairs count as one, so the words of an often copied text don't stand out.
A document's values are the uses of the vocabulary per hundred words of its whole text, so a chance use in a
long text weighs little. ``labels`` knows toxic and not toxic; toxic rows are graded by how densely they use the
vocabulary: grade 1 up to the median of toxic rows, grade 2 above. One weight vector serves both ordered thresholds, P(grade > j) = sigmoid(w.x - b_j), and the result is the
expected grade.

Defined cases: a null or empty text has no features and gets the score of a text without vocabulary terms; repeated
rows are scored each; repeated labels count as toxic if any is, null labels are left out; without labels of both
kinds, or features that tell them apart, nothing is rejected; other columns are carried along or ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.llm.common import WordHashes
from vitalstrand.llm.encoding import release
from vitalstrand.session import stage

#: Most labelled rows that a fit reads, toxic and other rows up to half of them each.
FIT_ROWS = 8_000
#: Most features of the vocabulary, and most that are candidates for it.
VOCABULARY, CANDIDATES = 128, 4_000
#: A feature needs this z-score of its log-odds and this many toxic rows.
MIN_Z, MIN_ROWS = 3.0, 3
#: What remains of a toxic row's count each time a picked feature is in it.
REACHED = 0.5
#: A feature with this share of its toxic rows beside a picked feature is not picked.
BESIDE = 0.9
GRADES = 3
BEGINS = range(4, 9)
#: Most uses per hundred words that count.
DENSEST = 5.0
TERM = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] + "*" for k in BEGINS if len(word) >= k)]


def min_hashes(text: str | None) -> list[int]:
    """Three min-hashes of the pairs of neighbouring words of a text."""
    words = text.split() if text else []
    pairs = {zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(["", *words], [*words, ""], strict=True)}
    return [min((p * m) & 0x7FFFFFFF for p in pairs) for m in (1, 0x9E3779B1, 0x85EBCA77)]


class Places(WordHashes):
    """Places in a vocabulary of the features of a piece between white space, remembered like hashes."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def compute(self, piece: str) -> tuple[int, ...]:
        return tuple(self.vocabulary[f] for w in TERM.findall(piece.lower()) for f in features(w) if f in self.vocabulary)

    def density(self, text: str | None) -> dict[int, float]:
        """Uses per hundred words of each feature that a text has."""
        words = text.split() if text else []
        uses = Counter(i for found in map(self.__getitem__, words) if found for i in found)
        return {i: min(DENSEST, 100 * n / len(words)) for i, n in sorted(uses.items())}


@dataclass(frozen=True)
class Ordinal:
    """Vocabulary, its shared weights and ascending thresholds."""

    vocabulary: tuple[str, ...]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]

    def places(self) -> Places:
        return Places({f: i for i, f in enumerate(self.vocabulary)})

    def score(self, texts: list[str | None], places: Places) -> np.ndarray:
        """P(grade > j) of each text, a column for each threshold."""
        z = np.array([sum(self.weights[i] * n for i, n in places.density(t).items()) for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - np.array(self.cuts)[None, :], -40, 40)))


NOTHING = Ordinal((), (), tuple(np.inf for _ in range(GRADES - 1)))


def log_odds(a: np.ndarray, toxic: int, b: np.ndarray, clean: int) -> np.ndarray:
    """z-score of the smoothed log-odds of being in ``a`` of ``toxic`` rows and ``b`` of ``clean`` rows."""
    odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
    return odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def choose(has: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> list[int]:
    """Columns of ``has`` (row, feature) picked greedily; a toxic row counts less each time a picked feature is in it."""
    clean, b = weight[~y].sum(), weight[~y] @ has[~y]
    rest, left, picked = has[y], weight[y].copy(), []
    total, free = rest.sum(axis=0), np.ones(has.shape[1], dtype=bool)
    while len(picked) < size:
        a = left @ rest
        z = np.where(a >= MIN_ROWS, log_odds(a, left.sum(), b, clean), -np.inf)
        z[~free] = -np.inf
        best = int(z.argmax())
        if z[best] < MIN_Z:
            break
        picked.append(best)
        left[rest[:, best]] *= REACHED
        # Features found almost only beside this one say the same.
        free &= rest[rest[:, best]].sum(axis=0) < BESIDE * np.maximum(total, 1)
        free[best] = False
    return picked


def copy_weights(keys: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One over the rows of a class that share a min-hash of the text: copies of a text count as about one row."""
    weight = np.ones(len(keys))
    for column in keys.T:
        _, group, size = np.unique(column * 2 + y, return_inverse=True, return_counts=True)
        weight = np.minimum(weight, 1 / size[group])
    return weight


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, ridge: float = 2e-4, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient descent with adaptive steps on the cumulative-link likelihood.

    Thresholds are the first one plus positive gaps (exponentials), so they keep their order. Rows of grade 0 weigh as much together as all others.
    """
    n, k = x.shape
    size = np.array([max(1, (grade == g).sum()) for g in range(grades)])
    weight = np.where(grade == 0, 0.5 / size[0], 0.5 / max(1, size[1:].sum()))
    w = np.zeros(k)
    c = np.concatenate([[1.0], np.zeros(grades - 2)])
    m, v = np.zeros(k + grades - 1), np.zeros(k + grades - 1)
    for step in range(1, steps + 1):
        gaps = np.exp(c[1:])
        cuts = c[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ w
        over = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))
        full = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
        p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), over * (1 - over), np.zeros((n, 1))])
        upper, lower = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        gz = -weight * (upper - lower) / p
        gcut = np.array([(weight * (np.where(grade == j + 1, upper, 0) - np.where(grade == j, lower, 0)) / p).sum() for j in range(grades - 1)])
        gc = np.concatenate([[gcut.sum()], np.cumsum(gcut[::-1])[::-1][1:] * gaps])
        grad = np.concatenate([x.T @ gz + ridge * w, gc])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, c = w - move[:k], c - move[k:]
    return w, c[0] + np.concatenate([[0.0], np.cumsum(np.exp(c[1:]))])


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``max_rows`` labelled rows, by hash order; staged."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(23), "doc_id")
    some = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(max_rows // 2) for y in (0, 1)]
    ids = some[0].unionByName(some[1])
    # At most max_rows ids: a bounded side.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids), "doc_id")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [sorted({f for w in set(TERM.findall((t or "").lower())) for f in features(w)}) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "features"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, size: int = VOCABULARY) -> Ordinal:
    """Vocabulary, weights and thresholds; the driver receives bounded numbers of features and rows only."""
    sample = stage(_sample(docs, labels, max_rows), "toxicity_sample")
    toxic_row = (F.col("toxic") > 0).cast("long").alias("toxic")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy(toxic_row).agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return NOTHING
    rows = sample.select("text", toxic_row).mapInArrow(_features, "toxic long, features array<string>")
    rows = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
    rows = rows.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= MIN_ROWS)
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = rows.withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), F.desc(F.length("feature")), "feature")
    best = best.limit(CANDIDATES)
    candidates = [r["feature"] for r in best.collect()]
    if not candidates:
        return NOTHING
    vocabulary = {f: i for i, f in enumerate(candidates)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(vocabulary)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [places.density(t).items() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[n for _, n in f] for f in found], pa.list_(pa.float64())),
                    pa.array([min_hashes(t) for t in texts], pa.list_(pa.int64())),
                ],
                names=["toxic", "at", "n", "keys"],
            )

    got = sample.select("text", toxic_row).mapInArrow(vectors, "toxic long, at array<int>, n array<double>, keys array<long>").toArrow().to_pylist()
    got.sort(key=str)
    y = np.array([r["toxic"] > 0 for r in got])
    has = np.zeros((len(got), len(candidates)), dtype=bool)
    for i, r in enumerate(got):
        has[i, r["at"]] = True
    picked = choose(has, y, copy_weights(np.array([r["keys"] for r in got]), y), size)
    if not picked:
        return NOTHING
    column = {c: k for k, c in enumerate(picked)}
    x, uses = np.zeros((len(got), len(picked))), np.zeros(len(got))
    for i, r in enumerate(got):
        for at, n in zip(r["at"], r["n"], strict=True):
            if at in column:
                x[i, column[at]] = n
                uses[i] += n
    grade = np.where(y, 1 + (uses > np.median(uses[y])), 0).astype(np.intp)
    w, cuts = fit_ordinal(x, grade)
    return Ordinal(tuple(candidates[c] for c in picked), tuple(map(float, w)), tuple(map(float, cuts)))


def grade_toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with p_toxic (P of grade 1 or more) and expected_severity (0 to 2), over whole texts."""
    names = [c for c in docs.columns if c not in ("p_toxic", "expected_severity")]

    @F.pandas_udf("array<double>")
    def above(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        places = model.places()
        for text in batches:
            yield pd.Series(list(model.score(text.tolist(), places)), index=text.index, dtype=object)

    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), above(F.col("text").cast("string")).alias("above"))
    return kept.select(
        *[F.col("row")[c].alias(c) for c in names],
        F.col("above")[0].alias("p_toxic"),
        F.aggregate("above", F.lit(0.0), lambda s, v: s + v).alias("expected_severity"),
    )
