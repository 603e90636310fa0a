"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics of every document are computed once, by arrays of byte counts and word counts, and staged. Trees are
fitted with numpy on at most ``FIT_ROWS`` labelled rows, chosen by hash order: features are cut into quantile
bins, each level of a tree sums gradients per bin and splits where the gain is largest. Trees are complete,
so a model is three arrays (feature, threshold, leaf) and a batch walks all trees level by level without branches.

Defined cases: a null text is an empty one, with all statistics zero, and is scored like any other; repeated rows
are scored each; repeated labels are averaged, null labels left out; without usable labels of both
classes every score is the share of label 1 (or 0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalstrand.session import stage

#: Most labelled rows that a fit reads.
FIT_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "distinct_words", "repeated_neighbours", "top_word", "word_length", "word_spread", "long_word",
    "upper", "digit", "symbol", "wide", "space", "breaks", "distinct_lines", "line_length", "bare_words", "end_marks",
)
_CLASS = np.zeros(256, dtype=np.intp)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (
        1 if _i >= 128 else 2 if "A" <= _c <= "Z" else 3 if "a" <= _c <= "z" else 4 if "0" <= _c <= "9" else 5 if _c in " \t\n\r\x0b\x0c" else 6 if _c in ".,;:!?'\"-()" else 7
    )


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    _, wide, upper, lower, digit, space, mark, symbol = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    sizes = np.fromiter(map(len, words), np.int64, w)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n),
        np.log1p(w),
        len(counts) / w,
        same / w,
        max(counts.values()) / w,
        float(sizes.mean()),
        float(sizes.std()),
        np.log1p(sizes.max()),
        upper / n,
        digit / n,
        symbol / n,
        wide / n,
        space / n,
        (len(lines) - 1) / w,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        (lower + upper + wide) / n,
        mark / w,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and ``f`` (array of statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([statistics(t) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(f.ravel()))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, f array<double>"
    )


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node arrays (tree, node) in heap order, leaves (tree, leaf), and the start value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all trees at once."""
        total = np.full(len(x), self.start)
        if len(self.leaf) and len(x):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), dtype=np.intp)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total = total + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    share = float(y.mean()) if len(y) else 0.5
    clipped = min(max(share, 1e-3), 1 - 1e-3)
    start = float(np.log(clipped / (1 - clipped)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) < 4 or share in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.intp), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
    width = bins + 1
    features, thresholds, values = [], [], []
    total = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.intp), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.intp)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                key = (node - first) * width + binned[:, f]
                left_g = np.bincount(key, g, many * width).reshape(many, width).cumsum(axis=1)
                left_h = np.bincount(key, h, many * width).reshape(many, width).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < 1) | (right_h < 1)] = 0
                gain[:, len(q) :] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(many), at]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[first : first + many][better] = f
                threshold[first : first + many][better] = q[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        total = total + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: crc32 of the id's text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(measured: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on labelled rows that are not held out; the driver receives at most ``max_rows`` rows of statistics."""
    known = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = known.filter(~held_out(F.col("doc_id")))
    rows = measured.join(known, "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_rows).select("f", "y").toArrow()
    x = np.array(rows.column("f").to_pylist(), dtype=np.float64).reshape(rows.num_rows, len(FEATURES))
    return fit_trees(x, (np.array(rows.column("y").to_pylist(), dtype=np.float64) >= 0.5).astype(np.float64))


def score_quality(measured: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of each row of ``measured``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(1)
            for lo in range(0, batch.num_rows, 2048):
                part = f.slice(lo, 2048)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 2048), pa.array(model.score(x))], names=["doc_id", "score"])

    return measured.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")


def judge_quality(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row of ``docs``."""
    measured = stage(measure(docs), "quality_statistics")
    scored = score_quality(measured, fit_quality(measured, labels, max_rows))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
