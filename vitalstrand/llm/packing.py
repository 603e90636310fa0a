"""Few fixed-size sequences for all documents: linear grouping, configurations of few sizes, best fit.

Lengths are whole numbers up to the capacity, so a table of any size is described by one count for each length. The
plan is made from these counts: large lengths are dealt to groups of about equal cardinality and rounded up to the
largest of their group, a linear program over the few sizes gives whole configurations, the actual documents take the
places of a configuration in descending order, and what is left, small documents above all, goes to the fullest
sequence that holds it. Every step works on runs of equal sequences, so the plan's size follows the capacity and the
number of groups, not the rows. Documents find their place from the plan by length and by rank among the pieces of their length;
ranks are counted where pieces are written and shifted by the counts of the tasks before, so no length meets in one task.

Defined cases: a null or empty text is the end id alone; a null or repeated ``doc_id`` is a row like any other; a
document of more than ``capacity`` ids is cut into full pieces behind a first one that may be shorter; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.llm.encoding import encoder_of, groups
from vitalstrand.session import stage

CAPACITY = 2048
END_ID = 0
#: Groups of large lengths: the sizes that the linear program sees.
GROUPS = 64
#: Lengths of at most this share of the capacity are small.
SMALL = 1 / 8
#: The linear program stops when its lower bound is this near.
GAP = 2e-4

PIECES = "task int, doc_id long, piece int, start long, length int, place long, ids array<int>"
_PIECES = pa.schema(
    [
        ("task", pa.int32()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("place", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in groups(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                ids, counts = encoder.of(texts.slice(lo, hi - lo).to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts += 1
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = counts - (pieces - 1) * capacity
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=capacity + 1)
                place = np.empty(len(doc), dtype=np.int64)
                place[order] = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
                seen += sizes
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns = [
                    pa.array(np.full(len(doc), task, dtype=np.int32)),
                    batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int32)),
                    pa.array(place),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    return run


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Written pieces of at most ``capacity`` ids of every row of ``docs`` (doc_id, text), in no order.

    ``place`` numbers the pieces of one length within one ``task`` from 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(_cut(tokenizer, capacity, end_id), PIECES), "pieces")


@dataclass
class Plan:
    """Runs of pieces: of ``length`` from rank ``lo`` on, ``per`` to a sequence from ``sequence`` on, the first at ``offset``."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def arrays(self) -> np.ndarray:
        """Runs as columns length, lo, sequence, per, offset, ordered by length and rank."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return np.ascontiguousarray(runs.T)


class _Open:
    """Runs of sequences by the room they have left."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.rooms: list[list[tuple[int, int]]] = [[] for _ in range(plan.capacity + 1)]
        self.filled = np.zeros(plan.capacity + 1, dtype=bool)

    def add(self, room: int, sequence: int, count: int) -> None:
        if count and room:
            self.rooms[room].append((sequence, count))
            self.filled[room] = True

    def new(self, count: int) -> None:
        self.add(self.plan.capacity, self.plan.sequences, count)
        self.plan.sequences += count

    def best_fit(self, length: int, lo: int, count: int) -> None:
        """Each piece of the run goes to the sequence with the least room that holds it.

        That sequence then has the least room still, so it takes pieces until the next doesn't fit.
        """
        capacity = self.plan.capacity
        while count:
            fits = self.filled[length:]
            at = int(np.argmax(fits))
            if not fits[at]:
                self.new(-(-count // (capacity // length)))
                continue
            room = length + at
            sequence, many = self.rooms[room].pop()
            self.filled[room] = bool(self.rooms[room])
            per = room // length
            whole = min(many, count // per)
            rest = count - whole * per if whole < many else 0
            rest = min(rest, per)
            used = whole * per + rest
            if used:
                self.plan.runs.append((length, lo, sequence, per, capacity - room))
            self.add(room - per * length, sequence, whole)
            if rest:
                self.add(room - rest * length, sequence + whole, 1)
            self.add(room, sequence + whole + (1 if rest else 0), many - whole - (1 if rest else 0))
            lo += used
            count -= used


def linear_groups(counts: np.ndarray, least: int, k: int) -> list[list[int]]:
    """Lengths from ``least`` below the capacity with pieces, descending, in at most ``k`` groups of about equal cardinality."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1] if least <= x < len(counts) - 1]
    share = sum(int(counts[x]) for x in lengths) / k
    out, held, past = [], 0, 0.0
    for x in lengths:
        if not out or held >= past:
            out.append([])
            past = held + share
        out[-1].append(x)
        held += int(counts[x])
    return out


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of ``sizes`` within ``capacity``: a knapsack over groups."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), dtype=np.int16)
    for g, (size, value) in enumerate(zip(sizes, worth.tolist(), strict=True)):
        if value <= 0:
            continue
        before = best
        best = before.copy()
        for t in range(1, capacity // size + 1):
            offer = before[: capacity + 1 - t * size] + t * value
            better = offer > best[t * size :] + 1e-12
            best[t * size :][better] = offer[better]
            taken[g, t * size :][better] = t
    out, room = np.zeros(len(sizes)), int(np.argmax(best))
    value = float(best[room])
    for g in range(len(sizes) - 1, -1, -1):
        out[g] = taken[g, room]
        room -= int(taken[g, room]) * sizes[g]
    return value, out


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a basis of the configuration program and how often each is used, by column generation."""
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * len(sizes)):
        used = np.linalg.solve(basis, demand)
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_configuration(sizes, worth, capacity)
        total = used.sum()
        if value <= 1 + 1e-9 or total - total / value < max(gap * total, 0.5):
            break
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(used, 0) / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    return basis, np.linalg.solve(basis, demand)


def plan_of(counts: np.ndarray, k: int = GROUPS, small: float = SMALL) -> Plan:
    """Plan for ``counts`` pieces of each length 0..capacity."""
    capacity = len(counts) - 1
    plan = Plan(capacity)
    opened = _Open(plan)
    if counts[capacity]:
        opened.new(int(counts[capacity]))
        opened.best_fit(capacity, 0, int(counts[capacity]))
    grouped = linear_groups(counts, int(capacity * small) + 1, k)
    queues = [deque([x, 0, int(counts[x])] for x in g) for g in grouped]
    if grouped:
        sizes = [g[0] for g in grouped]
        demand = np.array([float(sum(int(counts[x]) for x in g)) for g in grouped])
        basis, used = configurations(sizes, demand, capacity)
        times = np.floor(np.maximum(used, 0) + 1e-6).astype(np.int64)
        left = demand.astype(np.int64)
        # The fullest configurations are filled first; none takes more than there is.
        for j in np.argsort(-(np.array(sizes) @ basis), kind="stable").tolist():
            column = np.rint(basis[:, j]).astype(np.int64)
            needed = column > 0
            m = int(min(times[j], (left[needed] // column[needed]).min()))
            left -= m * column
            slots = [g for g in np.flatnonzero(column).tolist() for _ in range(column[g])]
            # Half of the places stay open: rounding left room, and best fit finds the documents that use it.
            _fill(plan, opened, queues, slots[: max(1, len(slots) // 2)], m)
    rest = [tuple(run) for queue in queues for run in queue]
    rest += [(x, 0, int(counts[x])) for x in range(int(capacity * small), 0, -1) if counts[x]]
    for length, lo, count in sorted(rest, reverse=True):
        opened.best_fit(length, lo, count)
    return plan


def _fill(plan: Plan, opened: _Open, queues: list[deque], slots: list[int], m: int) -> None:
    """``m`` sequences of one configuration take actual documents of its groups, the longest first."""
    taken = []
    for g in slots:
        need, part = m, []
        while need:
            length, lo, count = queues[g][0]
            n = min(count, need)
            part.append((length, lo, n))
            need -= n
            if n == count:
                queues[g].popleft()
            else:
                queues[g][0][1:] = [lo + n, count - n]
        taken.append(deque(part))
    while m:
        n = min(part[0][2] for part in taken)
        at = 0
        for part in taken:
            length, lo, count = part.popleft()
            plan.runs.append((length, lo, plan.sequences, 1, at))
            at += length
            if count > n:
                part.appendleft((length, lo + n, count - n))
        opened.add(plan.capacity - at, plan.sequences, n)
        plan.sequences += n
        m -= n


def length_counts(pieces: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """Pieces of each length; at most ``capacity`` numbers reach the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return counts


def lay_out(pieces: DataFrame, written: DataFrame, plan: Plan) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which come from ``written`` with any columns added or left out."""
    sizes = written.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row for each task that wrote the length, whatever its pieces.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("base")
    shared = written.sparkSession.sparkContext.broadcast(plan.arrays())
    kept = [f for f in ranked.schema.fields if f.name != "rank"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, sequence, per, offset = shared.value
        keys = (length << 44) | lo
        for batch in batches:
            own = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            run = np.searchsorted(keys, (own << 44) | rank, side="right") - 1
            nth, slot = np.divmod(rank - lo[run], per[run])
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(sequence[run] + nth), pa.array(offset[run] + slot * own)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(find, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids, ``sequence_id`` and ``offset``."""
    written = cut_documents(docs, tokenizer, capacity, end_id)
    return lay_out(written, written, plan_of(length_counts(written, capacity)))


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its ids in order and where its documents end; bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ends = F.transform("parts", lambda p: (p["offset"] + F.size(p["ids"])).cast("int"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), ends.alias("ends"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        ends = (ids.offsets.to_numpy() * 4).tolist()
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64, len(ends) - 1)
        rest = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(crc)], names=[*rest, "ids_crc32"])


def with_checksums(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by their checksum ``ids_crc32``."""
    return pieces.mapInArrow(_crc, pieces.drop("ids").schema.add("ids_crc32", "long"))


def packed_checksums(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; checksums are taken of the written ids, which are not shuffled."""
    written = cut_documents(docs, tokenizer, capacity)
    laid = lay_out(with_checksums(written), written.drop("ids"), plan_of(length_counts(written, capacity)))
    return laid.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
