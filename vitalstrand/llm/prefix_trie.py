"""Trie of conversation prefixes, summed over subtrees by an Euler tour.

Each distinct sequence of a conversation's first turns is a node. Prefixes are told apart by two running 64-bit sums
(exclusive or) of hashes of a turn's SHA-256 and place, so a node is one combining aggregate. Every node gets an enter
and an exit arc; the tour's successor of an arc follows from first children and next siblings alone. The tour is
ranked by contraction: in each round an arc whose coin is heads and whose predecessor's is tails leaves the list, the
list shrinks by a quarter, and the arcs that left take their ranks back from their predecessors in reverse order. With
positions known, leaves and savings of a subtree are differences of prefix sums at its two arcs.

No step gathers a conversation, a node's members, its children or the tour: turns are numbered in range partitions,
children are linked in buckets, sums run in blocks, and only one row for each partition, bucket or block is
accumulated. The list of the conversations that end at a node is hashed from sorted chunks in a stream.

Defined cases: turns are ordered by turn (null first), then by the SHA-256 of ``length(role):role text``; a null role or
text is empty; repeated rows are turns of their own; rows without ``conv_id`` belong to no conversation and are left
out; an empty table has no conversations and so no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalstrand.operators.joins import split_join
from vitalstrand.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Arcs summed in one block.
BLOCK = 100_000
#: Arcs that one task ranks; longer lists are contracted first.
SHORT_LIST = 1 << 15
#: Conversations in one chunk of a node's list.
CHUNK = 4096
KEY = ["depth", "k1", "k2"]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row among its conversation's rows of this partition, which come in order."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        if last is not None and conv[0] == last:
            place[: starts[1] if len(starts) > 1 else n] += held
        last, held = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(place), *batch.columns[1:]],
            names=["conv_id", "part", "place", "mark", "words"],
        )


def number_turns(turns: DataFrame) -> DataFrame:
    """Written turns as (conv_id, part, place, mark, words): ``place`` counts a conversation's turns within ``part``.

    The parts of a conversation follow one another, so one of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("mark"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "mark", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "mark", "words")
    return stage(ranged.mapInArrow(_number, "conv_id long, part int, place long, mark binary, words long"), "turns")


def _before(column: Column | str, by: str, order: str) -> Column:
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(column.over(window), F.lit(0))


def continue_from_base(numbered: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h turns of conversation c - c % every and go on with their own.

    ``h`` is crc32(c) % (most + 1). Returns the parts (conv_id, part, first, n, h, given, total), one row for each part of a
    conversation, and the turns (conv_id, part, pos, mark, words); turns of the base are part -1.
    """
    parts = stage(numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("turns"))
    convs = stage(
        convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).withColumn(
            "base", F.col("conv_id") - F.col("conv_id") % every
        ),
        "conversations",
    )
    bases = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    given = F.least("h", F.coalesce("base_turns", F.lit(0)))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("total")
    )
    placed = parts.withColumn("first", _before(F.sum("n"), "conv_id", "part")).join(convs, "conv_id")
    placed = stage(placed, "placed")
    own = numbered.join(placed.select("conv_id", "part", "first", "h", "given"), ["conv_id", "part"]).withColumn("ordinal", F.col("first") + F.col("place"))
    kept = own.where("ordinal >= h").select("conv_id", "part", (F.col("given") + F.col("ordinal") - F.col("h")).alias("pos"), "mark", "words")
    heads = own.where(F.col("ordinal") < most).select(F.col("conv_id").alias("base"), F.col("ordinal").alias("pos"), "mark", "words")
    wanted = placed.where("first = 0").select("conv_id", "base", "given")
    taken = wanted.join(heads, "base").where("pos < given").select("conv_id", F.lit(-1).alias("part"), "pos", "mark", "words")
    return placed.where("first = 0").select("conv_id", "total"), kept.unionByName(taken)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Written prefixes (conv_id, depth, k1, k2, p1, p2, words, ends): keys of the prefix and of the one before it.

    ``convs`` are all members with their number of turns ``total``; ``turns`` are (conv_id, part, pos, mark, words) with the
    parts of a conversation in order.
    """
    e1, e2 = (F.xxhash64(F.lit(lane), "mark", "pos") for lane in (1, 2))
    window = Window.partitionBy("conv_id", "part").orderBy("pos")
    local = turns.withColumn("e1", e1).withColumn("e2", e2)
    local = local.select(
        "conv_id", "part", "pos", "words", "e1", "e2", F.bit_xor("e1").over(window).alias("l1"), F.bit_xor("e2").over(window).alias("l2")
    )
    local = stage(local, "local")
    sums = local.groupBy("conv_id", "part").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    carried = sums.select("conv_id", "part", _before(F.bit_xor("s1"), "conv_id", "part").alias("c1"), _before(F.bit_xor("s2"), "conv_id", "part").alias("c2"))
    carried = carried.join(convs, "conv_id")
    k1, k2 = F.col("l1").bitwiseXOR(F.col("c1")), F.col("l2").bitwiseXOR(F.col("c2"))
    depth = (F.col("pos") + 1).cast("long")
    below = local.join(carried, ["conv_id", "part"]).select(
        "conv_id",
        depth.alias("depth"),
        k1.alias("k1"),
        k2.alias("k2"),
        k1.bitwiseXOR(F.col("e1")).alias("p1"),
        k2.bitwiseXOR(F.col("e2")).alias("p2"),
        "words",
        (depth == F.col("total")).alias("ends"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"), (F.col("total") == 0).alias("ends")
    )
    return stage(below.unionByName(roots), "prefixes")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) to comma-joined chunks of one node's conversations."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i).to_numpy() for i in range(3)]
        change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(np.concatenate([[True], change]))
        sizes = np.diff(np.append(starts, n))
        pieces = -(-sizes // CHUNK)
        within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lows = np.repeat(starts, pieces) + within * CHUNK
        highs = np.minimum(lows + CHUNK, np.repeat(starts + sizes, pieces))
        text = batch.column(3).cast(pa.string()).to_pylist()
        joined = [",".join(text[a:b]) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)]
        at = pa.array(lows)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(joined)], names=[*KEY, "first", "chunk"])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one hash for each node, across batches."""
    key, digest = None, None
    names = [*KEY, "ends_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        done = []
        for *own, chunk in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            digest.update(chunk.encode())
        if done:
            yield made(done)
    if digest is not None:
        yield made([(*key, digest.hexdigest())])


def end_hashes(prefixed: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of the conversations that end at a node, for nodes with any."""
    ends = prefixed.where("ends").select(*KEY, "conv_id")
    order = [*KEY, "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, chunk string")
    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(_hash_chunks, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes_of(prefixed: DataFrame) -> DataFrame:
    """Written nodes (nid, depth, k1, k2, conv_id, n_convs, words, parent, parent_conv_id); the root has no parent."""
    nodes = prefixed.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = stage(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes").withColumn("above", F.col("depth") - 1)
    parents = nodes.select(
        F.col("depth").alias("above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    linked = split_join(nodes, parents, ["above", "p1", "p2"], "left", by="p1")
    return stage(linked.drop("above", "p1", "p2"), "linked")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (arc, next, gap) of the Euler tour, and the children (nid, first_child, n_children) of nodes that have any.

    The enter arc of a node is twice its id, the exit arc one more; the root's exit has no successor. Siblings are ordered by bucket and conv_id.
    """
    # As many buckets as a bucket of the largest family has children: neither level holds more than the root of the nodes.
    buckets = 1 + math.isqrt(nodes.count())
    below = nodes.where("parent IS NOT NULL").select("nid", "conv_id", "parent", F.pmod(F.xxhash64("nid"), F.lit(buckets)).alias("bucket"))
    heads = below.groupBy("parent", "bucket").agg(F.min_by("nid", "conv_id").alias("head"), F.count(F.lit(1)).alias("n"))
    # One row for each bucket of a parent, whatever its children.
    follow = heads.withColumn("follow", F.lead("head").over(Window.partitionBy("parent").orderBy("bucket")))
    children = stage(heads.groupBy(F.col("parent").alias("nid")).agg(F.min_by("head", "bucket").alias("first_child"), F.sum("n").alias("n_children")), "children")
    within = F.lead("nid").over(Window.partitionBy("parent", "bucket").orderBy("conv_id"))
    siblings = below.withColumn("sibling", within).join(follow.select("parent", "bucket", "follow"), ["parent", "bucket"])
    siblings = siblings.select("nid", "parent", F.coalesce("sibling", "follow").alias("sibling"))
    enter = nodes.select("nid").join(children, "nid", "left").select(
        (F.col("nid") * 2).alias("arc"), F.when(F.col("first_child").isNotNull(), F.col("first_child") * 2).otherwise(F.col("nid") * 2 + 1).alias("next")
    )
    leave = siblings.select((F.col("nid") * 2 + 1).alias("arc"), F.when(F.col("sibling").isNotNull(), F.col("sibling") * 2).otherwise(F.col("parent") * 2 + 1).alias("next"))
    end = nodes.where("parent IS NULL").select((F.col("nid") * 2 + 1).alias("arc"), F.lit(None).cast("long").alias("next"))
    arcs = enter.unionByName(leave).unionByName(end).withColumn("gap", F.lit(1).cast("long"))
    return stage(arcs, "arcs"), children


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a list that is short enough for one task."""
    table = pa.Table.from_batches(list(batches), pa.schema([("arc", pa.int64()), ("next", pa.int64()), ("gap", pa.int64())]))
    if not table.num_rows:
        return
    arcs, following, gaps = (table.column(i).to_pylist() for i in range(3))
    step = dict(zip(arcs, zip(following, gaps, strict=True), strict=True))
    (at,) = set(arcs).difference(following)
    ranks, rank = {}, 0
    while at is not None:
        ranks[at] = rank
        at, gap = step[at]
        rank += gap
    yield pa.RecordBatch.from_arrays([pa.array(list(ranks)), pa.array(list(ranks.values()))], names=["arc", "pos"])


def rank_list(arcs: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """Positions (arc, pos) from 0 along the list that ``next`` makes of ``arcs`` (arc, next, gap), which is one list."""
    rounds, left = [], arcs
    while left.count() > short:

        def coin(c: str, salt: int = len(rounds)) -> Column:
            return F.xxhash64(F.col(c), F.lit(salt)).bitwiseAND(F.lit(1)) == 1

        pairs = left.where(~coin("arc") & F.col("next").isNotNull() & coin("next"))
        pairs = pairs.select(F.col("arc").alias("before"), F.col("gap").alias("before_gap"), F.col("next").alias("arc"))
        heads = left.where(coin("arc")).join(pairs, "arc", "left")
        none = F.lit(None).cast("long")
        still = left.where(~coin("arc") & ~(F.col("next").isNotNull() & F.coalesce(coin("next"), F.lit(False))))
        still = still.select("arc", "next", "gap", none.alias("before"), none.alias("before_gap"))
        # A row whose arc leaves stands for its predecessor from now on.
        after = stage(heads.select("arc", "next", "gap", "before", "before_gap").unionByName(still), "round")
        rounds.append(after.where("before IS NOT NULL").select("arc", "before", "before_gap"))
        left = after.select(
            F.coalesce("before", "arc").alias("arc"), "next", (F.col("gap") + F.coalesce("before_gap", F.lit(0))).alias("gap")
        )
    ranks = stage(left.repartition(1).mapInArrow(_walk, "arc long, pos long"), "ranks")
    for removed in reversed(rounds):
        back = removed.join(ranks.select(F.col("arc").alias("before"), "pos"), "before").select("arc", (F.col("pos") + F.col("before_gap")).alias("pos"))
        ranks = stage(ranks.unionByName(back), "ranks")
    return ranks


def subtree_sums(ranks: DataFrame, values: DataFrame, sums: list[str]) -> DataFrame:
    """Sums of ``values`` (nid and the columns ``sums``) over subtrees, from prefix sums at the positions of the arcs."""
    enter = F.col("arc") % 2 == 0
    arcs = ranks.select("pos", F.shiftright("arc", 1).alias("nid"), enter.alias("enter"), F.floor(F.col("pos") / BLOCK).alias("block")).join(values, "nid")
    arcs = arcs.select("pos", "block", "nid", "enter", *[F.when(F.col("enter"), F.col(c)).otherwise(0).alias(c) for c in sums])
    arcs = stage(arcs, "positions")
    totals = arcs.groupBy("block").agg(*[F.sum(c).alias(c) for c in sums])
    # One row for each block of positions.
    all_before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("block", *[F.coalesce(F.sum(c).over(all_before), F.lit(0)).alias(f"{c}_base") for c in sums])
    within = Window.partitionBy("block").orderBy("pos")
    running = arcs.select("block", "nid", "enter", *sums, *[F.sum(c).over(within).alias(f"{c}_run") for c in sums]).join(bases, "block")
    until = {c: F.col(f"{c}_base") + F.col(f"{c}_run") for c in sums}
    # The exit's sum less what was before the enter arc.
    return running.groupBy("nid").agg(*[F.sum(F.when(F.col("enter"), F.col(c) - until[c]).otherwise(until[c])).alias(c) for c in sums])


def prefix_trie(convs: DataFrame, turns: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """One row for each node of the trie of ``convs`` (conv_id, total) with ``turns`` (conv_id, part, pos, mark, words).

    Columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words), ends_sha256.
    """
    prefixed = prefixes(convs, turns)
    nodes = nodes_of(prefixed)
    arcs, children = tour(nodes)
    values = nodes.join(children.select("nid", "n_children"), "nid", "left").select(
        "nid",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    sums = subtree_sums(rank_list(arcs, short), values, ["n_leaves", "saved_tokens"])
    rows = nodes.join(children.select("nid", "n_children"), "nid", "left").join(sums, "nid").join(end_hashes(prefixed), KEY, "left")
    nothing = hashlib.sha256().hexdigest()
    return rows.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
