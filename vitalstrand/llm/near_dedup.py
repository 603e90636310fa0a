"""Near-duplicates by HyperMinHash sketches, banding and verification on full shingle sets.

A text's set is its distinct runs of five lower-cased words. Texts with equal sets are one class, which one
combining aggregate finds. A class is sketched with one hash per shingle: the hash range is cut into
``REGISTERS`` buckets, and a bucket keeps, of its smallest hash, the number of leading zeros and the
next ``MANTISSA`` bits. Empty buckets borrow from others by a fixed hash sequence. Runs of ``ROWS`` registers are
bands; classes that share a band are candidates. The sketch estimate of a candidate's similarity, corrected for
registers that agree by chance, discards hopeless pairs with a margin of six deviations; the rest are decided by
integer arithmetic on the full sets.

Sketches of short sets are coarse, so sets below ``SHORT`` shingles are found exactly: two sets with
similarity t share one of the first n - ceil(t n) + 1 shingles in a common order (prefix filter).

Only links decide a group, so candidates are taken in two passes. First every member of a band meets the band's
smallest class: a row per member, however large the band. Components of those links follow. Members of one band that are
still in different components are then judged one by one: shingles that no other of them has bound the
similarity a member can reach with any, and those that can't reach the threshold drop out. The others meet the member
that shares most of its set. Those of them that are apart even then are seen from a common centre: two sets differ by
the sizes of their differences from the centre less twice what the differences share, and shingles that only one of the
differences has are not shared. Edits of one text, each made in its own way, drop out by that, and only the others meet
each other. So neither a group of copies nor one of texts around a common passage becomes all its pairs, and no pair
that could join two components is left out.

Defined cases: null, empty and white texts have no shingles, are linked with nothing and are kept; fewer than
five words are one run; a repeated ``doc_id`` is taken once, with its smallest text; null ids are left
out of the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.llm.common import WordHashes, components, lower_words, shingle_set
from vitalstrand.llm.encoding import release
from vitalstrand.session import stage

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 60, 6
REGISTERS = BANDS * ROWS
ZEROS_MAX, MANTISSA = 48, 10
SHORT = 64
#: Sets that may reach a short one: similarity t needs sizes within a factor t.
SHORT_REACH = -(-SHORT * DENOMINATOR // NUMERATOR)


#: For each register the order in which it asks others when it is empty.
_BORROW = np.random.Generator(np.random.PCG64(97)).integers(0, REGISTERS, size=(REGISTERS, 64))
_EDGES = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], dtype=np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers (uint16) of sorted distinct hashes: leading zeros, then mantissa."""
    if not len(shingles):
        return np.zeros(REGISTERS, dtype=np.uint16)
    at = np.searchsorted(shingles, _EDGES)
    inside = np.minimum(at, len(shingles) - 1)
    found = shingles[inside]
    last = np.append(_EDGES[1:], np.uint64(2**64 - 1))
    filled = (at < len(shingles)) & (found >= _EDGES) & ((found < last) | (np.arange(REGISTERS) == REGISTERS - 1))
    # Place of the smallest hash inside its bucket, as a fraction of the bucket, in 52 bits.
    fraction = (found - _EDGES).astype(np.float64) / (2.0**64 / REGISTERS)
    fraction = np.clip(fraction, 2.0**-ZEROS_MAX, 1 - 2.0**-53)
    mantissa, exponent = np.frexp(fraction)
    zeros = np.minimum(-exponent, ZEROS_MAX)
    bits = ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    registers = (zeros.astype(np.int64) << MANTISSA | bits).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        asks = _BORROW[empty]
        answered = filled[asks]
        first = answered.argmax(axis=1)
        source = asks[np.arange(len(empty)), first]
        # A tour around the circle serves the few that found none.
        lost = ~answered.any(axis=1)
        if lost.any():
            full = np.flatnonzero(filled)
            source[lost] = full[np.searchsorted(full, empty[lost]) % len(full)]
        registers[empty] = registers[source]
    return registers


def band_keys(registers: np.ndarray) -> list[bytes]:
    raw = registers.astype("<u2").tobytes()
    size = 2 * ROWS
    return [hashlib.blake2b(raw[i * size : (i + 1) * size], digest_size=8, salt=i.to_bytes(2, "little")).digest() for i in range(BANDS)]


def chance(sizes: np.ndarray) -> np.ndarray:
    """Distribution over leading-zero counts of a register, for sets of the given sizes."""
    edges = 2.0 ** -np.arange(ZEROS_MAX + 2)
    stay = (1 - np.minimum(edges, 1))[None, :] ** np.maximum(sizes[:, None] / REGISTERS, 1)
    return stay[:, 1:] - stay[:, :-1]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from registers (rows), less the share that agrees by chance for sets of these sizes."""
    agree = (a == b).mean(axis=1)
    p = (chance(n_a) * chance(n_b)).sum(axis=1) / (1 << MANTISSA)
    return np.clip((agree - p) / (1 - p), 0, 1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if NUMERATOR * max(len(a), len(b)) > DENOMINATOR * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    hashes = WordHashes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            sizes, digests, sketches, keys = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(hashes.of(lower_words(text)), WORDS)
                n = len(s)
                sizes.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                sketches.append(sketch(s).astype("<u2").tobytes() if n >= SHORT else None)
                keys.append(s.view(np.int64) if 0 < n < SHORT_REACH else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                schema=schema,
            )


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch (long sets), keys (all shingles of short sets) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("doc_id is not null").mapInArrow(_sets, "doc_id long, n_shingles long, digest binary, sketch binary, keys array<long>")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            keys = [int.from_bytes(k, "little", signed=True) for sk in part.column(1).to_pylist() for k in band_keys(np.frombuffer(sk, "<u2"))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "node"])


def _alone(shingles: DataFrame) -> DataFrame:
    """(node, single): how many shingles of ``shingles`` (node, shingle) only one node has."""
    rows = shingles.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("rows")).filter("rows = 1")
    return rows.groupBy("node").agg(F.count("*").alias("single"))


def _short_keys(classes: DataFrame) -> DataFrame:
    """(key, node) of short sets: the shingles of their prefixes, in hash order.

    A set of which less than the threshold is shared with any other short set can't be linked and has no keys.
    """
    short = classes.filter("keys is not null").select("node", F.col("n_shingles").alias("n"), "keys")
    single = _alone(short.select("node", F.explode("keys").alias("shingle")))
    able = short.join(single, "node", "left").filter((F.col("n") - F.coalesce("single", F.lit(0))) * DENOMINATOR >= F.col("n") * NUMERATOR)
    need = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR).cast("int")
    return able.select(F.explode(F.slice("keys", 1, F.col("n").cast("int") - need + 1)).alias("key"), "node")


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose corrected estimate may still reach the threshold; short sets always do.

    The margin is six deviations. Borrowed registers repeat others, so a set counts for half as many independent
    registers as it has shingles, at most all of them.
    """
    least = NUMERATOR / DENOMINATOR
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            a, b, n_a, n_b, s_a, s_b = (c for c in part.columns)
            both = np.array([x and y for x, y in zip(s_a.is_valid().to_pylist(), s_b.is_valid().to_pylist(), strict=True)], dtype=bool)
            n_a, n_b = n_a.to_numpy(), n_b.to_numpy()
            margin = 6 * np.sqrt(least * (1 - least) / np.minimum(REGISTERS, np.minimum(n_a, n_b) / 2))
            keep = NUMERATOR * np.maximum(n_a, n_b) <= DENOMINATOR * np.minimum(n_a, n_b)
            at = np.flatnonzero(both & keep)
            if len(at):
                x = np.frombuffer(b"".join(s_a.take(pa.array(at)).to_pylist()), "<u2").reshape(len(at), REGISTERS)
                y = np.frombuffer(b"".join(s_b.take(pa.array(at)).to_pylist()), "<u2").reshape(len(at), REGISTERS)
                keep[at] = estimate(x, y, n_a[at], n_b[at]) >= least - margin[at]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    hashes = WordHashes()
    last_text, last_set = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            a, b, ta, tb = (c.to_pylist() for c in part.columns)
            keep = []
            for x, y in zip(ta, tb, strict=True):
                if x != last_text:
                    last_text, last_set = x, shingle_set(hashes.of(lower_words(x)), WORDS)
                keep.append(similar(last_set, shingle_set(hashes.of(lower_words(y)), WORDS)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """Those of ``pairs`` (a < b) that are links; staged."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    likely = stage(sized.mapInArrow(_plausible, "a long, b long"), f"{label}_likely")
    full = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))
    # The second join leaves the pairs of one `a` together, whose set is then built once.
    held = likely.join(full("b"), "b").join(full("a"), "a").select("a", "b", "t_a", "t_b")
    return stage(held.mapInArrow(_verified, "a long, b long"), f"{label}_links")


def _open(placed: DataFrame) -> DataFrame:
    """Rows of keys whose members are in more than one component."""
    keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return placed.join(keys, "key")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            sets = [shingle_set(hashes.of(lower_words(t)), WORDS).view(np.int64) for t in part.column(1).to_pylist()]
            node = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets))], names=["node", "shingle"])


def _shareable(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n, shared) of ``nodes``: the size of a set and how many of its shingles another of them has.

    Two sets can only share shingles that both share with somebody, so ``shared`` bounds every similarity exactly: members
    that have a passage in common and little else drop out alone, before pairs are formed.
    """
    held = nodes.join(texts.withColumnRenamed("doc_id", "node"), "node").select("node", "text")
    single = _alone(held.mapInArrow(_shingles, "node long, shingle long"))
    sized = nodes.join(classes.select("node", F.col("n_shingles").alias("n")), "node").join(single, "node", "left")
    return sized.select("node", "n", (F.col("n") - F.coalesce("single", F.lit(0))).alias("shared"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, node, added, shingle): shingles that only one of a node's text and its centre's has; ``added`` if the node has it."""
    hashes = WordHashes()
    last_text, last_set = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            found = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if x != last_text:
                    last_text, last_set = x, shingle_set(hashes.of(lower_words(x)), WORDS)
                one = shingle_set(hashes.of(lower_words(y)), WORDS)
                found += [np.setdiff1d(last_set, one, assume_unique=True), np.setdiff1d(one, last_set, assume_unique=True)]
            size = [len(f) for f in found]
            ends = [np.repeat(c.to_numpy().repeat(2), size) for c in part.columns[:2]]
            added = np.tile([False, True], part.num_rows).repeat(size)
            columns = [*map(pa.array, ends), pa.array(added), pa.array(np.concatenate(found).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["centre", "node", "added", "shingle"])


def _reachable(able: DataFrame, hubs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``able`` that may have a link to another component of their key, with ``far``, ``less`` and ``more``.

    Keys whose hubs are in one component share the hub that most of them have as their centre c. With d = x ^ c, two sets differ in
    |d_x| + |d_y| - 2 |d_x & d_y| shingles, and d_x & d_y holds only shingles that two differences from c have: ``less`` counts
    those of them that c has, ``more`` the others. So a pair can be a link only if far_x + far_y <= min(less_x, less_y) +
    min(more_x, more_y); rows that fail with all of theirs against the smallest ``far`` of the other components of their key drop out.
    """
    hub = hubs.join(found.withColumnRenamed("node", "hub"), "hub", "left").select("key", "hub", F.coalesce("component", "hub").alias("of"))
    votes = hub.groupBy("of", "hub").agg(F.count("*").alias("keys"))
    centres = votes.groupBy("of").agg((-F.max(F.struct("keys", -F.col("hub")))["col2"]).alias("centre"))
    seen = stage(able.join(hub.join(centres, "of").select("key", "centre"), "key"), "dedup_seen")

    full = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))
    held = seen.select("centre", "node").distinct().join(full("node"), "node").join(full("centre"), "centre")
    differ = held.select("centre", "node", "t_centre", "t_node").mapInArrow(_differences, "centre long, node long, added boolean, shingle long")
    differ = stage(differ, "dedup_differ")
    size = differ.groupBy("centre", "node").agg(F.count_if("added").alias("more"), F.count_if(~F.col("added")).alias("less"))
    single = differ.groupBy("centre", "shingle", "added").agg(F.min("node").alias("node"), F.count("*").alias("rows")).filter("rows = 1")
    single = single.groupBy("centre", "node").agg(F.count_if("added").alias("one_more"), F.count_if(~F.col("added")).alias("one_less"))
    both, gap = NUMERATOR + DENOMINATOR, DENOMINATOR - NUMERATOR
    rows = seen.join(size, ["centre", "node"], "left").join(single, ["centre", "node"], "left").na.fill(0, ["more", "less", "one_more", "one_less"])
    rows = rows.select(
        "key", "node", "component", ((F.col("more") + F.col("less")) * both - F.col("n") * gap).alias("far"),
        *[((F.col(c) - F.col(f"one_{c}")) * 2 * both).alias(c) for c in ("less", "more")],
    )
    rows = stage(rows, "dedup_far")
    near = rows.groupBy("key", "component").agg(F.min("far").alias("far"))
    first = near.groupBy("key").agg(F.min(F.struct("far", "component")).alias("first"))
    others = near.join(first, "key").filter(F.col("component") != F.col("first.component"))
    nearest = others.groupBy("key").agg(F.min("first").alias("first"), F.min("far").alias("second"))
    other = F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.far"))
    return rows.join(nearest, "key").filter(F.col("far") + other <= F.col("less") + F.col("more")).drop("first", "second")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(shingled(texts), "dedup_sets")
    repeated = sets.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    if repeated:
        texts = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        sets = stage(shingled(texts), "dedup_sets")
    heads = stage(sets.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "dedup_classes")
    classes = sets.join(heads.select(F.col("node").alias("doc_id")), "doc_id").withColumnRenamed("doc_id", "node").drop("digest")
    classes = stage(classes, "dedup_heads")

    keyed = classes.filter("sketch is not null").select("node", "sketch").mapInArrow(_bands, "key long, node long")
    keyed = keyed.unionByName(stage(_short_keys(classes), "dedup_short"))
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("other")).filter("a <> other").select("key", "a")
    bands = stage(keyed.join(least, "key"), "dedup_bands")
    first = stage(bands.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "dedup_stars")
    links = _links(first, classes, texts, "dedup_star")
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "dedup_edges")

    # Members of one band in different components, other than the pairs that were just decided.
    placed = bands.join(found, "node", "left").select("key", "node", "a", F.coalesce("component", "node").alias("component"))
    placed = stage(_open(placed).filter("node <> a"), "dedup_open")
    sizes = _shareable(placed.select("node").distinct(), classes, texts)
    placed = placed.join(sizes, "node")
    least = placed.groupBy("key").agg(F.min("n").alias("n_least"))
    both = NUMERATOR + DENOMINATOR
    able = placed.join(least, "key").filter(F.col("shared") * both >= (F.col("n") + F.col("n_least")) * NUMERATOR).drop("n_least", "a")
    able = stage(_open(able), "dedup_able")

    # Members first meet the one of their band that shares most of its set: the likely original of a group of copies.
    hubs = able.groupBy("key").agg((-F.max(F.struct(F.col("shared") / F.col("n"), -F.col("node")))["col2"]).alias("hub"))
    hubs = stage(hubs, "dedup_hub_keys")
    near_hub = able.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near_hub = stage(near_hub.join(first, ["a", "b"], "left_anti"), "dedup_hubs")
    more = _links(near_hub, classes, texts, "dedup_hub")
    if more.limit(1).count():
        links = stage(links.unionByName(more), "dedup_links")
        found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "dedup_edges")
        able = able.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        able = stage(_open(able), "dedup_able")

    # Whoever still can, meets every member of another component.
    able = stage(_open(_reachable(able, hubs, found, texts)), "dedup_reach")
    x, y = (able.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "far", "less", "more")]) for s in "xy")
    near = (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y"))
    near = near & (F.col("far_x") + F.col("far_y") <= F.least("less_x", "less_y") + F.least("more_x", "more_y"))
    rest = x.join(y, "key").filter(near).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    rest = stage(rest.join(first, ["a", "b"], "left_anti").join(near_hub, ["a", "b"], "left_anti"), "dedup_rest")
    more = _links(rest, classes, texts, "dedup_rest")
    if more.limit(1).count():
        both_links = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = components(both_links, "dedup_edges")

    member = sets.select("doc_id", "n_shingles", "digest").join(heads, "digest", "left")
    member = member.join(found, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")
    )
    return member.withColumn("kept", F.col("doc_id") == F.col("component_id"))
