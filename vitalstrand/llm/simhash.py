"""SimHash fingerprints with DataFrame functions only.

A text's terms are its words with the word before each; every occurrence votes, so a term weighs as often as it
occurs. Two 64-bit hashes of a term give 128 signed bits; a bit of the fingerprint is set where more than half
of the votes are ones. Votes are summed two bits to a long, 32 binary places each. Likeness is one minus the share of
bits that differ; for unrelated texts it is near one half.

Fingerprints within a Hamming radius are found by permuted block tables: the bits are cut into blocks, every choice
of ``blocks - radius`` blocks is one table keyed by those bits, and two fingerprints within the radius agree in
at least one of the tables. Distance is then counted exactly.

Defined cases: a null text is an empty one; an empty text, or one of white space, has no terms and the zero
fingerprint, and an empty pair has likeness 1; repeated ``doc_id`` are ordered by their text; null ids come first;
the only document is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 128
LOW = (1 << 32) - 1
LANES = (1 << 32) | 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def pair_terms(words: str) -> Column:
    """Hash input of each word of an array column: the word with the one before it."""
    return F.transform(words, lambda w, i: F.xxhash64(F.coalesce(F.get(words, i - 1), F.lit("")), w))


def votes(term: Column) -> list[Column]:
    """Sums over rows of the bits of a term's two hashes, two bits to a column."""
    first, second = term, F.when(term.isNotNull(), F.xxhash64(term))
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))).alias(f"v{k}_{j}") for k, h in enumerate((first, second)) for j in range(32)]


def fingerprint(count: Column) -> Column:
    """128 bits as 32 hexadecimal digits, from the sums of ``votes`` and the number of terms."""
    quarters = []
    for k in range(2):
        for lane in (lambda v: F.shiftrightunsigned(v, 32), lambda v: v.bitwiseAND(F.lit(LOW))):
            word = F.lit(0).cast("long")
            for j in range(32):
                word = word + F.when(lane(F.col(f"v{k}_{j}")) * 2 > count, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
            quarters.append(F.lower(F.lpad(F.hex(word), 8, "0")))
    return F.concat(*quarters)


def distance(a: Column, b: Column) -> Column:
    """Bits that differ between two fingerprints."""
    half = lambda x, i: F.conv(F.substr(x, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long")
    return sum((F.bit_count(half(a, i).bitwiseXOR(half(b, i))) for i in range(BITS // 32)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - distance(a, b) / F.lit(float(BITS))


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and the fingerprint ``<column>_fp`` of each text column; ``keys`` name a row.

    Rows are exploded into terms and summed again by all keys, so the sums stay in hash aggregates. Where ``texts``
    is dealt by some of the keys no row moves.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("which"), words_of(F.col(c)).alias("words")) for i, c in enumerate(columns)])
    long = texts.select(*keys, F.explode(parts).alias("part")).select(*keys, "part.which", "part.words")
    long = long.select(*keys, "which", F.explode_outer(pair_terms("words")).alias("term"))
    sums = long.groupBy(*keys, "which").agg(F.count("term").alias("count"), *votes(F.col("term")))
    prints = sums.select(*keys, "which", fingerprint(F.col("count")).alias("fp"))
    return prints.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == i, F.col("fp"))).alias(f"{c}_fp") for i, c in enumerate(columns)])


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``, dealt by ranges of ``doc_id`` (``range``) and ordered in them (``row``).

    Split points are ids that occur, so the first rows of a range are known by their id alone; they are also sent to
    the range before, where they follow its last row as ghosts (``ghost`` > 0). One shuffle of the texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Several ranges to a partition even out how they are dealt.
    ranges = 8 * parts
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(
        F.percentile_approx("doc_id", shares, 10_000).alias("cuts"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")
    ).head()
    cuts = sorted(set(found["cuts"] or []))
    low = None if found["nulls"] else found["low"]
    # Range of an id: how many cuts do not exceed it. Null ids are in the first.
    at = F.coalesce(F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c <= F.col("doc_id"))), F.lit(0))
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(at)
    begins = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    first = F.col("doc_id").eqNullSafe(F.lit(low).cast("long"))
    last_range = len(cuts)
    copies = F.array_compact(
        F.array(
            F.struct(at.alias("range"), F.lit(0).alias("ghost")),
            F.when(begins, F.struct((at - 1).alias("range"), F.lit(1).alias("ghost"))),
            F.when(first, F.struct(F.lit(last_range).alias("range"), F.lit(2).alias("ghost"))),
        )
    )
    rows = rows.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.range", "c.ghost")
    order = Window.partitionBy("range").orderBy("ghost", "doc_id", "text")
    return rows.repartition(parts, "range").select(
        "range", F.row_number().over(order).alias("row"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the beginning of ``following``, as long or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    rows = in_order(docs, parts)
    edit = F.when(F.col("ghost") == 0, edited(F.col("text"), F.col("next_text")))
    rows = rows.select("range", "row", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edit.alias("edit"))
    rows = rows.withColumn("edited_sha256", F.sha2("edit", 256))
    prints = fingerprints(rows, ["range", "row", "ghost", "doc_id", "n_chars", "edited_sha256"], ["text", "edit"])
    following = F.lead("text_fp").over(Window.partitionBy("range").orderBy("row"))
    return prints.withColumn("next_fp", following).filter("ghost = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("text_fp").alias("fingerprint"),
        F.col("edit_fp").alias("edited_fingerprint"),
        likeness(F.col("text_fp"), F.col("edit_fp")).alias("near_edited"),
        likeness(F.col("text_fp"), F.col("next_fp")).alias("near_next"),
    )


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (a, b, distance), a < b, of distinct fingerprints at most ``radius`` bits apart.

    Works on distinct values, so copies cost one row. A table's key is ``blocks - radius`` whole blocks: long keys
    that unrelated fingerprints rarely share.
    """
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed radius")
    bits = F.concat(*[F.lpad(F.conv(F.substr("fingerprint", F.lit(1 + 8 * i), F.lit(8)), 16, 2), 32, "0") for i in range(BITS // 32)])
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    rows = prints.select("fingerprint").filter("fingerprint is not null").distinct().select("fingerprint", bits.alias("bits"))
    block = lambda i: F.substr("bits", F.lit(1 + edges[i]), F.lit(edges[i + 1] - edges[i]))
    chosen = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[F.xxhash64(F.lit(t), *[block(i) for i in keep]) for t, keep in enumerate(chosen)])
    keyed = rows.select("fingerprint", F.explode(keys).alias("key"))
    left, right = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    pairs = left.join(right, "key").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", distance(F.col("a"), F.col("b")).cast("int")).filter(F.col("distance") <= radius)
