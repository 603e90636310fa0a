"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised. ``alpha`` = 1 keeps the shares, 0 makes
them equal. It is bisected, on one aggregated row, to the flattest mix whose entropy does not exceed a target or
whose most repeated source stays within a limit. The budget is then realised by permuted blocks: each source's
documents fall into a fixed number of hash blocks; a whole epoch takes every block, the last one takes blocks
in permuted order and cuts inside one block, at the document where the source's budget is reached.

Defined cases: a null source is a source of its own; null or empty texts have no tokens, are part of every whole
epoch and never decide a cut; repeated rows and ids are rows of their own; an empty table or one without tokens
gives every row once; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalstrand.session import stage

#: Hash blocks of a source: the unit of permutation. Bounds the rows of the block table by sources x BLOCKS.
BLOCKS = 128
#: Halvings of the exponent's interval.
STEPS = 50
#: The block table is broadcast up to this many rows; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000


def n_tokens(text: Column) -> Column:
    """Words of a text: the unit of shares and budgets."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _fold(array: str, each) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + each(x))


def weights(
    shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None
) -> DataFrame:
    """Weight and budget of each source from ``shares`` (src, tokens).

    ``budget`` is the mix's tokens as a multiple of all tokens; None takes every document at least once: the
    budget at which the least repeated source has exactly one epoch. ``target_entropy`` is in nats.
    Only sources with tokens are weighed; one row per source passes through the bisection's single row.
    """
    shares = shares.filter("tokens > 0")
    row = shares.agg(F.array_sort(F.collect_list(F.struct("src", F.col("tokens").cast("double").alias("t")))).alias("s"))
    row = row.withColumn("total", _fold("s", lambda x: x["t"]))
    row = row.withColumn("p", F.transform("s", lambda x: x["t"] / F.col("total")))
    state = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def fits(alpha: Column) -> Column:
        z = _fold("p", lambda p: F.pow(p, alpha))
        ok = F.lit(True)
        if target_entropy is not None:
            ok = ok & (F.log(z) - _fold("p", lambda p: F.pow(p, alpha) * alpha * F.log(p)) / z <= target_entropy)
        if max_repeats is not None:
            # Epochs are proportional to p ** (alpha - 1); its largest value belongs to the smallest share.
            spread = F.pow(F.array_min("p"), alpha - 1)
            base = F.pow(F.array_max("p"), alpha - 1) if budget is None else z / budget
            ok = ok & (spread / base <= max_repeats)
        return ok

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, s["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, halve)["hi"]
    row = row.withColumn("alpha", F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(alpha))
    row = row.withColumn("z", _fold("p", lambda p: F.pow(p, F.col("alpha"))))
    whole = F.pow(F.array_max("p"), 1 - F.col("alpha")) * F.col("z") if budget is None else F.lit(float(budget))
    row = row.withColumn("budget", whole * F.col("total"))
    out = row.select("alpha", "z", "total", "budget", F.explode("s").alias("x"))
    weight = F.pow(F.col("x.t") / F.col("total"), F.col("alpha")) / F.col("z")
    out = out.select(F.col("x.src").alias("src"), F.col("x.t").cast("long").alias("tokens"), "alpha", weight.alias("weight"), "budget")
    # Rounded to whole tokens, so that a full epoch isn't missed or begun by the last bit of a double.
    return out.withColumn("source_budget", F.round(F.col("weight") * F.col("budget")).cast("long"))


def mix(
    docs: DataFrame, seed: int = 7, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None
) -> DataFrame:
    """Rows of ``docs``, once for each time the mix takes them.

    Adds mix_epoch (0 is the first), mix_block (place of the block in its epoch's permutation), mix_order
    (place inside the block), mix_weight and mix_tokens. Reading sources in proportion to their weights, each
    by (mix_epoch, mix_block, mix_order), gives the mix at every prefix.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc")
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(
        whole,
        source_key(F.col("source")).alias("_src"),
        n_tokens(F.col("text").cast("string")).alias("_n"),
        place.alias("_h"),
    ).withColumn("_block", F.pmod(F.col("_h"), F.lit(BLOCKS)).cast("int"))

    blocks = stage(rows.groupBy("_src", "_block").agg(F.sum("_n").alias("size"), F.count("*").alias("rows")), "mix_blocks")
    plan = weights(blocks.groupBy(F.col("_src").alias("src")).agg(F.sum("size").alias("tokens")), target_entropy, max_repeats, budget)
    plan = plan.select(
        F.col("src").alias("_src"),
        F.col("weight"),
        F.floor(F.col("source_budget") / F.col("tokens")).cast("int").alias("full"),
        F.pmod(F.col("source_budget"), F.col("tokens")).alias("rest"),
    )
    blocks = blocks.join(plan, "_src", "left")
    order = Window.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed), "_src", "_block", "full"), "_block")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    blocks = stage(
        blocks.select(
            "_src",
            "_block",
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("full", F.lit(1)).alias("full"),
            # Tokens that the last, partial epoch still takes when it comes to this block.
            F.greatest(F.coalesce(F.col("rest") - before, F.lit(0)), F.lit(0)).alias("left"),
            "size",
            F.row_number().over(order).alias("rank"),
        ),
        "mix_plan",
    )
    cut = blocks.filter("left > 0 and left < size")
    small = blocks.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    # Only the block of each source where its budget ends is ordered by document.
    ends = rows.join(hint(cut.select("_src", "_block", "left")), ["_src", "_block"]).select("_src", "_block", "left", "_h", "_n")
    inside = Window.partitionBy("_src", "_block").orderBy("_h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Rows up to and with the one that reaches the budget: those that begin before it. Equal rows go together.
    ends = ends.withColumn("until", F.sum("_n").over(inside)).filter("until - _n < left and _n > 0")
    ends = ends.groupBy("_src", "_block").agg(F.max("_h").alias("last_h"))
    blocks = blocks.join(ends, ["_src", "_block"], "left").drop("size")

    rows = rows.join(hint(blocks), ["_src", "_block"])
    taken = F.col("left") > 0
    taken = taken & (F.col("last_h").isNull() | (F.col("_h") <= F.col("last_h"))) & (F.col("_n") > 0)
    times = F.col("full") + F.when(taken, 1).otherwise(0)
    rows = rows.filter(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    last = F.col("mix_epoch") == F.col("full")
    return rows.select(
        *[F.col("_doc")[c].alias(c) for c in names],
        "mix_epoch",
        F.when(last, F.col("rank")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "_block", "mix_epoch"), F.lit(1 << 30)).cast("int")).alias("mix_block"),
        F.col("_h").alias("mix_order"),
        F.col("weight").alias("mix_weight"),
        F.col("_n").alias("mix_tokens"),
    )
