"""Fill-in-the-middle: a text is cut twice and its parts are put in another order between marks.

A text of ``n`` units is matched once by a pattern made for its row: a possessive group of ``a`` units, one of ``b - a``
units and the rest. Possessive counts never step back, so a match is one pass over the text in constant stack. The parts
are put in place by the replacement of that same match, and the marks lead back to the text the same way.

Cuts and form come from a hash of the key, so they don't depend on order, partition or retry.

Defined cases: a null or empty text is empty and plain; a null key hashes like an empty one; texts that hold a mark stay
plain, which keeps the output reversible; what follows the last whole unit belongs to the suffix; repeated rows and keys
each give a row of their own; columns of the input other than key and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point, line ends included.
CODE_POINT = "."
#: Units counted as one match.
BLOCK = 256


def _draws(key: Column, seed: str, names: list[str]) -> list[Column]:
    """Numbers from the 8-digit groups of the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(names)]


def count_units(text: Column, unit: str = CODE_POINT) -> Column:
    """Units that follow one another from the start of ``text``.

    Counting lists its matches, so whole blocks of units are counted first and then the units behind the last block.
    """
    block = f"(?:{unit}){{{BLOCK}}}+"
    behind = F.regexp_replace(text, F.lit(f"(?s)\\A(?:{block})*+"), F.lit(""))
    return F.regexp_count(text, F.lit(f"(?s)\\G{block}")).cast("long") * BLOCK + F.regexp_count(behind, F.lit(f"(?s)\\G(?:{unit})"))


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = CODE_POINT,
    transformed: int = 90,
    suffix_first: int = 20,
    seed: str = "1",
) -> DataFrame:
    """Columns ``key``, n (units), form, prefix_units, middle_units (null if plain), output.

    ``unit`` is a pattern of one unit without groups that capture. Of a hundred texts ``transformed`` are cut, and of these
    ``suffix_first`` in the hundred have the suffix first (spm), the others the prefix (psm).
    """
    rows = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    drawn = rows.select("*", count_units(F.col("_text"), unit).alias("n"), *_draws(F.col(key), seed, ["_h1", "_h2", "_h3", "_h4"]))
    first, second = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(mark))
    plain = (F.col("_text") == "") | marked | (F.col("_h3") % 100 >= transformed)
    formed = drawn.select(
        key,
        "_text",
        "n",
        F.when(plain, "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(first, second).alias("_a"),
        F.greatest(first, second).alias("_b"),
    )
    pattern = F.format_string(
        f"(?s)\\A((?:{unit.replace('%', '%%')}){{%d}}+)((?:{unit.replace('%', '%%')}){{%d}}+)(.*+)\\z", F.col("_a"), F.col("_b") - F.col("_a")
    )
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    cut = F.col("form") != "plain"
    return formed.select(
        key,
        "n",
        "form",
        F.when(cut, F.col("_a")).alias("prefix_units"),
        F.when(cut, F.col("_b") - F.col("_a")).alias("middle_units"),
        F.when(cut, F.regexp_replace("_text", pattern, order)).otherwise(F.col("_text")).alias("output"),
    )


def restore(form: Column, output: Column) -> Column:
    """The text before the transformation, from form and output alone."""
    psm = F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z")
    spm = F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z")
    return (
        F.when(form == "psm", F.regexp_replace(output, psm, F.lit("$1$3$2")))
        .when(form == "spm", F.regexp_replace(output, spm, F.lit("$2$3$1")))
        .otherwise(output)
    )


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Output and restored text as hashes; units are code points."""
    return rows.select(
        key,
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
