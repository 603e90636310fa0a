r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role are merged into one
message whose parts stay separable::

    ### user: first part<+>second part</turn>\n
    ### assistant: answer</turn>\n

Inside roles and texts ``\``, ``#``, ``<`` and ``:`` (roles only) become ``\b``, ``\h``, ``\l`` and ``\c``, so a
``<`` or ``#`` in the output is always a mark, and every backslash starts an escape. The loss mask is kept as run
lengths: each turn has ``skip`` unmasked characters and then ``take`` characters of escaped text, which count as
loss where ``loss`` is true.

Defined cases: null text or role is empty text; a null turn sorts before others; equal turns are ordered by
role, then text; repeated rows are all kept; null ``conv_id`` is one conversation; an empty table gives no rows;
other columns are ignored. A conversation becomes one row, since the formatted text is one value; nothing
in it grows faster than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
TURN_END, PART_END, HEAD, HEAD_END = "</turn>\n", "<+>", "### ", ": "
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of skip, take, loss), messages (role, parts) of each conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    at = lambda i: F.get("t", i)["role"]
    starts = lambda x, i: (i == 0) | (at(i - 1) != x["role"])
    ends = lambda x, i: (i == F.size("t") - 1) | (at(i + 1) != x["role"])
    pieces = F.transform(
        "t",
        lambda x, i: F.struct(
            F.when(starts(x, i), F.concat(F.lit(HEAD), escape(x["role"], True), F.lit(HEAD_END))).otherwise("").alias("head"),
            escape(x["text"]).alias("body"),
            F.when(ends(x, i), F.lit(TURN_END)).otherwise(F.lit(PART_END)).alias("tail"),
            (x["role"] == LOSS_ROLE).alias("loss"),
        ),
    )
    firsts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: starts(F.get("t", i), i))
    chats = chats.withColumn("p", pieces).withColumn("firsts", firsts)
    skip = lambda x, i: F.length(x["head"]) + F.when(i > 0, F.length(F.get("p", i - 1)["tail"])).otherwise(0)
    width = lambda k: F.coalesce(F.get("firsts", k + 1), F.size("t")) - F.get("firsts", k)
    return chats.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.transform("p", lambda x, i: F.struct(skip(x, i).alias("skip"), F.length(x["body"]).alias("take"), x["loss"].alias("loss"))).alias("mask"),
        F.transform(
            "firsts",
            lambda s, k: F.struct(
                F.get("t", s)["role"].alias("role"),
                F.transform(F.slice("t", s + 1, width(k)), lambda x: x["text"]).alias("parts"),
            ),
        ).alias("messages"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns back from the formatted text: conv_id, formatted, turns (role or null where merged, text), loss_text.

    Every ``<`` opens the mark that ends a piece, so splitting at it yields the turns. Roles come from
    the head of a message; the parts after the first take the role of the message they belong to.
    """
    split = F.split("formatted", "<")
    piece = lambda s, i: F.when(i == 0, s).otherwise(F.substr(s, F.when(F.startswith(s, F.lit("/")), len(TURN_END)).otherwise(len(PART_END))))
    parts = F.slice(F.transform(split, piece), 1, F.size(split) - 1)
    rows = chats.select("conv_id", "formatted", "mask", parts.alias("s"))
    headed = F.transform(
        "s",
        lambda x: F.struct(
            F.when(F.startswith(x, F.lit("#")), F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), HEAD_END, 1)).alias("role"),
            F.when(F.startswith(x, F.lit("#")), F.substr(x, F.locate(HEAD_END, x) + len(HEAD_END))).otherwise(x).alias("body"),
        ),
    )
    rows = rows.withColumn("h", headed)
    heads = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i)["role"].isNotNull())
    rows = rows.withColumn("heads", F.when(F.size("h") > 0, heads).otherwise(F.array().cast("array<int>")))
    width = lambda k: F.coalesce(F.get("heads", k + 1), F.size("h")) - F.get("heads", k)
    grouped = F.transform(
        "heads",
        lambda s, k: F.transform(
            F.slice("h", s + 1, width(k)),
            lambda x: F.struct(unescape(F.get("h", s)["role"]).alias("role"), unescape(x["body"]).alias("text")),
        ),
    )
    masked = F.transform("mask", lambda m, i: F.when(m["loss"], unescape(F.right(F.get("s", i), m["take"]))).otherwise(""))
    return rows.select("conv_id", "formatted", F.flatten(grouped).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rows from ``read_chats``."""
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
