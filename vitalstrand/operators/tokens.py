"""The token table: every stream as (person_id, ts, stream_ord, tid, n).

``n`` is how often the same token occurs at the same instant. Counting repeats instead of storing them
bounds the rows of one person-day by the bins of a day plus the vocabulary, whatever the input volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalstrand.config import ENC_SEP, ID_RANGES, STREAM_ORDER
from vitalstrand.operators.joins import hot_keys, salted_join
from vitalstrand.operators.ranks import distribution, order_statistics
from vitalstrand.operators.signals import decile_of

COLUMNS = ("person_id", "ts", "stream_ord", "tid", "n")


def wearable_tokens(encoded: DataFrame) -> DataFrame:
    """Decile tokens; a binned stream already has one row per person and instant."""
    order = base = None
    for stream in ("HR", "STEPS", "HRV"):
        hit = F.col("stream") == stream
        order = (F if order is None else order).when(hit, STREAM_ORDER[stream])
        base = (F if base is None else base).when(hit, ID_RANGES[stream][0])
    return encoded.select(
        "person_id",
        "ts",
        order.alias("stream_ord"),
        (base + F.col("dec")).cast("int").alias("tid"),
        F.lit(1).cast("long").alias("n"),
    )


def coded_events(facts: DataFrame, day: str, key: str, lookup: DataFrame) -> DataFrame:
    """Coded records as (person_id, ts, token, tid); a date is stamped at midnight.

    A concept on a large share of the records is spread over tasks; a stream is joined as it comes.
    """
    dated = facts.select("person_id", F.col(day).cast("timestamp").alias("ts"), F.col(key).alias("concept_id"))
    hot = [] if facts.isStreaming else hot_keys(dated, "concept_id")
    return salted_join(dated, lookup, ["concept_id"], hot, ["person_id", "ts"]).select("person_id", "ts", "token", "tid")


def ehr_tokens(*events: DataFrame) -> DataFrame:
    """Union of coded streams, repeats counted."""
    union = events[0]
    for e in events[1:]:
        union = union.unionByName(e)
    return (
        union.groupBy("person_id", "ts", "tid")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("person_id", "ts", F.lit(STREAM_ORDER["EHR"]).alias("stream_ord"), "tid", "n")
    )


def all_tokens(*streams: DataFrame) -> DataFrame:
    union = streams[0].select(*COLUMNS)
    for s in streams[1:]:
        union = union.unionByName(s.select(*COLUMNS))
    return union


# --- optional encoders -----------------------------------------------------------------------------


def lab_cuts(results: DataFrame) -> DataFrame:
    """Nine cut points per laboratory item: (item, n, cuts)."""
    dist = distribution(results, "v", ["item"])
    ranks = {f"c{d}": F.floor((F.col("n_total") * d + 9) / 10) - 1 for d in range(1, 10)}
    picked = order_statistics(dist, "v", ranks, ["item"])
    return picked.select("item", "n", F.array(*[F.col(f"c{d}") for d in range(1, 10)]).alias("cuts"))


def lab_deciles(results: DataFrame, cuts: DataFrame) -> DataFrame:
    """Laboratory results as ``LAB:<item>_D<decile>``, each item against its own reference."""
    dec = decile_of("v", "cuts")
    return results.join(cuts.select("item", "cuts"), "item").select(
        "person_id",
        "ts",
        "item",
        "v",
        dec.alias("dec"),
        F.concat(F.lit("LAB:"), F.col("item"), F.lit("_D"), dec.cast("string")).alias("token"),
    )


def ecg_tokens(records: DataFrame) -> DataFrame:
    lo = ID_RANGES["ECG"][0]
    afib = F.col("classification") == "atrialFibrillation"
    return records.select(
        "person_id",
        "ts",
        F.when(afib, "ECG_AFIB").otherwise("ECG_NORMAL").alias("token"),
        F.when(afib, lo).otherwise(lo + 1).alias("tid"),
    )


def encounter_days(visited: DataFrame) -> DataFrame:
    """Per person-day token arrays with ``<ENC_SEP>`` where the visit changes.

    Input: (person_id, day, visit_id, tid). Repeats are counted before a day is gathered; nothing is cut here,
    windows truncate when they are assembled.
    """
    runs = visited.groupBy("person_id", "day", "visit_id", "tid").agg(F.count(F.lit(1)).alias("n"))
    days = runs.groupBy("person_id", "day").agg(
        F.sort_array(F.collect_list(F.struct("visit_id", "tid", "n"))).alias("runs")
    )
    block = F.transform(
        "runs",
        lambda r, i: F.concat(
            F.when((i > 0) & (F.get(F.col("runs"), i - 1)["visit_id"] != r["visit_id"]), F.array(F.lit(ENC_SEP))).otherwise(
                F.array().cast("array<int>")
            ),
            F.array_repeat(r["tid"], r["n"].cast("int")),
        ),
    )
    return days.select("person_id", "day", F.flatten(block).alias("ids"))
