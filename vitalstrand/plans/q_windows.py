"""Queries: windows, labels, sequences, shards and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalstrand.config import ID_SPACE, SPLITS, uniform_stride
from vitalstrand.functions.arrays import positions_from_separators
from vitalstrand.operators import sampling as sa
from vitalstrand.operators import tokens as tk
from vitalstrand.operators import windows as wi
from vitalstrand.plans.oracle import cols, compose
from vitalstrand.plans.registry import dense, history, query
from vitalstrand.session import fresh_path, stage
from vitalstrand.sources import bindings as b
from vitalstrand.sources import sinks

H, D = "history", "dense"
EVEN = uniform_stride(14)
KEY = "person_id:i end_date:d"
TEXT = "array_to_string(ids, ' ') AS input_ids, array_to_string(poss, ' ') AS positions"


@query("window_anchors", compose(H, f"SELECT {cols(KEY)}, split FROM anchors"))
def window_anchors(spark, sf_dir):
    return history(spark, sf_dir).anchors().select("person_id", "end_date", "split")


@query("window_labels", compose(H, f"SELECT {cols(KEY + ' label:i')} FROM labels_w", stride_days=EVEN))
def window_labels(spark, sf_dir):
    s = history(spark, sf_dir, stride_days=EVEN)
    return wi.with_labels(s.anchors(), s.positives()).select("person_id", "end_date", "label")


@query(
    "window_labels_incident",
    compose(
        H,
        f"SELECT {cols('a.person_id:i a.end_date:d').replace('AS a.', 'AS ')}, CAST(CASE WHEN f.day BETWEEN a.end_date + 1 AND a.end_date + 30 THEN 1 ELSE 0 END AS BIGINT) "
        "AS label FROM anchors a LEFT JOIN (SELECT person_id, MIN(day) AS day FROM endcond GROUP BY person_id) f ON a.person_id = f.person_id",
        stride_days=EVEN,
    ),
)
def window_labels_incident(spark, sf_dir):
    s = history(spark, sf_dir, stride_days=EVEN, incident_only=True)
    return wi.with_labels(s.anchors(), s.positives()).select("person_id", "end_date", "label")


@query(
    "window_index",
    compose(
        H,
        f"SELECT {cols(KEY)}, split, CAST(LEAST(4096, t + d + 1) AS BIGINT) AS n_tokens, CAST(label AS BIGINT) AS label FROM "
        "(SELECT w.person_id, w.end_date, w.split, SUM(n) AS t, COUNT(DISTINCT day) AS d, MIN(label) AS label FROM wtok w "
        "JOIN labels_w l ON w.person_id = l.person_id AND w.end_date = l.end_date GROUP BY ALL)",
        stride_days=EVEN,
    ),
)
def window_index(spark, sf_dir):
    """Flagship: cohort, 30-day anchors, token counts and look-ahead labels."""
    return history(spark, sf_dir, stride_days=EVEN).window_index().select(
        "person_id", "end_date", "split", "n_tokens", "label"
    )


@query("window_tokens", compose(H, f"SELECT {cols(KEY + ' ts:t stream_ord:i tid:i n:i')} FROM wtok"))
def window_tokens(spark, sf_dir):
    return history(spark, sf_dir).window_tokens().select("person_id", "end_date", "ts", "stream_ord", "tid", "n")


@query(
    "merged_sequence",
    compose(
        D,
        f"SELECT {cols(KEY)}, row_number() OVER (PARTITION BY person_id, end_date ORDER BY ts, stream_ord, tid) AS seq, "
        f"{cols('ts:t stream_ord:i tid:i')} FROM wpos",
    ),
)
def merged_sequence(spark, sf_dir):
    return wi.merged_sequence(dense(spark, sf_dir).window_tokens())


@query(
    "day_index",
    compose(
        H,
        f"SELECT {cols(KEY + ' day:d')}, CAST(SUM(n) AS BIGINT) AS n, dense_rank() OVER (PARTITION BY person_id, end_date "
        "ORDER BY day) - 1 AS position FROM wtok GROUP BY person_id, end_date, day",
    ),
)
def day_index(spark, sf_dir):
    s = history(spark, sf_dir)
    days = wi.in_windows(wi.day_counts(s.tokens()), s.calendar(), s.params.window_days)
    return wi.day_index(days).select("person_id", "end_date", "day", "n", "position")


@query("window_sequences", compose(H, f"SELECT {cols(KEY)}, split, {TEXT}, n_tokens FROM seqs"))
def window_sequences(spark, sf_dir):
    return history(spark, sf_dir).sequences().select(
        "person_id", "end_date", "split", "input_ids", "positions", "n_tokens"
    )


@query(
    "window_sequences_calendar",
    compose(
        D,
        f"SELECT {cols(KEY)}, array_to_string(list(pos ORDER BY rn), ' ') AS positions FROM (SELECT k.person_id, k.end_date, rn, "
        "CASE WHEN rn = 1 THEN 0 ELSE date_diff('day', k.end_date - 7, day) END AS pos FROM kept k JOIN (SELECT DISTINCT person_id, "
        "end_date, day, pos FROM wpos) d ON k.person_id = d.person_id AND k.end_date = d.end_date AND k.pos = d.pos) "
        "GROUP BY person_id, end_date",
    ),
)
def window_sequences_calendar(spark, sf_dir):
    """Positions as days since the window start instead of the dense day index."""
    return dense(spark, sf_dir, calendar_positions=True).sequences().select("person_id", "end_date", "positions")


@query(
    "window_rows",
    compose(D, f"SELECT {cols(KEY)}, split, {TEXT}, n_tokens, CAST(label AS BIGINT) AS label FROM lseqs"),
)
def window_rows(spark, sf_dir):
    rows = dense(spark, sf_dir).windows()
    return rows.select("person_id", "end_date", "split", "input_ids", "positions", "n_tokens", "label")


@query("truncate_tail", compose(D, f"SELECT {cols(KEY)}, {TEXT}, n_tokens FROM seqs", max_len=20))
def truncate_tail(spark, sf_dir):
    """A short limit at encode time."""
    return dense(spark, sf_dir, max_len=20).sequences().select(
        "person_id", "end_date", "input_ids", "positions", "n_tokens"
    )


@query(
    "padded_windows",
    compose(
        D,
        f"SELECT {cols(KEY)}, array_to_string(list_concat(ids, list_transform(range(48 - n_tokens), lambda x: 0)), ' ') AS input_ids, "
        "array_to_string(list_concat(poss, list_transform(range(48 - n_tokens), lambda x: 0)), ' ') AS positions, "
        "n_tokens AS n_real, array_to_string(list_concat(list_transform(range(n_tokens), lambda x: 'true'), "
        "list_transform(range(48 - n_tokens), lambda x: 'false')), ' ') AS attn_mask FROM seqs",
        max_len=48,
    ),
)
def padded_windows(spark, sf_dir):
    """Fixed-width rows; sequences are cut again at load time before padding."""
    padded = wi.padded(dense(spark, sf_dir).sequences(), 48)
    real = F.size(F.filter("attn_mask", lambda m: m))
    return padded.select("person_id", "end_date", "input_ids", "positions", real.alias("n_real"), "attn_mask")


@query("positions_from_sep", compose(D, f"SELECT {cols(KEY)}, array_to_string(poss, ' ') AS positions FROM seqs"))
def positions_from_sep(spark, sf_dir):
    """Rebuild positions from the separators alone."""
    seqs = dense(spark, sf_dir).sequences()
    return seqs.select("person_id", "end_date", positions_from_separators(F.col("input_ids")).alias("positions"))


@query(
    "id_range_violations",
    compose(
        D,
        f"SELECT {cols(KEY)}, CAST(list_max(ids) AS BIGINT) AS max_id FROM seqs WHERE list_max(ids) >= 5000",
    ),
)
def id_range_violations(spark, sf_dir):
    """Windows that a vocabulary ending before the procedure ids could not hold."""
    bad = wi.id_range_violations(dense(spark, sf_dir).sequences(), 5000)
    return bad.select("person_id", "end_date", "max_id")


@query(
    "id_range_report",
    compose(
        D,
        "SELECT COUNT(*) AS n_windows, CAST(MAX(list_max(ids)) AS BIGINT) AS max_id, CAST(MAX(top) AS BIGINT) AS id_space, "
        "COUNT(*) FILTER (WHERE list_max(ids) >= top) AS n_outside FROM seqs, (SELECT MAX(tid) + 1 AS top FROM vocab)",
    ),
)
def id_range_report(spark, sf_dir):
    """Windows against the size of the study's own vocabulary."""
    s = dense(spark, sf_dir)
    return wi.id_range_report(s.sequences(), s.id_space)


@query(
    "trailing_window",
    compose(
        D,
        "SELECT event_id, s.person_id, kind, " + cols("start_ts:t end_ts:t") + " FROM samples s JOIN "
        "(SELECT person_id, MAX(end_ts) - INTERVAL 1 DAY AS until FROM samples GROUP BY person_id) a ON s.person_id = a.person_id "
        "WHERE start_ts >= until - INTERVAL 7 DAY AND end_ts <= until",
    ),
)
def trailing_window(spark, sf_dir):
    rows = b.samples(spark, sf_dir)
    at = (F.max("end_ts") - F.expr("INTERVAL 1 DAY")).alias("at")
    found = wi.trailing_window(rows, rows.groupBy("person_id").agg(at), 7)
    return found.select("event_id", "person_id", "kind", "start_ts", "end_ts")


@query(
    "person_window",
    compose(
        D,
        f"SELECT {cols('person_id:i end_date:d dt:t val:f')} FROM (SELECT h.person_id, a.end_date, h.dt, h.val FROM hr h "
        "JOIN anchors a ON h.person_id = a.person_id AND h.dt BETWEEN CAST(a.end_date - 7 AS TIMESTAMP) AND CAST(a.end_date AS TIMESTAMP))",
    ),
)
def person_window(spark, sf_dir):
    s = dense(spark, sf_dir)
    found = wi.person_window(s.tables.heart_rate_minute_level, s.anchors(), s.params.window_days)
    return found.select("person_id", "end_date", F.col("datetime").alias("dt"), F.col("heart_rate_value").alias("val"))


@query(
    "enc_sep_sequences",
    compose(
        H,
        "SELECT CAST(person_id AS BIGINT) AS person_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(CAST(x AS VARCHAR), ' ' "
        "ORDER BY visit_id, tid, rn, o) AS ids FROM (SELECT person_id, ts, visit_id, tid, rn, 1 AS o, tid AS x FROM enc UNION ALL "
        "SELECT person_id, ts, visit_id, tid, rn, 0, 4 FROM enc WHERE prev <> visit_id) GROUP BY person_id, ts",
        {
            "enc": "SELECT *, row_number() OVER w AS rn, lag(visit_id) OVER w AS prev FROM dx_tok "
            "WINDOW w AS (PARTITION BY person_id, ts ORDER BY visit_id, tid)"
        },
    ),
)
def enc_sep_sequences(spark, sf_dir):
    s = history(spark, sf_dir)
    visited = s.tables.condition_occurrence.join(s.splits.select("person_id"), "person_id", "left_semi").join(
        s.ids_of("DX10").withColumnRenamed("concept_id", "condition_source_concept_id"), "condition_source_concept_id"
    )
    rows = visited.select(
        "person_id", F.col("condition_start_date").alias("day"), F.col("visit_occurrence_id").alias("visit_id"), "tid"
    )
    return tk.encounter_days(rows)


# --- shards ----------------------------------------------------------------------------------------


@query(
    "shard_counts",
    compose(
        D,
        "SELECT split, CAST(shard AS BIGINT) AS shard, COUNT(*) AS n_windows, CAST(SUM(n_tokens) AS BIGINT) AS n_tokens FROM "
        "(SELECT *, (row_number() OVER (PARTITION BY split ORDER BY md5('shards:' || person_id || ':' || strftime(end_date, '%Y-%m-%d'))) - 1) "
        "// 100 AS shard FROM seqs) GROUP BY split, shard",
    ),
)
def shard_counts(spark, sf_dir):
    path = fresh_path(spark, "shards")
    sinks.write_shards(stage(dense(spark, sf_dir).windows(), "windows"), path, 100)
    back = spark.read.parquet(path)
    return back.groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("n_tokens").alias("n_tokens")
    )


@query(
    "read_split",
    compose(D, f"SELECT {cols(KEY)}, split, n_tokens, CAST(label AS BIGINT) AS label FROM lseqs"),
)
def read_split(spark, sf_dir):
    """Each split read back on its own."""
    path = fresh_path(spark, "shards")
    sinks.write_shards(stage(dense(spark, sf_dir).windows(), "windows"), path)
    out = None
    for split in SPLITS:
        part = sinks.read_split(spark, path, split).select("person_id", "end_date", "split", "n_tokens", "label")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "binary_roundtrip",
    compose(D, f"SELECT {cols(KEY)}, {TEXT}, n_tokens, CAST(label AS BIGINT) AS label FROM lseqs"),
)
def binary_roundtrip(spark, sf_dir):
    rows = dense(spark, sf_dir).windows()
    path = fresh_path(spark, "binary-shards")
    sinks.write_table(sinks.to_binary(rows), path)
    back = sinks.from_binary(sinks.read_table(spark, path, sinks.BINARY_SCHEMA))
    return back.select("person_id", "end_date", "input_ids", "positions", "n_tokens", "label")


@query(
    "batch_assign",
    compose(
        D,
        f"SELECT {cols(KEY)}, split, CAST(o // 32 AS BIGINT) AS batch, CAST(o % 32 AS BIGINT) AS slot FROM (SELECT *, row_number() OVER "
        "(PARTITION BY split ORDER BY md5('7:' || person_id || ':' || strftime(end_date, '%Y-%m-%d'))) - 1 AS o, "
        "COUNT(*) OVER (PARTITION BY split) AS n FROM seqs) WHERE o // 32 < n // 32",
    ),
)
def batch_assign(spark, sf_dir):
    rows = stage(dense(spark, sf_dir).window_index(), "windows")
    batched = sa.batch_assign(rows, ["person_id", "end_date"], 32, 7)
    return batched.select("person_id", "end_date", "split", "batch", "slot")


# --- sampling --------------------------------------------------------------------------------------

TRAIN = {"trainw": "SELECT * FROM lseqs WHERE split = 'train'"}


def _train_windows(spark, sf_dir):
    rows = dense(spark, sf_dir).window_index().where(F.col("split") == "train")
    return stage(rows, "train-windows")


@query(
    "class_weights",
    compose(
        D,
        "SELECT COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos, ROUND(AVG(label), 6) AS pos_rate, CAST(1.0 AS DOUBLE) AS weight_neg, "
        "ROUND(GREATEST(1, (1 - AVG(label)) / GREATEST(AVG(label), 1e-6)), 6) AS weight_pos FROM trainw",
        TRAIN,
    ),
)
def class_weights(spark, sf_dir):
    return sa.class_weights(_train_windows(spark, sf_dir))


_U = "CAST('0x' || substr(md5('{seed}:' || person_id || ':' || strftime(end_date, '%Y-%m-%d')), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(
    "weighted_resample",
    compose(
        D,
        "SELECT CAST(p.person_id AS BIGINT) AS person_id, strftime(p.end_date, '%Y-%m-%d') AS end_date, CAST(p.label AS BIGINT) AS label, "
        "d.draws FROM placed p JOIN (SELECT lab, CAST(floor(u2 * CASE WHEN lab = 1 THEN n_pos ELSE n - n_pos END) AS BIGINT) AS o, "
        "COUNT(*) AS draws FROM drawn GROUP BY ALL) d ON p.label = d.lab AND p.o = d.o",
        {
            **TRAIN,
            "wstat": "SELECT COUNT(*) AS n, SUM(label) AS n_pos, GREATEST(1, (1 - AVG(label)) / GREATEST(AVG(label), 1e-6)) AS w FROM trainw",
            "drawn": f"SELECT CASE WHEN {_U.format(seed='11:class')} < n_pos * w / (n_pos * w + n - n_pos) THEN 1 ELSE 0 END AS lab, "
            f"{_U.format(seed='11:row')} AS u2, n, n_pos FROM trainw JOIN wstat ON TRUE",
            "placed": "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('11:order:' || person_id || ':' || "
            "strftime(end_date, '%Y-%m-%d'))) - 1 AS o FROM trainw",
        },
    ),
)
def weighted_resample(spark, sf_dir):
    drawn = sa.weighted_resample(_train_windows(spark, sf_dir), ["person_id", "end_date"], 11)
    return drawn.select("person_id", "end_date", "label", "draws")


@query(
    "seeded_shuffle",
    compose(
        D,
        f"SELECT {cols(KEY)}, row_number() OVER (ORDER BY md5('3:' || person_id || ':' || strftime(end_date, '%Y-%m-%d'))) - 1 AS ordinal FROM seqs",
    ),
)
def seeded_shuffle(spark, sf_dir):
    rows = stage(dense(spark, sf_dir).window_index(), "windows")
    return sa.seeded_shuffle(rows, ["person_id", "end_date"], 3).select("person_id", "end_date", "ordinal")


@query(
    "head_pos_rate",
    compose(
        D,
        "SELECT COUNT(*) AS n, ROUND(AVG(label), 6) AS pos_rate FROM trainw",
        TRAIN,
    ),
)
def head_pos_rate(spark, sf_dir):
    rows = dense(spark, sf_dir).window_index().where(F.col("split") == "train")
    return sa.head_pos_rate(rows)


def _hash(seed: str, extra: str, bound: int) -> str:
    return f"CAST('0x' || substr(md5('1000:{seed}:' || doc_id || ':' || {extra}), 1, 8) AS BIGINT) % {bound}"


@query(
    "probe_rows",
    "SELECT doc_id, "
    f"(SELECT string_agg(CAST({_hash('ids', 'i', ID_SPACE)} AS VARCHAR), ' ' ORDER BY i) FROM (SELECT unnest(range(64)) AS i)) AS input_ids, "
    f"(SELECT string_agg(CAST({_hash('pos', 'i', 32)} AS VARCHAR), ' ' ORDER BY i) FROM (SELECT unnest(range(64)) AS i)) AS positions, "
    f"CAST(8 + {_hash('len', repr('n'), 56)} AS BIGINT) AS n_real FROM labels",
)
def probe_rows(spark, sf_dir):
    """One random probe per labelled document."""
    keys = b.read(spark, sf_dir, "labels").select("doc_id")
    return sa.probe_rows(keys, ["doc_id"], 64, ID_SPACE, 8, 1000).select("doc_id", "input_ids", "positions", "n_real")
