"""Queries: streaming twins, each run over all available input and compared with its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalstrand.operators import risk as rk
from vitalstrand.operators import scoring as sc
from vitalstrand.operators import signals as sg
from vitalstrand.operators import tokens as tk
from vitalstrand.operators import windows as wi
from vitalstrand.plans.oracle import KINDS, cols, compose
from vitalstrand.plans.q_scoring import BIAS, TREND_SQL, risks, token_weights
from vitalstrand.plans.registry import dense, query
from vitalstrand.session import fresh_path, stage
from vitalstrand.sources import bindings as b
from vitalstrand.streaming import jobs

D = "dense"


def events_stream(spark, sf_dir):
    """``events`` as a stream; event time needs a zoned timestamp for its watermark."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = jobs.read_stream(spark, sf_dir, b.EVENT_SCHEMA, "events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hr_stream(events):
    return events.where(F.col("event_type").isin("click", "view")).select(
        "event_id", F.col("user_id").alias("person_id"), F.col("ts").alias("datetime"), F.col("value").alias("heart_rate_value")
    )


def steps_stream(events):
    return events.where(F.col("event_type") == "view").select(
        "event_id", F.col("user_id").alias("person_id"), F.col("ts").alias("datetime"), F.col("value").alias("steps")
    )


@query("stream_hr_5min", compose(D, f"SELECT {cols('person_id:i ts:t v:f')} FROM hr_bin"))
def stream_hr_5min(spark, sf_dir):
    home = fresh_path(spark, "stream-hr")
    jobs.land(jobs.hr_bins_stream(hr_stream(events_stream(spark, sf_dir))), home, keys=["person_id", "ts"])
    return jobs.current(spark, home, ["person_id", "ts"])


@query("stream_daily_steps", compose(D, f"SELECT {cols('person_id:i day:d v:f')} FROM steps_day"))
def stream_daily_steps(spark, sf_dir):
    home = fresh_path(spark, "stream-steps")
    jobs.land(jobs.steps_daily_stream(steps_stream(events_stream(spark, sf_dir))), home, keys=["person_id", "day"])
    return jobs.current(spark, home, ["person_id", "day"]).select("person_id", "day", "v")


@query("stream_tokens", compose(D, f"SELECT {cols('person_id:i ts:t stream_ord:i tid:i n:i')} FROM tokens"))
def stream_tokens(spark, sf_dir):
    """Tokens from the live stream against the snapshots of cut points, vocabulary and cohort."""
    s = dense(spark, sf_dir)
    persons = s.splits.select("person_id")
    events = events_stream(spark, sf_dir)
    parts = []
    binned = {
        "HR": (jobs.hr_bins_stream(hr_stream(events).join(persons, "person_id", "left_semi")), ["person_id", "ts"]),
        "STEPS": (jobs.steps_daily_stream(steps_stream(events).join(persons, "person_id", "left_semi")), ["person_id", "ts"]),
    }
    for name, (stream, keys) in binned.items():
        home = fresh_path(spark, f"stream-{name.lower()}")
        jobs.land(stream.withColumn("stream", F.lit(name)), home, each=lambda batch, _: sg.encode_deciles(batch, s.cuts), keys=keys)
        parts.append(tk.wearable_tokens(jobs.current(spark, home, keys)))
    t = b.event_tables(spark, sf_dir, events)
    coded = [
        (t.condition_occurrence, "condition_start_date", "condition_source_concept_id", s.ids_of("DX10")),
        (t.procedure_occurrence, "procedure_date", "procedure_concept_id", s.ids_of("PX10")),
    ]
    home = fresh_path(spark, "stream-ehr")
    streams = [
        tk.coded_events(facts.join(persons, "person_id", "left_semi"), day, key, lookup) for facts, day, key, lookup in coded
    ]
    jobs.land(streams[0].unionByName(streams[1]), home, "append")
    parts.append(tk.ehr_tokens(jobs.landed(spark, home).select("person_id", "ts", "token", "tid")))
    return tk.all_tokens(*parts)


LAST = {
    "last_day": "SELECT user_id AS person_id, MAX(CAST(ts AS DATE)) AS end_date FROM events WHERE user_id IN (SELECT person_id FROM splits) GROUP BY user_id",
    "last_tok": "SELECT a.person_id, a.end_date, CAST(t.ts AS DATE) AS day, t.tid, t.n FROM last_day a JOIN tokens t ON a.person_id = t.person_id "
    "AND CAST(t.ts AS DATE) BETWEEN a.end_date - 7 AND a.end_date",
    "last_sum": "SELECT person_id, end_date, SUM(n * weight) AS s, SUM(n) AS c, COUNT(DISTINCT day) AS days FROM last_tok JOIN weights USING (tid) "
    "GROUP BY person_id, end_date",
}
_MARKS = "(s + (SELECT SUM(weight) FROM weights WHERE tid IN (1, 2)) + (days - 1) * (SELECT weight FROM weights WHERE tid = 3)) / (c + days + 1)"


@query(
    "daily_refresh",
    compose(
        D,
        f"SELECT {cols('person_id:i end_date:d')}, ROUND(logit, 6) AS logit, ROUND(1 / (1 + exp(-logit)), 6) AS prob FROM "
        f"(SELECT person_id, end_date, ROUND(-1.0 + {_MARKS}, 9) AS logit FROM last_sum)",
        LAST,
    ),
)
def daily_refresh(spark, sf_dir):
    """Rescore each person whose data changed, on the window ending at their newest day."""
    s = dense(spark, sf_dir)
    p = s.params
    persons = s.splits.select("person_id")
    cuts, dx, px, weights = s.cuts, s.ids_of("DX10"), s.ids_of("PX10"), token_weights(spark)

    def report_for(rows, _touched):
        t = b.event_tables(spark, sf_dir, rows.withColumnRenamed("person_id", "user_id"))
        hr = sg.hr_bins(sg.hr_bin_sums(t.heart_rate_minute_level, p.hr_bin_minutes)).withColumn("stream", F.lit("HR"))
        steps = sg.steps_daily(t.steps_intraday).select("person_id", "ts", "v", F.lit("STEPS").alias("stream"))
        tokens = tk.all_tokens(
            tk.wearable_tokens(sg.encode_deciles(hr.unionByName(steps), cuts)),
            tk.ehr_tokens(
                tk.coded_events(t.condition_occurrence, "condition_start_date", "condition_source_concept_id", dx),
                tk.coded_events(t.procedure_occurrence, "procedure_date", "procedure_concept_id", px),
            ),
        )
        newest = rows.groupBy("person_id").agg(F.max(F.to_date("ts")).alias("first_end")).select(
            "person_id", F.lit("live").alias("split"), "first_end", F.lit(1).alias("stride"), F.lit(0).alias("last_k")
        )
        seqs = wi.window_sequences(wi.day_packs(tokens, p.max_len), newest, p.window_days, p.max_len)
        scored = rk.with_prob(sc.score_windows(seqs, weights, BIAS))
        return scored.select("person_id", "end_date", "logit", "prob")

    home = fresh_path(spark, "refresh")
    live = events_stream(spark, sf_dir).withColumnRenamed("user_id", "person_id").join(persons, "person_id", "left_semi")
    jobs.refresh(live, home, report_for, p.window_days)
    return jobs.current(spark, home, ["person_id"]).select("person_id", "end_date", "logit", "prob")


def shuffled_files(df, key, n, label):
    """The rows of ``df`` in ``n`` folders by hash, so that a stream reading them one by one meets every age in every batch."""
    home = fresh_path(df.sparkSession, label)
    for i in range(n):
        df.where(F.pmod(F.xxhash64(*key), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(home)
    return home


RECONCILED = (
    f"SELECT {cols('person_id:i')}, 'HR' AS stream, {cols('ts:t v:f')} FROM hr_bin UNION ALL "
    f"SELECT {cols('person_id:i')}, 'STEPS' AS stream, {KINDS['t'].format('CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR')} AS ts, {cols('v:f')} FROM steps_day"
)


@query("stream_reconciled", compose(D, RECONCILED))
def stream_reconciled(spark, sf_dir):
    """Bins and daily totals of readings that come in hash order, most of them behind any watermark, a part of them twice."""
    events = spark.read.schema(b.EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    again = events.where(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
    source = shuffled_files(events, ["event_id", "user_id"], 3, "readings")
    again.coalesce(1).write.mode("append").parquet(source)
    schema = b.EVENT_SCHEMA.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("timestamp_ntz", "timestamp")
    parts = []
    for name, pick, bins in (("HR", hr_stream, hr_rebuilt), ("STEPS", steps_stream, steps_rebuilt)):
        home = fresh_path(spark, f"reconcile-{name.lower()}")
        stream = jobs.read_stream(spark, source, schema, files_per_batch=1)
        jobs.reconcile(pick(stream), home, bins, ["person_id", "ts"])
        parts.append(jobs.current(spark, home, ["person_id", "ts"]).select("person_id", F.lit(name).alias("stream"), "ts", "v"))
    return parts[0].unionByName(parts[1])


def hr_rebuilt(readings):
    return sg.hr_bins(sg.hr_bin_sums(readings.dropDuplicates(["event_id"])))


def steps_rebuilt(readings):
    return sg.steps_daily(readings.dropDuplicates(["event_id"])).select("person_id", "ts", "v")


@query("stream_trend", compose(D, TREND_SQL))
def stream_trend(spark, sf_dir):
    """Trend carried as keyed state over a stream of scored windows that come out of order."""
    scored = risks(spark, sf_dir).select("person_id", "end_date", "prob")
    source = shuffled_files(stage(scored, "scored"), ["person_id", "end_date"], 2, "stream-risks")
    stream = jobs.read_stream(spark, source, "person_id BIGINT, end_date DATE, prob DOUBLE", files_per_batch=1)
    home = fresh_path(spark, "stream-trend")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        jobs.land(jobs.risk_trend_stream(stream), home, keys=["person_id", "end_date"])
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return jobs.current(spark, home, ["person_id", "end_date"])
