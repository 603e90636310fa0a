"""Queries: binned signals, deciles and code tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalstrand.operators import signals as sg
from vitalstrand.operators import tokens as tk
from vitalstrand.operators import windows as wi
from vitalstrand.plans.oracle import bigints, cols, compose
from vitalstrand.plans.registry import dense, history, query
from vitalstrand.session import stage
from vitalstrand.sources import bindings as b

H, D = "history", "dense"


@query("hr_5min", compose(D, f"SELECT {cols('person_id:i ts:t v:f')} FROM hr_bin"))
def hr_5min(spark, sf_dir):
    return sg.hr_bins(sg.hr_bin_sums(dense(spark, sf_dir).tables.heart_rate_minute_level))


@query("hr_ref_pooled", compose(D, f"SELECT {cols('person_id:i day:d slot:i v:f')} FROM hr_pool"))
def hr_ref_pooled(spark, sf_dir):
    return sg.hr_pooled(sg.hr_bin_sums(dense(spark, sf_dir).tables.heart_rate_minute_level))


@query("steps_daily", compose(H, f"SELECT {cols('person_id:i day:d ts:t v:f')} FROM steps_day"))
def steps_daily(spark, sf_dir):
    return sg.steps_daily(history(spark, sf_dir).tables.steps_intraday).select("person_id", "day", "ts", "v")


@query(
    "daily_totals_filled",
    compose(
        D,
        "SELECT CAST(d.person_id AS BIGINT) AS person_id, strftime(d.day, '%Y-%m-%d') AS day, ROUND(COALESCE(s.v, 0), 6) AS v FROM "
        "(SELECT person_id, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM "
        "(SELECT person_id, MIN(CAST(dt AS DATE)) AS first_day, MAX(CAST(dt AS DATE)) AS last_day FROM hr GROUP BY person_id)) d "
        "LEFT JOIN steps_day s ON d.person_id = s.person_id AND d.day = s.day",
    ),
)
def daily_totals_filled(spark, sf_dir):
    t = dense(spark, sf_dir).tables
    spans = t.heart_rate_minute_level.groupBy("person_id").agg(
        F.min(F.to_date("datetime")).alias("first_day"), F.max(F.to_date("datetime")).alias("last_day")
    )
    return sg.daily_totals_filled(t.steps_intraday, spans)


_CUTS = "arr[(n * {d} + 9) // 10] AS c{d}"


@query("decile_cuts", compose(H, f"SELECT stream, n, {bigints(10, _CUTS)} FROM ref_list"))
def decile_cuts(spark, sf_dir):
    cuts = history(spark, sf_dir).cuts
    return cuts.select("stream", "n", *[F.col("cuts")[d - 1].alias(f"c{d}") for d in range(1, 10)])


@query(
    "decile_cuts_hourly",
    compose(
        D,
        f"SELECT stream, n, {bigints(10, _CUTS)} FROM (SELECT 'HR' AS stream, COUNT(*) AS n, list(v ORDER BY v) AS arr FROM hr_bin "
        "WHERE person_id IN (SELECT person_id FROM ref_person))",
    ),
)
def decile_cuts_hourly(spark, sf_dir):
    """The consistent variant: the reference is binned with the hour, as the encoder is."""
    s = dense(spark, sf_dir, pool_hours=False)
    cuts = s.cuts.where(F.col("stream") == "HR")
    return cuts.select("stream", "n", *[F.col("cuts")[d - 1].alias(f"c{d}") for d in range(1, 10)])


@query("hr_deciles", compose(D, f"SELECT {cols('person_id:i ts:t v:f dec:i')} FROM hr_dec"))
def hr_deciles(spark, sf_dir):
    return dense(spark, sf_dir).hr_deciles()


@query("steps_deciles", compose(H, f"SELECT {cols('person_id:i ts:t v:f dec:i')} FROM steps_dec"))
def steps_deciles(spark, sf_dir):
    return history(spark, sf_dir).steps_deciles().select("person_id", "ts", "v", "dec")


@query(
    "reference_summary",
    compose(
        H,
        "SELECT stream, n, arr[n // 10 + 1] AS q10, arr[n // 2 + 1] AS q50, arr[9 * n // 10 + 1] AS q90 FROM ref_list",
    ),
)
def reference_summary(spark, sf_dir):
    return sg.reference_summary(history(spark, sf_dir).reference()).select("stream", "n", "q10", "q50", "q90")


@query(
    "self_deciles",
    compose(
        D,
        f"SELECT {cols('person_id:i end_date:d v:f')}, CAST(n AS BIGINT) AS n, CAST(LEAST(9, below * 10 // total) AS BIGINT) AS dec FROM "
        "(SELECT person_id, end_date, v, COUNT(*) AS n, MIN(r) - 1 AS below, MIN(total) AS total FROM "
        "(SELECT a.person_id, a.end_date, h.v, rank() OVER (PARTITION BY a.person_id, a.end_date ORDER BY h.v) AS r, "
        "COUNT(*) OVER (PARTITION BY a.person_id, a.end_date) AS total FROM anchors a JOIN hr_bin h ON a.person_id = h.person_id "
        "AND CAST(h.ts AS DATE) BETWEEN a.end_date - 7 AND a.end_date) GROUP BY person_id, end_date, v)",
    ),
)
def self_deciles(spark, sf_dir):
    s = dense(spark, sf_dir)
    binned = sg.hr_bins(s.hr_sums).withColumn("day", F.to_date("ts"))
    per_window = wi.in_windows(binned, s.calendar(), s.params.window_days)
    return sg.self_deciles(per_window, ["person_id", "end_date"])


HRV_MINUTES = 4320


@query(
    "hrv_proxy",
    compose(
        D,
        f"SELECT {cols('person_id:i day:d v:f')}, CAST(LEAST(9, COALESCE((SELECT COUNT(*) FROM hrv r WHERE r.v <= h.v "
        "AND r.person_id IN (SELECT person_id FROM train)), 0) * 10 // (SELECT COUNT(*) FROM hrv WHERE person_id IN "
        "(SELECT person_id FROM train))) AS BIGINT) AS dec FROM hrv h",
        {
            "hrv": "SELECT person_id, day, ROUND(AVG(sd), 6) AS v FROM (SELECT person_id, CAST(dt AS DATE) AS day, stddev_samp(val) OVER "
            f"(PARTITION BY person_id ORDER BY dt RANGE BETWEEN INTERVAL {HRV_MINUTES} MINUTE PRECEDING AND CURRENT ROW) AS sd FROM hr) "
            "WHERE sd IS NOT NULL GROUP BY person_id, day",
        },
    ),
)
def hrv_proxy(spark, sf_dir):
    s = dense(spark, sf_dir)
    daily = stage(sg.hrv_daily(s.tables.heart_rate_minute_level, HRV_MINUTES), "hrv")
    named = daily.withColumn("stream", F.lit("HRV"))
    cuts = stage(sg.decile_cuts(s.training(named)), "hrv-cuts")
    return sg.encode_deciles(named, cuts).select("person_id", "day", "v", "dec")


# --- tokens ----------------------------------------------------------------------------------------


@query(
    "ehr_token_ids",
    compose(H, f"SELECT {cols('person_id:i ts:t token:s tid:i')} FROM dx_tok"),
)
def ehr_token_ids(spark, sf_dir):
    return history(spark, sf_dir).condition_tokens()


@query("ehr_tokens", compose(H, f"SELECT {cols('person_id:i ts:t stream_ord:i tid:i n:i')} FROM ehr_tok"))
def ehr_tokens(spark, sf_dir):
    return history(spark, sf_dir).ehr_tokens()


@query("all_tokens", compose(H, f"SELECT {cols('person_id:i ts:t stream_ord:i tid:i n:i')} FROM tokens"))
def all_tokens(spark, sf_dir):
    return history(spark, sf_dir).tokens()


@query(
    "med_tokens",
    compose(
        H,
        f"SELECT {cols('person_id:i ts:t tid:i')}, COUNT(*) AS n FROM (SELECT person_id, CAST(day AS TIMESTAMP) AS ts, "
        "COALESCE(tid, 5) AS tid FROM drug JOIN medc USING (concept_id) LEFT JOIN vocab USING (token) "
        "WHERE person_id IN (SELECT person_id FROM splits)) GROUP BY ALL",
    ),
)
def med_tokens(spark, sf_dir):
    return tk.ehr_tokens(history(spark, sf_dir).medication_tokens()).select("person_id", "ts", "tid", "n")


@query(
    "lab_deciles",
    compose(
        H,
        "SELECT CAST(l.person_id AS BIGINT) AS person_id, strftime(day, '%Y-%m-%d') AS day, l.item, ROUND(l.v, 6) AS v, "
        "CAST(CASE WHEN le IS NULL THEN 0 ELSE LEAST(9, le * 10 // n) END AS BIGINT) AS dec, "
        "'LAB:' || l.item || '_D' || CAST(CASE WHEN le IS NULL THEN 0 ELSE LEAST(9, le * 10 // n) END AS BIGINT) AS token FROM "
        "(SELECT * FROM labres WHERE item IN (SELECT item FROM labcum)) l ASOF LEFT JOIN labcum r ON l.item = r.item AND l.v >= r.rv",
        {
            "labres": "SELECT person_id, day, concept_code AS item, val AS v FROM meas JOIN labc USING (concept_id) "
            "WHERE person_id IN (SELECT person_id FROM splits)",
            "labcum": "SELECT item, v AS rv, SUM(COUNT(*)) OVER (PARTITION BY item ORDER BY v) AS le, "
            "SUM(COUNT(*)) OVER (PARTITION BY item) AS n FROM labres WHERE person_id IN (SELECT person_id FROM train) GROUP BY item, v",
        },
    ),
)
def lab_deciles(spark, sf_dir):
    from vitalstrand.operators import vocab as vo

    s = history(spark, sf_dir)
    t = s.tables
    coded = vo.with_codes(
        s.members(t.measurement).where(F.col("value_as_number").isNotNull()),
        "measurement_concept_id",
        vo.lab_concepts(t.concept, s.lab_prefixes),
    )
    results = stage(
        coded.select(
            "person_id",
            F.col("measurement_date").alias("ts"),
            F.col("concept_code").alias("item"),
            F.col("value_as_number").alias("v"),
        ),
        "lab-results",
    )
    cuts = tk.lab_cuts(s.training(results))
    return tk.lab_deciles(results, cuts).withColumnRenamed("ts", "day")


@query(
    "sleep_pct",
    compose(
        D,
        "SELECT person_id, strftime(night, '%Y-%m-%d') AS night, CAST(rem * 100 // asleep AS BIGINT) AS rem_pct, "
        "CAST(deep * 100 // asleep AS BIGINT) AS deep_pct, 'SLEEP_REM_' || CAST(rem * 100 // asleep AS BIGINT) AS rem_token, "
        "'SLEEP_DEEP_' || CAST(deep * 100 // asleep AS BIGINT) AS deep_token FROM (SELECT user_id AS person_id, "
        "CAST(ts + INTERVAL 12 HOUR AS DATE) AS night, SUM(CASE WHEN k % 4 = 3 THEN (k + 1) * 60 ELSE 0 END) AS rem, "
        "SUM(CASE WHEN k % 4 = 2 THEN (k + 1) * 60 ELSE 0 END) AS deep, SUM(CASE WHEN k % 4 <> 0 THEN (k + 1) * 60 END) AS asleep "
        "FROM ev_k WHERE event_type = 'view' GROUP BY ALL) WHERE asleep IS NOT NULL",
    ),
)
def sleep_pct(spark, sf_dir):
    return sg.sleep_percent(b.sleep_segments(spark, sf_dir))


@query(
    "ecg_tokens",
    compose(
        D,
        f"SELECT user_id AS person_id, {cols('ts:t')}, CASE WHEN k < 10 THEN 'ECG_AFIB' ELSE 'ECG_NORMAL' END AS token, "
        "CAST(CASE WHEN k < 10 THEN 160 ELSE 161 END AS BIGINT) AS tid FROM ev_k WHERE event_type = 'error'",
    ),
)
def ecg_tokens(spark, sf_dir):
    return tk.ecg_tokens(b.ecg_records(spark, sf_dir))
