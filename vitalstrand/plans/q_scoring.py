"""Queries: scoring, metrics, audit and the risk surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalstrand.config import ID_SPACE
from vitalstrand.functions.scalars import bce_with_logits, risk_band, risk_points, sigmoid
from vitalstrand.operators import audit as au
from vitalstrand.operators import metrics as me
from vitalstrand.operators import risk as rk
from vitalstrand.operators import scoring as sc
from vitalstrand.plans.oracle import auroc_sql, average_precision_sql, cols, compose
from vitalstrand.plans.registry import dense, query
from vitalstrand.session import fresh_path, stage
from vitalstrand.sources import bindings as b
from vitalstrand.sources import sinks

D = "dense"
KEY = "person_id:i end_date:d"
BIAS = -1.0
PROB = "1 / (1 + exp(-logit))"
LOSS = "GREATEST(logit, 0) - logit * y + ln(1 + exp(-ABS(logit)))"


def token_weights(spark):
    """Fixed scorer: one weight per id of the id space."""
    return spark.range(ID_SPACE).select(
        F.col("id").cast("int").alias("tid"), (((F.col("id") * 7919) % 1000) / 1000.0 - 0.5).alias("weight")
    )


def scored_windows(spark, sf_dir):
    return dense(spark, sf_dir).scored(token_weights(spark), BIAS)


def risks(spark, sf_dir):
    return rk.with_prob(scored_windows(spark, sf_dir))


# --- scoring ---------------------------------------------------------------------------------------


@query("score_windows", compose(D, f"SELECT {cols(KEY)}, split, {cols('label:i logit:f')} FROM scored"))
def score_windows(spark, sf_dir):
    return scored_windows(spark, sf_dir).select("person_id", "end_date", "split", "label", "logit")


@query("contributions", compose(D, f"SELECT {cols(KEY)}, {cols('tid:i n:i contribution:f')} FROM contrib"))
def contributions(spark, sf_dir):
    parts = sc.contributions(dense(spark, sf_dir).sequences(), token_weights(spark))
    return parts.select("person_id", "end_date", "tid", "n", "contribution")


@query("top_drivers", compose(D, f"SELECT {cols(KEY)}, {cols('rank:i tid:i contribution:f')} FROM drivers"))
def top_drivers(spark, sf_dir):
    parts = sc.contributions(dense(spark, sf_dir).sequences(), token_weights(spark))
    return rk.top_drivers(parts).select("person_id", "end_date", "rank", "tid", "contribution")


@query(
    "window_pooled",
    compose(
        D,
        f"SELECT {cols(KEY)}, dim, ROUND(AVG(x), 6) AS value FROM (SELECT person_id, end_date, unnest(range(64)) AS dim, "
        "CAST(unnest(embedding) AS DOUBLE) AS x FROM kept JOIN embeddings ON vec_id = tid % (SELECT COUNT(*) FROM embeddings)) "
        "GROUP BY person_id, end_date, dim",
    ),
)
def window_pooled(spark, sf_dir):
    """Mean token vector per window, listed by dimension."""
    table = b.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    ids = spark.range(ID_SPACE).select(F.col("id").cast("int").alias("tid"))
    slots = table.agg(F.count(F.lit(1)).alias("size"))
    vec_of = ids.withColumn("_one", F.lit(1)).join(slots.withColumn("_one", F.lit(1)), "_one").select(
        "tid", (F.col("tid") % F.col("size")).alias("vec_id")
    )
    vectors = vec_of.join(table, "vec_id").select("tid", "vec")
    pooled = sc.pooled_vectors(dense(spark, sf_dir).sequences(), vectors, 64)
    return pooled.select("person_id", "end_date", F.posexplode("pooled").alias("dim", "value"))


@query(
    "fit_risk",
    compose(
        D,
        f"SELECT {cols(KEY)}, split, CAST(label AS BIGINT) AS label, ROUND(AVG(COALESCE(weight, 0)), 6) AS logit FROM "
        "(SELECT k.*, l.label FROM kept k JOIN labels_w l ON k.person_id = l.person_id AND k.end_date = l.end_date WHERE k.split <> 'train') r "
        "LEFT JOIN odds ON odds.tid = r.tid GROUP BY person_id, end_date, split, label",
        {
            "odds_n": "SELECT tid, SUM(label) AS pos, SUM(1 - label) AS neg FROM kept k JOIN labels_w l ON k.person_id = l.person_id "
            "AND k.end_date = l.end_date WHERE k.split = 'train' GROUP BY tid",
            "odds": "SELECT tid, ln((pos + 1) / ((SELECT SUM(pos) FROM odds_n) + (SELECT COUNT(*) FROM odds_n))) "
            "- ln((neg + 1) / ((SELECT SUM(neg) FROM odds_n) + (SELECT COUNT(*) FROM odds_n))) AS weight FROM odds_n",
        },
    ),
)
def fit_risk(spark, sf_dir):
    """Fit on training windows, score validation and test windows with the scorer."""
    rows = stage(dense(spark, sf_dir).windows(), "windows")
    scored = sc.score_windows(rows.where(F.col("split") != "train"), sc.fit_log_odds(rows), 0.0, ("label",))
    return scored.select("person_id", "end_date", "split", "label", "logit")


# --- metrics over labelled documents ---------------------------------------------------------------


@query("risk_prob", compose(D, f"SELECT doc_id, ROUND({PROB}, 6) AS prob FROM eval_rows"))
def risk_prob(spark, sf_dir):
    return b.eval_rows(spark, sf_dir).select("doc_id", sigmoid("logit").alias("prob"))


@query(
    "bce_loss",
    compose(
        D,
        f"SELECT doc_id, ROUND({LOSS}, 6) AS loss, ROUND((1 - y) * logit + (1 + 2 * y) * (ln(1 + exp(-ABS(logit))) + GREATEST(-logit, 0)), 6) "
        "AS weighted_loss FROM eval_rows",
    ),
)
def bce_loss(spark, sf_dir):
    return b.eval_rows(spark, sf_dir).select(
        "doc_id", bce_with_logits("logit", "y").alias("loss"), bce_with_logits("logit", "y", 3.0).alias("weighted_loss")
    )


@query(
    "risk_bands",
    compose(
        D,
        f"SELECT doc_id, CAST(floor(100 * ({PROB})) AS BIGINT) AS points, CASE WHEN {PROB} < 0.2 THEN 'low' WHEN {PROB} < 0.5 THEN 'moderate' "
        f"WHEN {PROB} < 0.75 THEN 'elevated' ELSE 'high' END AS band FROM eval_rows",
    ),
)
def risk_bands(spark, sf_dir):
    scored = rk.with_prob(b.eval_rows(spark, sf_dir))
    return scored.select("doc_id", risk_points("prob").alias("points"), risk_band("prob").alias("band"))


@query("auroc", compose(D, f"SELECT lang, ROUND(auroc, 6) AS auroc FROM ({auroc_sql('eval_rows', 'logit', 'y', 'lang')})"))
def auroc(spark, sf_dir):
    return me.auroc(b.eval_rows(spark, sf_dir), "logit", "y", ["lang"])


@query(
    "average_precision",
    compose(D, f"SELECT lang, ROUND(auprc, 6) AS auprc FROM ({average_precision_sql('eval_rows', 'logit', 'y', 'lang')})"),
)
def average_precision(spark, sf_dir):
    return me.average_precision(b.eval_rows(spark, sf_dir), "logit", "y", ["lang"])


def _eval_sql(by: str) -> str:
    return (
        f"SELECT a.{by}, ROUND(auroc, 6) AS auroc, ROUND(auprc, 6) AS auprc, pos_rate, mean_pred_prob, n FROM "
        f"({auroc_sql('eval_rows', 'logit', 'y', by)}) a JOIN ({average_precision_sql('eval_rows', 'logit', 'y', by)}) p ON a.{by} = p.{by} "
        f"JOIN (SELECT {by}, ROUND(AVG(y), 6) AS pos_rate, ROUND(AVG({PROB}), 6) AS mean_pred_prob, COUNT(*) AS n FROM eval_rows "
        f"GROUP BY {by}) s ON a.{by} = s.{by}"
    )


@query("eval_report", compose(D, _eval_sql("lang")))
def eval_report(spark, sf_dir):
    return me.evaluate(b.eval_rows(spark, sf_dir), ["lang"])


@query(
    "best_epoch",
    compose(D, f"SELECT CAST(epoch AS BIGINT) AS epoch, auroc, auprc, n FROM ({_eval_sql('epoch')}) WHERE auroc > 0 ORDER BY auroc DESC, epoch LIMIT 1"),
)
def best_epoch(spark, sf_dir):
    return me.best_epoch(me.evaluate(b.eval_rows(spark, sf_dir), ["epoch"])).select("epoch", "auroc", "auprc", "n")


@query(
    "epoch_loss",
    compose(D, f"SELECT CAST(epoch AS BIGINT) AS epoch, ROUND(AVG({LOSS}), 6) AS train_loss, COUNT(*) AS n_seen FROM eval_rows GROUP BY epoch"),
)
def epoch_loss(spark, sf_dir):
    return me.epoch_loss(b.eval_rows(spark, sf_dir))


@query(
    "calibration",
    compose(
        D,
        "SELECT CAST(epoch AS BIGINT) AS epoch, ROUND(p, 6) AS mean_pred_prob, ROUND(r, 6) AS pos_rate, n, ROUND(ABS(p - r), 6) AS cal_gap, "
        f"CAST(ABS(p - r) > 0.15 AS BIGINT) AS flagged FROM (SELECT epoch, AVG({PROB}) AS p, AVG(y) AS r, COUNT(*) AS n FROM eval_rows GROUP BY epoch)",
    ),
)
def calibration(spark, sf_dir):
    return me.calibration(b.eval_rows(spark, sf_dir), ["epoch"])


@query(
    "report_json",
    compose(
        D,
        "SELECT CAST(epoch AS BIGINT) AS epoch, n, pos_rate FROM (SELECT epoch, COUNT(*) AS n, ROUND(AVG(y), 6) AS pos_rate "
        "FROM eval_rows GROUP BY epoch)",
    ),
)
def report_json(spark, sf_dir):
    """Metrics log, one JSON line per epoch, written and read back."""
    path = fresh_path(spark, "metrics-log")
    sinks.write_report(me.evaluate(b.eval_rows(spark, sf_dir), ["epoch"]), path)
    log = sinks.read_manifest(spark, path, "epoch INT, auroc DOUBLE, auprc DOUBLE, pos_rate DOUBLE, mean_pred_prob DOUBLE, n BIGINT")
    return log.select("epoch", "n", "pos_rate")


@query(
    "score_parity",
    compose(
        D,
        "SELECT COUNT(*) AS n_probes, ROUND(MAX(d), 6) AS max_abs_delta, ROUND(AVG(d), 6) AS mean_abs_delta, "
        "ROUND(quantile_cont(d, 0.95), 6) AS p95_abs_delta, CAST(0.05 AS DOUBLE) AS tolerance, CAST(MAX(d) < 0.05 AS BIGINT) AS passes "
        "FROM (SELECT ABS(logit - ROUND(logit, 2)) AS d FROM eval_rows)",
    ),
)
def score_parity(spark, sf_dir):
    rows = b.eval_rows(spark, sf_dir)
    return au.score_parity(rows, rows.withColumn("logit", F.round("logit", 2)), ["doc_id"])


# --- membership audit ------------------------------------------------------------------------------


@query("person_loss", compose(D, f"SELECT split, {cols('person_id:i loss:f n_windows:i')} FROM losses"))
def person_loss(spark, sf_dir):
    return au.person_loss(scored_windows(spark, sf_dir))


@query(
    "cap_persons",
    compose(
        D,
        f"SELECT {cols(KEY)}, {cols('logit:f')} FROM scored WHERE person_id IN (SELECT DISTINCT person_id FROM scored ORDER BY person_id LIMIT 40)",
    ),
)
def cap_persons(spark, sf_dir):
    scored = stage(scored_windows(spark, sf_dir), "scored")
    return au.cap_persons(scored, 40).select("person_id", "end_date", "logit")


@query(
    "loss_quantiles",
    compose(
        D,
        "SELECT split, COUNT(*) AS n, ROUND(quantile_cont(loss, 0.5), 6) AS median, ROUND(quantile_cont(loss, 0.95), 6) AS p95 "
        "FROM losses GROUP BY split",
    ),
)
def loss_quantiles(spark, sf_dir):
    return au.loss_quantiles(au.person_loss(scored_windows(spark, sf_dir)), "split")


ATTACK = {"attack": "SELECT is_member, ROUND(-loss, 12) AS score FROM capped"}


def _members(spark, sf_dir):
    losses = stage(au.person_loss(scored_windows(spark, sf_dir)), "losses")
    return stage(au.membership(losses), "members")


@query(
    "mia_auroc",
    compose(D, f"SELECT ROUND(auroc, 6) AS auroc FROM ({auroc_sql('attack', 'score', 'is_member')})", ATTACK),
)
def mia_auroc(spark, sf_dir):
    return au.attack_auroc(_members(spark, sf_dir))


@query(
    "mia_audit",
    compose(
        D,
        "SELECT n1 AS n_train_members, n0 AS n_val_nonmembers, ROUND(auroc, 6) AS mia_holdout_auroc, ROUND(m0 - m1, 6) AS median_loss_diff, "
        "ROUND(p0 - p1, 6) AS p95_loss_diff, CAST(0.55 AS DOUBLE) AS max_auroc, CAST(0.02 AS DOUBLE) AS max_p95_diff, "
        "CAST(auroc < 0.55 AND ABS(p0 - p1) < 0.02 AS BIGINT) AS passes FROM (SELECT COUNT(*) FILTER (WHERE is_member = 1) AS n1, "
        "COUNT(*) FILTER (WHERE is_member = 0) AS n0, quantile_cont(loss, 0.5) FILTER (WHERE is_member = 1) AS m1, "
        "quantile_cont(loss, 0.5) FILTER (WHERE is_member = 0) AS m0, quantile_cont(loss, 0.95) FILTER (WHERE is_member = 1) AS p1, "
        f"quantile_cont(loss, 0.95) FILTER (WHERE is_member = 0) AS p0 FROM capped), ({auroc_sql('attack', 'score', 'is_member')})",
        ATTACK,
    ),
)
def mia_audit(spark, sf_dir):
    return au.mia_audit(_members(spark, sf_dir))


# --- risk surface ----------------------------------------------------------------------------------

TREND_SQL = (
    f"SELECT {cols(KEY)}, ROUND(prob, 6) AS prob, ROUND(COALESCE(prob - lag(prob) OVER (PARTITION BY person_id ORDER BY end_date), 0), 6) "
    "AS trend_delta FROM risks"
)


@query("risk_trend", compose(D, TREND_SQL))
def risk_trend(spark, sf_dir):
    return rk.risk_trend(risks(spark, sf_dir)).select("person_id", "end_date", "prob", "trend_delta")


@query(
    "risk_percentile",
    compose(
        D,
        f"SELECT {cols(KEY)}, ROUND(prob, 6) AS prob, CAST(LEAST(99, (SELECT COUNT(*) FROM risks t WHERE t.split = 'train' AND t.prob <= r.prob) * 100 "
        "// (SELECT COUNT(*) FROM risks WHERE split = 'train')) AS BIGINT) AS percentile FROM risks r",
    ),
)
def risk_percentile(spark, sf_dir):
    rows = stage(risks(spark, sf_dir), "risks")
    cuts = rk.percentile_cuts(rows.where(F.col("split") == "train"))
    return rk.risk_percentile(rows, cuts).select("person_id", "end_date", "prob", "percentile")


@query(
    "risk_sparkline",
    compose(
        D,
        f"SELECT {cols('a.person_id:i a.end_date:d').replace('AS a.', 'AS ')}, string_agg(CAST(CAST(round(b.prob * 1000000) AS BIGINT) AS VARCHAR), ' ' "
        "ORDER BY b.end_date) AS sparkline FROM risks a JOIN risks b ON a.person_id = b.person_id AND b.end_date BETWEEN a.end_date - 9 AND a.end_date "
        "GROUP BY a.person_id, a.end_date",
    ),
)
def risk_sparkline(spark, sf_dir):
    """Risks of the last ten days, in millionths."""
    lines = rk.risk_sparkline(risks(spark, sf_dir), 10)
    micro = F.transform("sparkline", lambda p: F.round(p * 1_000_000).cast("long"))
    return lines.select("person_id", "end_date", micro.alias("sparkline"))


_POINTS = "CAST(round_even(delta * 100, 0) AS BIGINT)"
_SIGN = f"CASE WHEN {_POINTS} < 0 OR ({_POINTS} = 0 AND delta < 0) THEN '-' ELSE '+' END"
TREND_TEXT = f"{_SIGN} || ABS({_POINTS}) || ' points since the window before'"
REPORT_TEXT = (
    "'Estimated 30-day risk: ' || CAST(floor(prob * 100) AS BIGINT) || ' of 100 points.' || chr(10) || 'Strongest factors in this window:' || "
    "chr(10) || bullets || chr(10) || 'An estimate from recorded data and no diagnosis; talk to a clinician about it.'"
)
REPORT = {
    "rows_r": "SELECT person_id, end_date, prob, COALESCE(prob - lag(prob) OVER (PARTITION BY person_id ORDER BY end_date), 0) AS delta FROM risks",
    "listed": "SELECT person_id, end_date, string_agg('• token ' || tid, chr(10) ORDER BY rank) AS bullets, "
    "string_agg('token ' || tid, ' ' ORDER BY rank) AS labels FROM drivers GROUP BY person_id, end_date",
    "full_r": "SELECT r.*, bullets, labels FROM rows_r r JOIN listed l ON r.person_id = l.person_id AND r.end_date = l.end_date",
}


def reports(spark, sf_dir):
    rows = stage(dense(spark, sf_dir).windows(), "windows")
    weights = token_weights(spark)
    scored = rk.with_prob(sc.score_windows(rows, weights, BIAS))
    drivers = rk.top_drivers(sc.contributions(rows, weights)).withColumn(
        "label", F.concat(F.lit("token "), F.col("tid").cast("string"))
    )
    return rk.risk_report(scored, drivers)


@query("risk_text", compose(D, f"SELECT {cols(KEY)}, {TREND_TEXT} AS trend_text, {REPORT_TEXT} AS text FROM full_r", REPORT))
def risk_text(spark, sf_dir):
    return reports(spark, sf_dir).select("person_id", "end_date", "trend_text", "text")


@query(
    "risk_report",
    compose(
        D,
        f"SELECT {cols(KEY)}, ROUND(prob, 6) AS risk_score, CAST(floor(prob * 100) AS BIGINT) AS points, CASE WHEN prob < 0.2 THEN 'low' "
        "WHEN prob < 0.5 THEN 'moderate' WHEN prob < 0.75 THEN 'elevated' ELSE 'high' END AS band, ROUND(delta, 6) AS trend_delta, labels FROM full_r",
        REPORT,
    ),
)
def risk_report(spark, sf_dir):
    rows = reports(spark, sf_dir)
    return rows.select(
        "person_id",
        "end_date",
        "risk_score",
        "points",
        "band",
        "trend_delta",
        F.transform("top_features", lambda d: d["label"]).alias("labels"),
    )
