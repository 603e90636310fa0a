"""SQL texts that state the expected result of each query, written as composable named subqueries.

They follow the definitions directly (range joins, rank counts, element lists) rather than the plans the
operators use, so agreement checks the operators and not a shared trick.
"""

from __future__ import annotations

import re

from vitalstrand.config import ID_RANGES, SPECIAL_TOKENS
from vitalstrand.sources.bindings import CODESETS, HISTORY_PARAMS, LAB_PREFIXES, STREAM_PARAMS

KINDS = {
    "i": "CAST({0} AS BIGINT)",
    "f": "ROUND(CAST({0} AS DOUBLE), 6)",
    "d": "strftime({0}, '%Y-%m-%d')",
    "t": "strftime(CAST({0} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')",
    "s": "{0}",
}


def cols(spec: str) -> str:
    """``"a:i b:d"`` -> typed select list."""
    out = []
    for part in spec.split():
        name, kind = part.split(":")
        out.append(f"{KINDS[kind].format(name)} AS {name}")
    return ", ".join(out)


def bigints(n: int, template: str) -> str:
    return ", ".join(template.format(d=d) for d in range(1, n))


SOURCES = {
    "history": {
        "hr": "SELECT o_custkey AS person_id, o_orderdate AS dt, o_totalprice AS val FROM orders",
        "li": "SELECT l.*, o.o_custkey AS person_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
        "steps": "SELECT person_id, l_shipdate AS dt, l_quantity AS val FROM li",
        "cond": "SELECT person_id, CAST(l_shipdate AS DATE) AS day, l_partkey AS concept_id, l_orderkey AS visit_id "
        "FROM li WHERE l_returnflag IN ('A', 'R')",
        "proc": "SELECT person_id, CAST(l_shipdate AS DATE) AS day, l_partkey AS concept_id FROM li WHERE l_returnflag = 'N'",
        "drug": "SELECT person_id, CAST(l_shipdate AS DATE) AS day, l_partkey AS concept_id FROM li WHERE l_linestatus = 'F'",
        "meas": "SELECT person_id, CAST(l_shipdate AS DATE) AS day, l_partkey AS concept_id, l_extendedprice AS val "
        "FROM li WHERE l_linestatus = 'O'",
        "visit": "SELECT o_orderkey AS visit_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 9201 WHEN '2' THEN 9203 "
        "WHEN '3' THEN 262 ELSE 9202 END AS visit_concept_id, CAST(o_orderdate AS DATE) AS visit_start_date, "
        "CAST(o_orderdate AS DATE) + 2 AS visit_end_date FROM orders",
        "death": "SELECT o_custkey AS person_id, MAX(CAST(o_orderdate AS DATE)) AS death_date, o_custkey AS cause_concept_id "
        "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY o_custkey",
    },
    "dense": {
        "ev_k": "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "hr": "SELECT user_id AS person_id, ts AS dt, value AS val FROM events WHERE event_type IN ('click', 'view')",
        "steps": "SELECT user_id AS person_id, ts AS dt, value AS val FROM events WHERE event_type = 'view'",
        "cond": "SELECT user_id AS person_id, CAST(ts AS DATE) AS day, k AS concept_id, CAST(NULL AS BIGINT) AS visit_id "
        "FROM ev_k WHERE event_type IN ('purchase', 'error')",
        "proc": "SELECT user_id AS person_id, CAST(ts AS DATE) AS day, k AS concept_id FROM ev_k WHERE event_type = 'signup'",
        "drug": "SELECT person_id, day, concept_id FROM proc WHERE FALSE",
        "meas": "SELECT person_id, day, concept_id, 0.0 AS val FROM proc WHERE FALSE",
        "visit": "SELECT CAST(NULL AS BIGINT) AS visit_id, CAST(NULL AS BIGINT) AS visit_concept_id, "
        "CAST(NULL AS DATE) AS visit_start_date, CAST(NULL AS DATE) AS visit_end_date FROM events WHERE FALSE",
    },
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in rows)


def _lab_filter() -> str:
    return " OR ".join(f"concept_code LIKE '{p}%'" for p in LAB_PREFIXES)


def subqueries(binding: str, **over) -> dict[str, str]:
    base = HISTORY_PARAMS if binding == "history" else STREAM_PARAMS
    p = base.with_(**over)
    prefixes = [(name, x) for name, xs in CODESETS.items() for x in xs]
    ranges = _values([(s, lo, hi) for s, (lo, hi) in ID_RANGES.items()])
    specials = _values([(t, i) for t, i in SPECIAL_TOKENS.items()])
    strides = _values(list(p.stride_days.items()))
    w, look, cap = p.window_days, p.lookahead_days, p.max_len
    age = "" if p.min_age is None else f" WHERE age >= {p.min_age}"
    share_test = f"(n * {p.test_percent} + 99) // 100"
    rest = 100 - p.test_percent
    share_val = f"((n - n_test) * {p.val_percent} + {rest - 1}) // {rest}"
    return {
        **SOURCES[binding],
        "concept": "SELECT p_partkey AS concept_id, substr(p_type, 1, 1) || lpad(substr(p_brand, 7), 2, '0') || '.' || p_size "
        "AS concept_code, CASE p_partkey % 4 WHEN 2 THEN 'ICD10PCS' WHEN 3 THEN 'LOINC' ELSE 'ICD10CM' END AS vocabulary_id "
        "FROM part UNION ALL SELECT DISTINCT 1000000 + p_partkey % 50, 'C' || lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0') "
        "|| 'A' || CASE WHEN p_partkey % 5 = 0 THEN 'B' ELSE '' END, 'ATC' FROM part",
        "ancestor": "SELECT 1000000 + p_partkey % 50 AS anc, p_partkey AS concept_id FROM part "
        "UNION SELECT 1000000 + (p_partkey * 7) % 50, p_partkey FROM part",
        "person": "SELECT c_custkey AS person_id, 1930 + c_custkey % 60 AS year_of_birth FROM customer",
        "codeset": f"SELECT * FROM (VALUES {_values(prefixes)}) t(name, prefix)",
        "endpoint": "SELECT DISTINCT name, concept_id FROM concept JOIN codeset ON concept_code LIKE prefix || '%' "
        "WHERE vocabulary_id = 'ICD10CM'",
        "endpoint_ids": "SELECT DISTINCT concept_id FROM endpoint",
        "span": "SELECT person_id, MIN(dt) AS fitbit_start, MAX(dt) AS fitbit_end FROM hr GROUP BY person_id",
        "long_span": "SELECT * FROM span WHERE date_diff('day', CAST(fitbit_start AS DATE), CAST(fitbit_end AS DATE)) "
        f">= {p.min_span_days}",
        "ehr": "SELECT DISTINCT person_id FROM cond",
        "aged": "SELECT s.*, year_of_birth, year(fitbit_start) - year_of_birth AS age FROM long_span s "
        "JOIN ehr USING (person_id) JOIN person USING (person_id)",
        "cohort": "SELECT person_id, fitbit_start, fitbit_end, year_of_birth, age AS age_at_fitbit_start FROM aged" + age,
        "endcond": "SELECT * FROM cond WHERE concept_id IN (SELECT concept_id FROM endpoint_ids)",
        "ev_visit": "SELECT c.person_id, c.day AS condition_start_date, c.concept_id AS condition_concept_id, "
        "v.visit_concept_id, v.visit_start_date, v.visit_end_date, CASE WHEN v.visit_concept_id IN (9201, 9203, 262) "
        "THEN 'inpatient' ELSE 'outpatient' END AS encounter_type FROM endcond c LEFT JOIN visit v ON v.visit_id = c.visit_id",
        "ev": "SELECT e.*, CAST(condition_start_date AS TIMESTAMP) AS event_date, fitbit_start, fitbit_end "
        "FROM ev_visit e JOIN cohort USING (person_id)",
        "ev_after": "SELECT * FROM ev WHERE event_date >= fitbit_start",
        "flagged": "SELECT c.*, CASE WHEN e.person_id IS NULL THEN 0 ELSE 1 END AS has_event FROM cohort c "
        "LEFT JOIN (SELECT DISTINCT person_id FROM ev_after) e USING (person_id)",
        "ranked": f"SELECT *, row_number() OVER (PARTITION BY has_event ORDER BY md5('{p.split_seed}:' || person_id)) - 1 "
        "AS ordinal, COUNT(*) OVER (PARTITION BY has_event) AS n FROM flagged",
        "ranked_test": f"SELECT *, {share_test} AS n_test FROM ranked",
        "splits": f"SELECT * EXCLUDE (ordinal, n, n_test), CASE WHEN ordinal < n_test THEN 'test' WHEN ordinal < n_test + {share_val} "
        "THEN 'val' ELSE 'train' END AS split FROM ranked_test",
        "train": "SELECT person_id FROM splits WHERE split = 'train'",
        "ref_person": f"SELECT person_id FROM train",
        "hr_pool": f"SELECT person_id, CAST(dt AS DATE) AS day, minute(dt) // {p.hr_bin_minutes} AS slot, "
        "ROUND(AVG(val), 9) AS v FROM hr GROUP BY ALL",
        "hr_bin": f"SELECT person_id, date_trunc('hour', dt) + to_minutes(CAST((minute(dt) // {p.hr_bin_minutes}) * "
        f"{p.hr_bin_minutes} AS BIGINT)) AS ts, ROUND(AVG(val), 9) AS v FROM hr GROUP BY ALL",
        "steps_day": "SELECT person_id, CAST(dt AS DATE) AS day, CAST(CAST(dt AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS ts, "
        "ROUND(SUM(val), 9) AS v FROM steps GROUP BY ALL",
        "ref": "SELECT 'HR' AS stream, v FROM hr_pool WHERE person_id IN (SELECT person_id FROM ref_person) UNION ALL "
        "SELECT 'STEPS', v FROM steps_day WHERE person_id IN (SELECT person_id FROM ref_person)",
        "ref_list": "SELECT stream, COUNT(*) AS n, list(v ORDER BY v) AS arr FROM ref GROUP BY stream",
        "ref_cum": "SELECT stream, v AS rv, SUM(COUNT(*)) OVER (PARTITION BY stream ORDER BY v) AS le, "
        "SUM(COUNT(*)) OVER (PARTITION BY stream) AS n FROM ref GROUP BY stream, v",
        "hr_dec": "SELECT h.*, CAST(CASE WHEN le IS NULL THEN 0 ELSE LEAST(9, le * 10 // n) END AS BIGINT) AS dec FROM "
        "(SELECT *, 'HR' AS stream FROM hr_bin WHERE person_id IN (SELECT person_id FROM splits)) h "
        "ASOF LEFT JOIN ref_cum r ON h.stream = r.stream AND h.v >= r.rv",
        "steps_dec": "SELECT h.*, CAST(CASE WHEN le IS NULL THEN 0 ELSE LEAST(9, le * 10 // n) END AS BIGINT) AS dec FROM "
        "(SELECT *, 'STEPS' AS stream FROM steps_day WHERE person_id IN (SELECT person_id FROM splits)) h "
        "ASOF LEFT JOIN ref_cum r ON h.stream = r.stream AND h.v >= r.rv",
        "dxc": "SELECT concept_id, 'DX10:' || substr(concept_code, 1, 3) AS token FROM concept WHERE vocabulary_id = 'ICD10CM'",
        "pxc": "SELECT concept_id, 'PX10:' || substr(concept_code, 1, 3) AS token FROM concept WHERE vocabulary_id = 'ICD10PCS'",
        "labc": "SELECT concept_id, concept_code, 'LAB:' || concept_code AS token FROM concept WHERE vocabulary_id = 'LOINC' "
        f"AND ({_lab_filter()})",
        "medc": "SELECT a.concept_id, c.concept_code, 'MED:' || c.concept_code AS token FROM ancestor a "
        "JOIN concept c ON a.anc = c.concept_id WHERE vocabulary_id = 'ATC' AND length(c.concept_code) = 4",
        "records": "SELECT 'DX10' AS stream, person_id, token FROM cond JOIN dxc USING (concept_id) UNION ALL "
        "SELECT 'PX10', person_id, token FROM proc JOIN pxc USING (concept_id) UNION ALL "
        "SELECT 'MED', person_id, token FROM drug JOIN medc USING (concept_id) UNION ALL "
        "SELECT 'LAB', person_id, token FROM meas JOIN labc USING (concept_id)",
        "token_counts": "SELECT stream, token, COUNT(*) AS n FROM records WHERE person_id IN (SELECT person_id FROM train) "
        "GROUP BY stream, token",
        "id_ranges": f"SELECT * FROM (VALUES {ranges}) t(stream, lo, hi)",
        "token_rank": "SELECT t.*, row_number() OVER (PARTITION BY t.stream ORDER BY n DESC, token) AS rank FROM token_counts t",
        "vocab": f"SELECT token, tid, 'SPECIAL' AS stream, CAST(NULL AS BIGINT) AS n FROM (VALUES {specials}) t(token, tid) "
        "UNION ALL SELECT token, lo + rank - 1, r.stream, n FROM token_rank r JOIN id_ranges i ON r.stream = i.stream "
        "WHERE rank <= hi - lo + 1",
        "dx_tok": "SELECT person_id, CAST(day AS TIMESTAMP) AS ts, visit_id, token, COALESCE(tid, 5) AS tid FROM cond "
        "JOIN dxc USING (concept_id) LEFT JOIN vocab USING (token) WHERE person_id IN (SELECT person_id FROM splits)",
        "px_tok": "SELECT person_id, CAST(day AS TIMESTAMP) AS ts, token, COALESCE(tid, 5) AS tid FROM proc "
        "JOIN pxc USING (concept_id) LEFT JOIN vocab USING (token) WHERE person_id IN (SELECT person_id FROM splits)",
        "ehr_tok": "SELECT person_id, ts, 3 AS stream_ord, tid, COUNT(*) AS n FROM (SELECT person_id, ts, tid FROM dx_tok "
        "UNION ALL SELECT person_id, ts, tid FROM px_tok) GROUP BY person_id, ts, tid",
        "tokens": "SELECT person_id, ts, 0 AS stream_ord, 100 + dec AS tid, 1 AS n FROM hr_dec UNION ALL "
        "SELECT person_id, ts, 1, 110 + dec, 1 FROM steps_dec UNION ALL SELECT person_id, ts, stream_ord, tid, n FROM ehr_tok",
        "strides": f"SELECT * FROM (VALUES {strides}) t(split, stride)",
        "calendar": f"SELECT person_id, s.split, CAST(fitbit_start AS DATE) + {w} AS first_end, stride, "
        f"date_diff('day', CAST(fitbit_start AS DATE) + {w}, CAST(fitbit_end AS DATE) - {look}) AS room "
        "FROM splits s JOIN strides t ON s.split = t.split",
        "anchors": "SELECT person_id, split, CAST(first_end + CAST(k * stride AS INTEGER) AS DATE) AS end_date FROM "
        "(SELECT *, unnest(range(0, room // stride + 1)) AS k FROM calendar WHERE room >= 0)",
        "wtok": "SELECT a.person_id, a.split, a.end_date, CAST(t.ts AS DATE) AS day, t.ts, t.stream_ord, t.tid, t.n "
        "FROM anchors a JOIN tokens t ON a.person_id = t.person_id "
        f"AND CAST(t.ts AS DATE) BETWEEN a.end_date - {w} AND a.end_date",
        "positives": "SELECT DISTINCT a.person_id, a.end_date FROM anchors a JOIN endcond e ON a.person_id = e.person_id "
        f"AND e.day BETWEEN a.end_date + 1 AND a.end_date + {look}",
        "labels_w": "SELECT a.*, CASE WHEN x.person_id IS NULL THEN 0 ELSE 1 END AS label FROM anchors a "
        "LEFT JOIN positives x ON a.person_id = x.person_id AND a.end_date = x.end_date",
        "wpos": "SELECT person_id, split, end_date, day, ts, stream_ord, tid, "
        "dense_rank() OVER (PARTITION BY person_id, end_date ORDER BY day) - 1 AS pos "
        "FROM (SELECT *, unnest(range(0, n)) AS rep FROM wtok)",
        "elems": "SELECT person_id, split, end_date, pos, 1 AS k, ts, stream_ord, tid FROM wpos UNION ALL "
        "SELECT DISTINCT person_id, split, end_date, pos, 0, CAST(NULL AS TIMESTAMP), 0, 3 FROM wpos WHERE pos > 0 UNION ALL "
        "SELECT DISTINCT person_id, split, end_date, -1, 0, CAST(NULL AS TIMESTAMP), 0, 1 FROM wpos UNION ALL "
        "SELECT person_id, split, end_date, MAX(pos), 2, CAST(NULL AS TIMESTAMP), 0, 2 FROM wpos GROUP BY ALL",
        "numbered": "SELECT *, row_number() OVER (PARTITION BY person_id, end_date ORDER BY pos, k, ts, stream_ord, tid) AS rn, "
        "COUNT(*) OVER (PARTITION BY person_id, end_date) AS total FROM elems",
        "kept": f"SELECT * EXCLUDE (pos), GREATEST(pos, 0) AS pos FROM numbered WHERE rn > total - {cap}",
        "seqs": "SELECT person_id, split, end_date, list(tid ORDER BY rn) AS ids, list(pos ORDER BY rn) AS poss, "
        "COUNT(*) AS n_tokens FROM kept GROUP BY ALL",
        "lseqs": "SELECT s.*, l.label FROM seqs s JOIN labels_w l ON s.person_id = l.person_id AND s.end_date = l.end_date",
        "weights": "SELECT CAST(range AS BIGINT) AS tid, ((range * 7919) % 1000) / 1000.0 - 0.5 AS weight FROM range(0, 8000)",
        "scored": "SELECT k.person_id, k.end_date, k.split, l.label, ROUND(-1.0 + AVG(weight), 9) AS logit FROM kept k "
        "JOIN weights USING (tid) JOIN labels_w l ON k.person_id = l.person_id AND k.end_date = l.end_date GROUP BY ALL",
        "risks": "SELECT person_id, end_date, split, label, logit, 1 / (1 + exp(-logit)) AS prob FROM scored",
        "contrib": "SELECT k.person_id, k.end_date, k.split, k.tid, COUNT(*) AS n, "
        "ROUND(COUNT(*) * ANY_VALUE(weight) / ANY_VALUE(LEAST(total, " + str(cap) + ")), 9) AS contribution "
        "FROM kept k JOIN weights USING (tid) GROUP BY k.person_id, k.end_date, k.split, k.tid",
        "drivers": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, end_date "
        "ORDER BY ABS(contribution) DESC, tid) AS rank FROM contrib) WHERE rank <= 3",
        "losses": "SELECT split, person_id, AVG(GREATEST(logit, 0) - logit * label + ln(1 + exp(-ABS(logit)))) AS loss, "
        "COUNT(*) AS n_windows FROM scored GROUP BY split, person_id",
        "capped": "SELECT person_id, is_member, loss FROM (SELECT *, CASE split WHEN 'train' THEN 1 ELSE 0 END AS is_member, "
        "row_number() OVER (PARTITION BY split ORDER BY person_id) AS r FROM losses WHERE split IN ('train', 'val'))",
        "eval_rows": "SELECT d.doc_id, lang, d.doc_id % 6 AS epoch, quality AS y, ROUND(ln(1 + n_chars) - 5, 6) AS logit "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        **over_extra(),
    }


def over_extra() -> dict[str, str]:
    return {
        "samples": "SELECT event_id, user_id AS person_id, CASE event_type WHEN 'click' THEN 'heartRate' WHEN 'view' THEN 'stepCount' "
        "WHEN 'purchase' THEN 'conditionRecord' WHEN 'signup' THEN 'sleepAnalysis' ELSE 'unlistedKind' END AS kind, "
        "ts AS start_ts, date_trunc('second', ts) + to_minutes(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS end_ts, "
        "value, props FROM events",
    }


def auroc_sql(source: str, score: str, label: str, by: str = "") -> str:
    """Pairwise count by ranks, ties counted half."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {group}(SUM(CASE WHEN {label} = 1 THEN mid END) - SUM({label}) * (SUM({label}) + 1) / 2.0) / "
        f"NULLIF(SUM({label}) * (COUNT(*) - SUM({label})), 0) AS auroc FROM (SELECT *, "
        f"rank() OVER ({part}ORDER BY {score}) + (COUNT(*) OVER (PARTITION BY {group}{score}) - 1) / 2.0 AS mid FROM {source}){tail}"
    )


def average_precision_sql(source: str, score: str, label: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {group}SUM({label} * tp / CAST(seen AS DOUBLE)) / NULLIF(SUM({label}), 0) AS auprc FROM (SELECT *, "
        f"SUM({label}) OVER ({part}ORDER BY {score} DESC) AS tp, COUNT(*) OVER ({part}ORDER BY {score} DESC) AS seen "
        f"FROM {source}){tail}"
    )


def compose(binding: str, final: str, extra: dict[str, str] | None = None, **over) -> str:
    """``final`` preceded by the named subqueries it reaches, in dependency order."""
    named = {**subqueries(binding, **over), **(extra or {})}
    done: list[str] = []

    def visit(text: str, path: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in named and word not in done and word not in path and re.search(rf"(FROM|JOIN)\s+{word}\b", text):
                visit(named[word], (*path, word))
                done.append(word)

    visit(final)
    head = ", ".join(f"{name} AS MATERIALIZED ({named[name]})" for name in done)
    return f"WITH {head} {final}" if head else final
