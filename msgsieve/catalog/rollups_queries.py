"""Rollup, evaluation, drift and ordered-operator queries."""

from pyspark.sql import functions as F

from msgsieve.catalog import sqltext as q
from msgsieve.catalog.registry import Inputs, query
from msgsieve.operators import evaluation as ev, ordered as od, rollups as ro

AS_OF = "2024-01-20 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("A1_kpi_by_channel", "SELECT message_type AS channel, count(*) AS total, CAST(coalesce(sum(is_threat),0) AS bigint) AS threats FROM messages GROUP BY 1", "messages")
def _(i: Inputs):
    return ro.kpi_by_channel(i.messages)


@query("A2_kpi_totals", "SELECT count(*) AS total, CAST(coalesce(sum(is_threat),0) AS bigint) AS threats FROM messages", "messages")
def _(i: Inputs):
    return ro.kpi_totals(i.messages)


@query("A3_kpi_action_dist", "SELECT json_extract_string(metadata,'$.action') AS value, count(*) AS n FROM messages GROUP BY 1", "messages")
def _(i: Inputs):
    return ro.kpi_json_dist(i.messages, "action")


@query("A3_kpi_anomaly_dist", "SELECT json_extract_string(metadata,'$.anomaly_level') AS value, count(*) AS n FROM messages WHERE json_extract_string(metadata,'$.anomaly_level') IS NOT NULL GROUP BY 1", "messages")
def _(i: Inputs):
    return ro.kpi_json_dist(i.messages, "anomaly_level")


@query("A4_threats_per_hour", f"SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS threats FROM messages WHERE is_threat = 1 AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR - INTERVAL 27 DAY GROUP BY 1", "messages")
def _(i: Inputs):
    end = i.table("events").agg(F.max("ts").alias("m"), F.lit(1).alias("k"))
    m = i.messages.withColumn("k", F.lit(1)).join(F.broadcast(end), "k")
    return ro.threats_per_hour(m, F.col("m"), 24 + 27 * 24).select(F.unix_micros("hour").alias("hour_us"), "threats")


@query("A1_kpi_rollup", "SELECT message_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS threats FROM messages WHERE is_threat=1 GROUP BY ROLLUP(message_type, 2)", "messages")
def _(i: Inputs):
    return ro.kpi_rollup(i.messages).select("message_type", F.unix_micros("hour").alias("hour_us"), "threats")


@query("A5_review_counts", "SELECT count_if(label IS NULL AND confidence >= 0.85)::bigint AS total, count_if(label IS NULL AND confidence >= 0.85)::bigint AS quarantined, 0 AS potential, 0 AS unsure FROM messages", "messages")
def _(i: Inputs):
    return ro.review_counts(i.messages)


_LIVE = "NOT (coalesce(label = 0, false))"


@query("A5_inbox_counts", f"SELECT count_if({_LIVE} AND (is_threat=1 OR confidence>=0.35))::bigint AS threat, count_if(NOT ({_LIVE}) OR NOT (is_threat=1 OR confidence>=0.35))::bigint AS cleared, count(*) AS \"all\" FROM messages", "messages")
def _(i: Inputs):
    return ro.inbox_counts(i.messages)


@query("A5_dashboard_stats", f"SELECT count(*) AS total, count_if({_LIVE} AND (is_threat=1 OR confidence>=0.35))::bigint AS threats, concat(printf('%.1f', greatest(0.1, count(*) / 60.0)), '/m') AS rate FROM messages", "messages")
def _(i: Inputs):
    return ro.dashboard_stats(i.messages)


@query("A6_fleet_promotion", f"""
WITH n AS (SELECT sender_key, count(DISTINCT account_sub) AS count FROM reports WHERE sender_key <> '' AND expected = false AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1)
SELECT sender_key, count, CASE WHEN count >= 8 THEN 'auto_promoted' WHEN count >= 3 THEN 'analyst_review' ELSE 'recorded' END AS status, CASE WHEN count >= 8 THEN 0.75 END::DOUBLE AS confidence FROM n""", "reports")
def _(i: Inputs):
    return ro.fleet_promotion(i.view("reports"), as_of(), enabled=True)


PS = ("least(0.3, 0.1 * (" + " + ".join(f"(contains(lower(body), '{w}') OR contains(lower(subject), '{w}'))::int" for w in ro.PROFILE_WORDS)
      + f")) + CASE WHEN contains(sender, '@') AND {q.any_of('list_extract(string_split(sender, chr(64)), -1)', ro.PROFILE_TLDS)} THEN 0.2 ELSE 0 END")


@query("A17_sender_profiles", f"""
WITH s AS (SELECT sender, ts, id, ({PS})::DOUBLE AS s FROM messages)
SELECT sender AS email, count(*) AS email_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, round(list_reduce(list(s ORDER BY ts NULLS FIRST, id), lambda a, b: a * 0.8 + b * 0.2), 6) AS threat_score,
 CASE WHEN contains(sender, '@') THEN list_extract(string_split(sender, '@'), -1) ELSE 'unknown' END AS domain FROM s GROUP BY sender""", "messages")
def _(i: Inputs):
    p = ro.sender_profiles(i.messages)
    return p.select("email", "email_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.round("threat_score", 6).alias("threat_score"), "domain")


@query("A18_profile_report", "SELECT count(*) AS total_profiles, count_if(threat_score > 0.5)::bigint AS threat_profiles, count_if(threat_score > 0.7)::bigint AS high_risk, count_if(threat_score > 0.3 AND threat_score <= 0.7)::bigint AS medium_risk, (count(*) - count_if(threat_score > 0.5))::bigint AS low_risk FROM profiles", "profiles")
def _(i: Inputs):
    return ro.profile_report(i.view("profiles"))


@query("A19_ingest_stats", """
SELECT count(*) AS total_emails, count_if(is_threat=1)::bigint AS threats_detected, count(DISTINCT provider) AS providers_processed, 12.5::DOUBLE AS processing_time, round(count(*) / 12.5, 6)::DOUBLE AS emails_per_second,
 round(count_if(is_threat=1)::DOUBLE / count(*), 6) AS threat_detection_rate, (SELECT count(*) FROM events WHERE event_type='error') AS errors FROM messages""", "messages")
def _(i: Inputs):
    out = ro.ingest_stats(i.messages, 12.5, i.table("events").filter("event_type = 'error'"))
    return out.withColumns({c: F.round(c, 6) for c in ("emails_per_second", "threat_detection_rate")})


@query("A20_latency_summary", """
WITH o AS (SELECT event_type AS channel, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT channel, any_value(n) AS n, round(avg(value), 6) AS avg, max(CASE WHEN r = n // 2 THEN value END) AS p50, max(CASE WHEN r = CASE WHEN floor(n * 0.95) - 1 < 0 THEN n - 1 ELSE floor(n * 0.95) - 1 END THEN value END) AS p95, max(value) AS max FROM o GROUP BY channel""")
def _(i: Inputs):
    e = i.table("events").select(F.col("event_type").alias("channel"), F.col("value").alias("ms"))
    return ro.latency_summary(e).withColumn("avg", F.round("avg", 6))


@query("A22_dataset_fingerprint", "WITH h AS (SELECT sha256(concat(CAST(label AS varchar), body)) AS h FROM messages WHERE label IS NOT NULL) SELECT count(*) AS n, substr(sha256(concat_ws('|', CAST(count(*) AS varchar), "
       + ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * k}, 8)) AS bigint)) AS varchar)" for k in range(8)) + ")), 1, 16) AS fingerprint FROM h", "messages")
def _(i: Inputs):
    return ro.dataset_fingerprint(i.messages, text="body")


@query("A23_class_balance", "WITH p AS (SELECT label, count(*) AS rows FROM messages WHERE label IN (0,1) GROUP BY 1) SELECT label, rows, round((SELECT sum(rows) FROM p)::DOUBLE / (2 * rows), 6) AS weight, (SELECT count(*) FROM p) = 2 AS both FROM p", "messages")
def _(i: Inputs):
    return ro.class_balance(i.messages).withColumn("weight", F.round("weight", 6))


@query("A24_queue_drain_stats", "SELECT count_if(status IN ('ok','failed'))::bigint AS processed, count_if(status='ok')::bigint AS ok, count_if(status='failed')::bigint AS failed FROM queue", "queue")
def _(i: Inputs):
    return ro.queue_drain_stats(i.view("queue"))


@query("A24_dlq_depth", "SELECT event_type AS kind, count(*) AS pending FROM events GROUP BY 1")
def _(i: Inputs):
    return ro.dlq_depth(i.table("events").withColumnRenamed("event_type", "kind"))


@query("A25_trial_abuse_score", """
WITH p AS (SELECT s.signup_id, s.want_trial, CASE WHEN length(trim(coalesce(s.fingerprint,''))) < 8 THEN 35 ELSE 0 END + CASE WHEN contains(lower(user_agent),'mozilla') THEN 0 ELSE 15 END + CASE WHEN ip = '127.0.0.1' THEN 10 ELSE 0 END
 + CASE WHEN t.attempts >= 2 THEN 40 WHEN t.attempts IS NOT NULL THEN 15 ELSE 0 END AS raw FROM signups s LEFT JOIN trial_fp t ON t.fingerprint = s.fingerprint)
SELECT signup_id, CASE WHEN want_trial THEN least(raw, 100) ELSE 0 END AS score, NOT want_trial OR raw < 70 AS allow FROM p""", "signups trial_fp")
def _(i: Inputs):
    return ro.trial_abuse_score(i.view("signups"), i.view("trial_fp"))


@query("A27_metrics_text_totals", "SELECT CAST(sum(CASE WHEN event_type='click' THEN event_id % 7 END) AS bigint) AS total_requests, (SELECT event_id % 13 FROM events WHERE event_type='view' ORDER BY event_id DESC LIMIT 1) AS in_flight FROM events")
def _(i: Inputs):
    k = F.col("event_id")
    line = (F.when(F.col("event_type") == "click", F.concat(F.lit('http_requests_total{path="/x y"} '), (k % 7).cast("string")))
            .when(F.col("event_type") == "view", F.concat(F.lit("http_requests_in_flight "), (k % 13).cast("string")))
            .when(F.col("event_type") == "error", F.concat(F.lit("# HELP "), k.cast("string"))).otherwise("broken line"))
    return ro.metrics_text_totals(i.table("events").select(k.alias("pos"), line.alias("value")))


# --- evaluation --------------------------------------------------------------
_BE = """be AS (SELECT channel, count_if(pred=1 AND label=1)::bigint AS tp, count_if(pred=0 AND label=0)::bigint AS tn, count_if(label=0 AND (pred IS NULL OR pred=1))::bigint AS fp, count_if(label=1 AND (pred IS NULL OR pred=0))::bigint AS fn,
 count_if(pred IS NULL)::bigint AS inference_errors FROM predictions GROUP BY 1),
m AS (SELECT *, tp+tn+fp+fn AS n, (tp+tn)::DOUBLE/(tp+tn+fp+fn) AS accuracy, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END AS recall,
 CASE WHEN tn+fp>0 THEN tn::DOUBLE/(tn+fp) ELSE 0 END AS specificity, CASE WHEN tn+fp>0 THEN fp::DOUBLE/(tn+fp) ELSE 0 END AS fpr, inference_errors = 0 AS evaluation_valid FROM be)"""
RATES = ["accuracy", "precision", "recall", "specificity", "fpr", "f1"]


@query("A7_binary_eval", f"WITH {_BE} SELECT channel, tp, tn, fp, fn, n, inference_errors, evaluation_valid, {', '.join(f'round({c}, 6) AS {c}' for c in RATES[:-1])}, round(CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0 END, 6) AS f1 FROM m", "predictions")
def _(i: Inputs):
    return ev.binary_eval(i.view("predictions"), ["channel"]).withColumns({c: F.round(c, 6) for c in RATES})


@query("A8_eval_by_tag", "SELECT tag, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 3) AS accuracy FROM (SELECT label, pred, unnest(CASE WHEN tags = '' THEN ['untagged'] ELSE string_split(tags, ',') END) AS tag FROM predictions) GROUP BY 1", "predictions")
def _(i: Inputs):
    p = i.view("predictions").withColumn("tags", F.filter(F.split("tags", ","), lambda x: x != ""))
    return ev.eval_by_tag(p)


def _wil(k: str, n: str, sign: str) -> str:
    z = "3.8416"
    core = f"(({k})::DOUBLE/({n}) + {z}/(2*({n})) {sign} 1.96*sqrt(({k})::DOUBLE/({n})*(1-({k})::DOUBLE/({n}))/({n}) + {z}/(4.0*({n})*({n}))))/(1+{z}/({n}))"
    return f"CASE WHEN ({n}) > 0 THEN round({'greatest(0.0, ' if sign == '-' else 'least(1.0, '}{core}), 4) ELSE 0.0 END::DOUBLE"


_CI = f"ci AS (SELECT *, {_wil('tp', 'tp+fn', '-')} AS recall_lo, {_wil('tp', 'tp+fn', '+')} AS recall_hi, {_wil('fp', 'fp+tn', '-')} AS fpr_lo, {_wil('fp', 'fp+tn', '+')} AS fpr_hi FROM m)"


@query("A9_wilson_interval", f"WITH {_BE}, {_CI} SELECT channel, recall_lo, recall_hi, fpr_lo, fpr_hi FROM ci", "predictions")
def _(i: Inputs):
    return ev.with_intervals(ev.binary_eval(i.view("predictions"), ["channel"])).select("channel", "recall_lo", "recall_hi", "fpr_lo", "fpr_hi")


_GATE = f"""{_BE}, {_CI}, g AS (SELECT * FROM (VALUES ('phishing',0.9,0.1,NULL,1.0),('smishing',0.9,0.05,0.9,NULL),('vishing',0.9,0.05,0.9,NULL)) AS g(channel, ma, mf, mr, mp)),
gt AS (SELECT ci.*, evaluation_valid AND accuracy >= ma AND fpr <= mf AND recall >= coalesce(mr, 0) AND mp IS NULL AS gate_pass, evaluation_valid AND tp+fn>0 AND tn+fp>0 AND recall_lo >= coalesce(mr, 0.9) AND fpr_hi <= mf AS evidence_sufficient FROM ci JOIN g ON g.channel = ci.channel)"""


@query("A10_release_gate", f"WITH {_GATE} SELECT channel, gate_pass, evidence_sufficient, gate_pass AND evidence_sufficient AS release_ready FROM gt", "predictions")
def _(i: Inputs):
    return ev.release_gate(ev.binary_eval(i.view("predictions"), ["channel"]), ev.gate_table(i.spark)).select("channel", "gate_pass", "evidence_sufficient", "release_ready")


@query("A11_decide_promotion", f"""
WITH {_BE}, old AS (SELECT channel, (count_if(score >= 0.5 AND label=1))::DOUBLE / greatest(count_if(label=1), 1) AS recall, count_if(score >= 0.5 AND label=0)::DOUBLE / greatest(count_if(label=0), 1) AS fpr, count_if((score >= 0.5)::int = label)::DOUBLE / count(*) AS accuracy FROM predictions GROUP BY 1)
SELECT m.channel, NOT (m.recall < old.recall - 0.01 OR m.fpr > old.fpr + 0.01 OR m.accuracy < old.accuracy - 0.01) AS promoted FROM m JOIN old ON old.channel = m.channel""", "predictions")
def _(i: Inputs):
    p = i.view("predictions")
    cand = ev.binary_eval(p, ["channel"]).withColumn("gate_pass", F.lit(True))
    champ = ev.binary_eval(p.withColumn("pred", (F.col("score") >= 0.5).cast("int")), ["channel"])
    return ev.decide_promotion(cand, champ).select("channel", "promoted")


def action_rows(i: Inputs):
    k = F.col("event_id")
    e = i.table("events")
    four = F.array(*[F.lit(a) for a in ev.ACTIONS])
    return e.select(k.alias("ord"), F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("r"), (k % 9000).cast("string"))).alias("id"),
                    F.when(k % 43 == 0, None).otherwise(F.concat(F.lit("g"), F.col("user_id").cast("string"))).alias("group_id"),
                    F.when(F.col("event_type") == "click", "legit").when(F.col("event_type") == "view", "nuisance").when(F.col("event_type") == "error", "fraud").when(k % 10 == 0, "odd").otherwise("fraud").alias("taxonomy"),
                    F.get(four, (k % 4).cast("int")).alias("expected"),
                    F.when(k % 29 == 0, None).when(k % 31 == 0, "ring").otherwise(F.get(four, ((k + F.col("user_id")) % 4).cast("int"))).alias("predicted"))


_ACT = """r AS (SELECT event_id AS ord, CASE WHEN event_id % 41 = 0 THEN '' ELSE concat('r', event_id % 9000) END AS id, CASE WHEN event_id % 43 = 0 THEN NULL ELSE concat('g', user_id) END AS group_id,
 CASE event_type WHEN 'click' THEN 'legit' WHEN 'view' THEN 'nuisance' WHEN 'error' THEN 'fraud' ELSE CASE WHEN event_id % 10 = 0 THEN 'odd' ELSE 'fraud' END END AS taxonomy, ['allow','label','silence','block'][event_id % 4 + 1] AS expected,
 CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'ring' ELSE ['allow','label','silence','block'][(event_id + user_id) % 4 + 1] END AS predicted FROM events),
tr AS (SELECT DISTINCT concat('g', c_custkey) AS g FROM customer WHERE c_mktsegment = 'MACHINERY'),
f AS (SELECT *, CASE WHEN id = '' THEN NULL ELSE min(ord) OVER (PARTITION BY id) END AS fo FROM r),
jd AS (SELECT *, CASE WHEN id = '' THEN 'missing_id' WHEN ord <> fo THEN 'duplicate_id' WHEN group_id IS NULL THEN 'missing_group_id' WHEN taxonomy = 'odd' THEN 'invalid_taxonomy_or_expected_action' WHEN group_id IN (SELECT g FROM tr) THEN 'group_overlap'
 WHEN predicted IS NULL THEN 'inference_error' WHEN predicted = 'ring' THEN 'invalid_prediction' ELSE 'ok' END AS outcome FROM f), sup AS (SELECT * FROM jd WHERE outcome IN ('ok','group_overlap','inference_error','invalid_prediction'))"""


def judged(i: Inputs):
    train = i.table("customer").filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("group_id"))
    return ev.judge_actions(action_rows(i), train)


@query("A12_judge_actions", f"WITH {_ACT} SELECT ord, outcome FROM jd")
def _(i: Inputs):
    return judged(i).select("ord", "outcome")


@query("A12_action_confusion", f"WITH {_ACT} SELECT expected, " + ", ".join(f"count_if(CASE WHEN outcome='ok' THEN predicted ELSE 'invalid' END = '{a}')::bigint AS {a}" for a in [*ev.ACTIONS, 'invalid']) + " FROM sup GROUP BY 1")
def _(i: Inputs):
    return ev.action_confusion(judged(i))


@query("A12_action_scores", f"""
WITH {_ACT}, a AS (SELECT unnest(['allow','label','silence','block']) AS action), s AS (SELECT action, (SELECT count(*) FROM sup WHERE expected = action) AS support, (SELECT count(*) FROM sup WHERE outcome='ok' AND predicted = action) AS predicted,
 (SELECT count(*) FROM sup WHERE outcome='ok' AND predicted = action AND expected = action) AS tp FROM a) SELECT *, round(tp::DOUBLE / predicted, 6) AS precision, round(tp::DOUBLE / support, 6) AS recall FROM s""")
def _(i: Inputs):
    return ev.action_scores(judged(i)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("A12_action_summary", f"""
WITH {_ACT} SELECT (SELECT count(*) FROM jd) AS input_count, count(*) AS valid_expected_count, count_if(outcome='ok')::bigint AS prediction_count, round(count_if(outcome='ok' AND predicted=expected)::DOUBLE / count(*), 6) AS accuracy,
 count_if(outcome='ok' AND predicted='block' AND expected<>'block')::bigint AS false_block_count, round(count_if(outcome='ok' AND predicted='block' AND expected<>'block')::DOUBLE / count_if(expected<>'block'), 6) AS false_block_rate,
 round(count_if(outcome='ok' AND predicted='block' AND expected<>'block' AND taxonomy='legit')::DOUBLE / count_if(taxonomy='legit'), 6) AS legit_false_block_rate, false AS evaluation_valid FROM sup""")
def _(i: Inputs):
    out = ev.action_summary(judged(i)).withColumns({c: F.round(c, 6) for c in ("accuracy", "false_block_rate", "legit_false_block_rate")})
    return out.select("input_count", "valid_expected_count", "prediction_count", "accuracy", "false_block_count", "false_block_rate", "legit_false_block_rate", "evaluation_valid")


@query("A12_action_failures", f"WITH {_ACT} SELECT ord, id, outcome FROM jd WHERE outcome <> 'ok'")
def _(i: Inputs):
    return ev.action_failures(judged(i))


@query("A26_action_support", f"WITH {_ACT} SELECT taxonomy, expected AS expected_action, count(*) AS n FROM sup GROUP BY 1, 2")
def _(i: Inputs):
    return ev.action_support(judged(i))


def _psi_sql(name: str, ref: str, bat: str) -> str:
    qs = ", ".join(f"quantile_cont(v, {k / 10})" for k in range(11))
    return f"""{name}_e AS (SELECT list_sort(list_distinct([{qs}])) AS e FROM ({ref})), {name}_i AS (SELECT CASE WHEN len(e) > 2 THEN list_slice(e, 2, len(e) - 1) ELSE [] END AS inner_ FROM {name}_e),
{name}_r AS (SELECT len(list_filter(inner_, lambda x: x <= v)) AS bin, count(*) AS n FROM ({ref}), {name}_i GROUP BY 1), {name}_b AS (SELECT len(list_filter(inner_, lambda x: x <= v)) AS bin, count(*) AS n FROM ({bat}), {name}_i GROUP BY 1),
{name}_p AS (SELECT greatest(coalesce(r.n, 0)::DOUBLE / (SELECT sum(n) FROM {name}_r), 1e-6) AS e, greatest(coalesce(b.n, 0)::DOUBLE / (SELECT sum(n) FROM {name}_b), 1e-6) AS a FROM {name}_r r FULL JOIN {name}_b b ON b.bin = r.bin),
{name} AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM {name}_p)"""


_PRICE = _psi_sql("price", "SELECT o_totalprice AS v FROM orders WHERE year(o_orderdate) < 1996", "SELECT o_totalprice AS v FROM orders WHERE year(o_orderdate) >= 1996")
_CUST = _psi_sql("cust", "SELECT o_custkey::DOUBLE AS v FROM orders WHERE year(o_orderdate) < 1996", "SELECT o_custkey::DOUBLE AS v FROM orders WHERE year(o_orderdate) >= 1996")
_CONF = _psi_sql("cf", "SELECT (o_orderkey % 13)::DOUBLE AS v FROM orders WHERE year(o_orderdate) < 1996", "SELECT (o_orderkey % 13)::DOUBLE AS v FROM orders WHERE year(o_orderdate) >= 1996")


def periods(i: Inputs):
    o = i.table("orders").select(F.year("o_orderdate").alias("y"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"), (F.col("o_orderkey") % 13).cast("double").alias("conf"))
    return o.filter("y < 1996"), o.filter("y >= 1996")


@query("A13_psi", f"WITH {_PRICE}, {_CUST} SELECT 'o_totalprice' AS feature, round(psi, 6) AS psi FROM price UNION ALL SELECT 'o_custkey', round(psi, 6) FROM cust")
def _(i: Inputs):
    a, b = periods(i)
    cols = ["o_totalprice", "o_custkey"]
    return ev.psi(ev.long_features(a, cols), ev.long_features(b, cols)).withColumn("psi", F.round("psi", 6))


@query("A14_drift_report", f"""
WITH {_PRICE}, {_CUST}, {_CONF}, x AS (SELECT greatest(price.psi, cust.psi) AS mx, (price.psi + cust.psi) / 2 AS mn, cf.psi AS c FROM price, cust, cf)
SELECT round(mx, 4) AS max_feature_psi, round(mn, 4) AS mean_feature_psi, round(c, 4) AS confidence_psi, round(greatest(mx, c), 4) AS overall_psi, CASE WHEN greatest(mx, c) >= 0.25 THEN 'significant' WHEN greatest(mx, c) >= 0.1 THEN 'moderate' ELSE 'stable' END AS level, greatest(mx, c) >= 0.25 AS should_retrain FROM x""")
def _(i: Inputs):
    a, b = periods(i)
    return ev.drift_report(a, b, ["o_totalprice", "o_custkey"], "conf")


_SQ = "sq AS (SELECT event_type AS channel, count(*) AS n, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, min(value) AS min, max(value) AS max FROM events GROUP BY 1)"


@query("A15_score_quantiles", f"WITH {_SQ} SELECT channel, n, round(q01, 6) AS q01, round(q05, 6) AS q05, round(q25, 6) AS q25, round(q50, 6) AS q50, min, max FROM sq")
def _(i: Inputs):
    e = i.table("events").select(F.col("event_type").alias("channel"), F.col("value").alias("score"))
    return ev.score_quantiles(e, ["channel"]).withColumns({c: F.round(c, 6) for c in ("q01", "q05", "q25", "q50")})


@query("M7_novelty_bands", f"""
WITH {_SQ} SELECT event_id, round(greatest(0.0, least(1.0, (q50 - value) / greatest(q50 - min, 1e-6))), 6)::DOUBLE AS novelty, CASE WHEN value < q01 THEN 'EXTREME' WHEN value < q05 THEN 'CRITICAL' WHEN value < q25 THEN 'WARNING' ELSE 'NORMAL' END AS level FROM events JOIN sq ON sq.channel = events.event_type""")
def _(i: Inputs):
    e = i.table("events").select("event_id", F.col("event_type").alias("channel"), F.col("value").alias("score"))
    return ev.novelty_bands(e, ev.score_quantiles(e, ["channel"]), ["channel"]).select("event_id", F.round("novelty", 6).alias("novelty"), "level")


# --- ordered -----------------------------------------------------------------
@query("W3_grade_velocity", """
WITH g AS (SELECT event_id AS id, ts, concat(CASE WHEN user_id % 2 = 0 THEN 'phishing' ELSE 'smishing' END) AS channel, concat('c', user_id % 3) AS campaign_id, CASE event_type WHEN 'click' THEN 'block' WHEN 'view' THEN 'safe' END AS verdict FROM events WHERE event_type IN ('click','view'))
SELECT g.id, count(*) AS n, count(*) = 8 AS fired FROM g JOIN g h ON h.channel = g.channel AND h.campaign_id = g.campaign_id AND h.ts > g.ts - INTERVAL 1 HOUR AND (h.ts < g.ts OR (h.ts = g.ts AND h.id <= g.id)) GROUP BY g.id""")
def _(i: Inputs):
    e = i.table("events")
    g = e.select(F.col("event_id").alias("id"), "ts", F.when(F.col("user_id") % 2 == 0, "phishing").otherwise("smishing").alias("channel"),
                 F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("campaign_id"),
                 F.when(F.col("event_type") == "click", "block").when(F.col("event_type") == "view", "safe").otherwise("unsure").alias("verdict"))
    return od.grade_velocity(g).select("id", "n", "fired")


@query("W4_checkout_velocity", """
SELECT e.event_id AS id, count(*) AS n, count(*) <= 2 AS allow FROM events e JOIN events h ON h.user_id % 4 = e.user_id % 4 AND h.ts > e.ts - INTERVAL 10 MINUTE AND (h.ts < e.ts OR (h.ts = e.ts AND h.event_id <= e.event_id)) GROUP BY 1""")
def _(i: Inputs):
    e = i.table("events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 4).alias("key"))
    return od.checkout_velocity(e, limit=2).select("id", "n", "allow")


def request_log(i: Inputs):
    return i.table("events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 50).alias("key"),
                                    F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("request_hash"), ((F.col("event_id") % 3) * 3_600_000_000).alias("done_us"))


_SEQ = "s AS MATERIALIZED (SELECT event_id AS id, user_id % 50 AS key, epoch_us(ts) AS t, concat('h', event_id % 2) AS h, (event_id % 3) * 3600000000 AS d, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS rn FROM events)"


@query("W5_request_rate", f"""
WITH RECURSIVE {_SEQ}, w AS (SELECT id, key, rn, true AS allowed, [t] AS recent FROM s WHERE rn = 1
 UNION ALL SELECT s.id, s.key, s.rn, len(list_filter(w.recent, lambda x: s.t - x < 21600000000)) < 1, CASE WHEN len(list_filter(w.recent, lambda x: s.t - x < 21600000000)) < 1 THEN list_append(list_filter(w.recent, lambda x: s.t - x < 21600000000), s.t) ELSE list_filter(w.recent, lambda x: s.t - x < 21600000000) END FROM w JOIN s ON s.key = w.key AND s.rn = w.rn + 1)
SELECT id, key, allowed FROM w""")
def _(i: Inputs):
    return od.request_rate(request_log(i), limit=1, window_us=21_600_000_000).select("id", "key", "allowed")


@query("W6_token_bucket_flags", f"""
WITH RECURSIVE {_SEQ}, w AS (SELECT id, key, rn, t, true AS allowed, 1.0::DOUBLE AS tokens FROM s WHERE rn = 1
 UNION ALL SELECT id, key, rn, t, lvl >= 1.0, CASE WHEN lvl >= 1.0 THEN lvl - 1.0 ELSE lvl END FROM (SELECT s.id, s.key, s.rn, s.t, least(2.0, w.tokens + (s.t - w.t) / 1e6 * 0.00008)::DOUBLE AS lvl FROM w JOIN s ON s.key = w.key AND s.rn = w.rn + 1))
SELECT id, key, allowed, round(tokens, 6) AS tokens FROM w""")
def _(i: Inputs):
    return od.token_bucket_flags(request_log(i), 2.0, 0.00008).select("id", "key", "allowed", F.round("tokens", 6).alias("tokens"))


@query("R7_duplicate_requests", f"""
WITH RECURSIVE {_SEQ}, w AS (SELECT id, key, rn, t AS born, h AS bh, d AS bd, 'new' AS verdict FROM s WHERE rn = 1
 UNION ALL SELECT s.id, s.key, s.rn, CASE WHEN s.t - w.born > 86400000000 THEN s.t ELSE w.born END, CASE WHEN s.t - w.born > 86400000000 THEN s.h ELSE w.bh END, CASE WHEN s.t - w.born > 86400000000 THEN s.d ELSE w.bd END,
  CASE WHEN s.t - w.born > 86400000000 THEN 'new' WHEN s.h <> w.bh THEN 'conflict' WHEN s.t >= w.born + w.bd THEN 'replay' ELSE 'in_flight' END FROM w JOIN s ON s.key = w.key AND s.rn = w.rn + 1)
SELECT id, key, verdict FROM w""")
def _(i: Inputs):
    return od.duplicate_requests(request_log(i))


@query("W8_lease_queue", f"""
SELECT id, 'processing' AS status, attempts + 1 AS attempts, epoch_us(TIMESTAMP '{AS_OF}' + INTERVAL 5 MINUTE) AS lease_us FROM (SELECT * FROM queue WHERE attempts < 5 AND next_attempt_at <= TIMESTAMP '{AS_OF}' AND (status='pending' OR (status='processing' AND lease_until < TIMESTAMP '{AS_OF}')) ORDER BY created_at, id LIMIT 20)""", "queue")
def _(i: Inputs):
    return od.lease_queue(i.view("queue"), as_of()).select("id", "status", "attempts", F.unix_micros("lease_until").alias("lease_us"))


@query("W9_retry_schedule", f"""
WITH r AS (SELECT event_id AS id, event_id % 3 = 0 AS ok FROM events WHERE event_type IN ('view','click'))
SELECT q.id, CASE WHEN r.id IS NULL THEN q.status WHEN r.ok THEN 'ok' WHEN q.attempts < 5 THEN 'pending' ELSE 'failed' END AS status,
 CASE WHEN r.id IS NOT NULL AND NOT r.ok AND q.attempts < 5 THEN epoch_us(TIMESTAMP '{AS_OF}') + CAST(least(300, pow(2, greatest(1, q.attempts))) AS bigint) * 1000000 ELSE epoch_us(q.next_attempt_at) END AS next_us FROM queue q LEFT JOIN r ON r.id = q.id""", "queue")
def _(i: Inputs):
    res = i.table("events").filter("event_type in ('view','click')").select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("ok"))
    return od.retry_schedule(i.view("queue"), res, as_of()).select("id", "status", F.unix_micros("next_attempt_at").alias("next_us"))


def audit_events(i: Inputs):
    e = i.table("events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("stream"), F.col("user_id").cast("string")).alias("stream_id"), "event_type",
                    F.col("props").alias("payload"), F.unix_micros("ts").cast("string").alias("hashed_at"), "ts")


@query("W11_append_audit_chain", """
WITH RECURSIVE s AS MATERIALIZED (SELECT event_id AS id, user_id, event_type, props, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT id, user_id, rn, CAST(NULL AS varchar) AS previous_hash, sha256(concat('|', event_type, '|stream', user_id, '|', props, '|', t)) AS event_hash FROM s WHERE rn = 1
 UNION ALL SELECT s.id, s.user_id, s.rn, w.event_hash, sha256(concat(w.event_hash, '|', s.event_type, '|stream', s.user_id, '|', s.props, '|', s.t)) FROM w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
SELECT id, previous_hash, event_hash FROM w""")
def _(i: Inputs):
    return od.append_audit_chain(audit_events(i)).select("id", "previous_hash", "event_hash")


@query("W10_verify_audit_chain", "SELECT event_id AS id, true AS link_ok, event_type <> 'error' AS hash_ok FROM events")
def _(i: Inputs):
    chain = od.append_audit_chain(audit_events(i))
    tampered = chain.withColumn("payload", F.when(F.col("event_type") == "error", F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return od.verify_audit_chain(tampered).select("id", "link_ok", "hash_ok")


@query("W13_latest_versions", """
WITH r AS (SELECT DISTINCT event_type AS channel, concat('v', user_id) AS version, user_id AS n FROM events), p AS (SELECT *, lag(version) OVER (PARTITION BY channel ORDER BY n) AS previous, row_number() OVER (PARTITION BY channel ORDER BY n DESC) AS rank FROM r)
SELECT channel, version, previous, rank, rank = 1 AS is_latest FROM p""")
def _(i: Inputs):
    r = i.table("events").select(F.col("event_type").alias("channel"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("version")).distinct()
    return od.latest_versions(r).select("channel", "version", "previous", "rank", "is_latest")


@query("W12_recent_lookback", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 40")
def _(i: Inputs):
    return od.top_per_key(i.table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 40).select("user_id", "event_id", "rank")


@query("P19_screen_history", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 200")
def _(i: Inputs):
    return od.top_per_key(i.table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 200).select("user_id", "event_id", "rank")


@query("R14_screen_ring", """
WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
SELECT t.user_id, t.event_id, coalesce(g.verdict, '') AS graded FROM t LEFT JOIN grades g ON g.message_id = t.event_id WHERE rank <= 200""", "grades")
def _(i: Inputs):
    ring = od.top_per_key(i.table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 200)
    g = i.view("grades").select(F.col("message_id").alias("event_id"), F.col("verdict").alias("graded"))
    return ring.join(g, "event_id", "left").select("user_id", "event_id", F.coalesce("graded", F.lit("")).alias("graded"))


@query("T5_reservoir", "SELECT id, md5(concat(id, '|', 42)) AS h FROM messages ORDER BY md5(concat(id, '|', 42)) LIMIT 100", "messages")
def _(i: Inputs):
    return od.reservoir(i.messages.select("id"), 100, 42).select("id", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42"))).alias("h"))
