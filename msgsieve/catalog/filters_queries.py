"""Filter, scope and page queries."""

import uuid

from pyspark.sql import functions as F

from msgsieve.catalog.registry import Inputs, query
from msgsieve.operators import filters as f
from msgsieve.session import checkpoint_dir
from msgsieve.sources import readers as rd

BASE = ["id", "account_sub", "message_type", "sender", "is_threat", "confidence", "label"]
SQL_BASE = "id, account_sub, message_type, sender, is_threat, confidence, label"


@query("S1_read_messages", "SELECT id, account_sub, message_type, sender, epoch_us(ts) AS ts_us, subject, is_threat, confidence, label, metadata FROM messages", "messages")
def _(i: Inputs):
    path = f"{checkpoint_dir(i.spark)}/messages-{uuid.uuid4().hex}"
    i.messages.write.parquet(path)
    return rd.read_messages(i.spark, path).select("id", "account_sub", "message_type", "sender", F.unix_micros("ts").alias("ts_us"), "subject", "is_threat", "confidence", "label", "metadata")


@query("P1_tenant_scope", f"SELECT {SQL_BASE} FROM messages WHERE account_sub = 'acct3'", "messages")
def _(i: Inputs):
    return f.tenant_scope(i.messages, "acct3").select(*BASE)


@query("P2_reject_tenantless", """
SELECT u.user_id, u.tenant, CASE WHEN trim(coalesce(u.tenant, '')) <> '' AND lower(trim(u.tenant)) NOT IN ('anon','anonymous','public','*')
  AND length(trim(u.tenant)) <= 200 THEN 'ok' ELSE 'refused' END AS side
FROM (SELECT user_id, CASE WHEN event_type='click' THEN ' ' WHEN event_type='view' THEN 'Public' WHEN event_type='error' THEN NULL ELSE concat('acct', user_id) END AS tenant FROM events) u""")
def _(i: Inputs):
    e = i.table("events")
    t = (F.when(F.col("event_type") == "click", " ").when(F.col("event_type") == "view", "Public")
         .when(F.col("event_type") == "error", None).otherwise(F.concat(F.lit("acct"), F.col("user_id"))))
    ok, refused = f.reject_tenantless(e.select("user_id", t.alias("account_sub")))
    return (ok.withColumn("side", F.lit("ok")).unionByName(refused.withColumn("side", F.lit("refused")))
            .withColumnRenamed("account_sub", "tenant"))


@query("P3_threats_page_filter", f"SELECT {SQL_BASE} FROM messages WHERE account_sub='acct2' AND message_type='smishing' AND label IS NULL AND confidence < 0.85 AND confidence >= 0.2", "messages")
def _(i: Inputs):
    return f.threats_page_filter(i.messages, "acct2", "smishing", 0.85, 0.2).select(*BASE)


@query("P4_review_queue", f"SELECT {SQL_BASE}, 'quarantined' AS band FROM messages WHERE account_sub='acct1' AND label IS NULL AND confidence >= 0.85 ORDER BY confidence DESC, id DESC LIMIT 100", "messages")
def _(i: Inputs):
    return f.review_queue(i.messages, "acct1", 100).select(*BASE, "band")


@query("P5_threats_by_sender", f"SELECT {SQL_BASE} FROM messages WHERE account_sub='acct4' AND sender='IRS' AND is_threat=1 ORDER BY ts DESC, id DESC LIMIT 50", "messages")
def _(i: Inputs):
    return f.threats_by_sender(i.messages, "acct4", "IRS").select(*BASE)


@query("P6_message_by_id", f"SELECT {SQL_BASE} FROM messages WHERE account_sub='acct6' AND id = 13", "messages")
def _(i: Inputs):
    return f.message_by_id(i.messages, "acct6", 13).select(*BASE)


@query("P7_list_threats", f"SELECT {SQL_BASE} FROM messages WHERE account_sub='acct5' AND message_type='vishing' ORDER BY ts DESC, id DESC LIMIT 100", "messages")
def _(i: Inputs):
    return f.list_threats(i.messages, "acct5", "vishing").select(*BASE)


@query("P8_json_field_filter", """
SELECT id, json_extract_string(metadata, '$.action') AS action, json_extract_string(metadata, '$.anomaly_level') AS anomaly_level FROM messages
WHERE json_extract_string(metadata,'$.anomaly_level') IS NOT NULL AND coalesce(json_extract_string(metadata,'$.auto_processed'),'false') <> 'true'""", "messages")
def _(i: Inputs):
    m = F.col("metadata")
    return (i.messages.filter(f.json_field(m, "anomaly_level").isNotNull() & (F.coalesce(f.json_field(m, "auto_processed"), F.lit("false")) != "true"))
            .select("id", f.json_field(m, "action").alias("action"), f.json_field(m, "anomaly_level").alias("anomaly_level")))


@query("P9_auto_triage_candidates", f"""
SELECT {SQL_BASE} FROM messages WHERE is_threat=1 AND confidence > 0.85 AND (label IS NULL OR label = 1)
AND coalesce(json_extract_string(metadata,'$.processed'),'false') <> 'true'""", "messages")
def _(i: Inputs):
    return f.auto_triage_candidates(i.messages).select(*BASE)


def _rules_sql() -> str:
    arms = []
    for name, senders, subjects, below, *_ in f.BACKFILL_RULES:
        cond = "(" + " OR ".join(f"sender ILIKE '{p}'" for p in senders) + ")"
        if subjects:
            cond += " AND (" + " OR ".join(f"subject ILIKE '{p}'" for p in subjects) + ")"
        if below is not None:
            cond += f" AND confidence < {below}"
        arms.append(f"WHEN label IS NULL AND message_type='phishing' AND {cond} THEN '{name}'")
    pick = "CASE " + " ".join(arms) + " END"

    def col(pos: int, old: str, wrap: str = "{}") -> str:
        return "CASE " + " ".join(f"WHEN rule='{r[0]}' THEN {wrap.format(r[pos])}" for r in f.BACKFILL_RULES if r[pos] is not None) + f" ELSE {old} END"
    stamp = "CASE " + " ".join(f"WHEN rule='{r[0]}' THEN '{r[7]}={r[8]}'" for r in f.BACKFILL_RULES) + " END"
    return (f"SELECT id, rule, {col(4, 'is_threat')} AS is_threat, CAST({col(5, 'confidence')} AS double) AS confidence, {col(6, 'label')} AS label, {stamp} AS stamp "
            f"FROM (SELECT *, {pick} AS rule FROM messages) r")


@query("P11_pattern_backfill", _rules_sql(), "messages")
def _(i: Inputs):
    return f.pattern_backfill(i.messages).select("id", "rule", "is_threat", "confidence", "label", "stamp")


@query("P14_trusted_labels", "SELECT id, label AS trusted_label FROM messages WHERE json_extract_string(metadata,'$.label_source') IN ('human_grade','analyst_verified','vendor_verified') AND label IN (0,1)", "messages")
def _(i: Inputs):
    m = i.messages
    return f.trusted_labels(m, f.json_field(F.col("metadata"), "label_source"), f.TRUSTED_DB_SOURCES).select("id", "trusted_label")


@query("P15_hot_numbers", "SELECT e164, risk, verdict FROM number_reputation WHERE risk >= 0.4", "number_reputation")
def _(i: Inputs):
    return f.hot_numbers(i.view("number_reputation")).select("e164", "risk", "verdict")


@query("P16_threat_profiles", "SELECT email, threat_score FROM profiles WHERE threat_score >= 0.5", "profiles")
def _(i: Inputs):
    return f.threat_profiles(i.view("profiles"), 0.5)


@query("P17_inbox_view", """
SELECT id, (is_threat = 1 OR confidence >= 0.35) AS threat FROM messages
WHERE NOT (coalesce(label = 0, false) OR coalesce(json_extract_string(metadata,'$.review_status'),'') = 'safe' OR json_extract_string(metadata,'$.safe_domain') IS NOT NULL)""", "messages")
def _(i: Inputs):
    return f.inbox_view(i.messages).select("id", "threat")


@query("P18_dashboard_view", """
SELECT id, substr(sender,1,42) AS sender, message_type AS channel, printf('%.2f', confidence) AS score, (is_threat = 1 OR confidence >= 0.35) AS threat
FROM (SELECT * FROM messages WHERE account_sub='acct2' AND label IS NULL AND confidence < 0.85 ORDER BY id DESC LIMIT 40)
ORDER BY id DESC LIMIT 24""", "messages")
def _(i: Inputs):
    return f.dashboard_view(i.messages, "acct2")


@query("P20_persist_rule", """
SELECT id, account_sub, message_type, sender, 1 AS is_threat, confidence, CAST(NULL AS int) AS label,
  concat('{"risk_score":', confidence, ',"action":"review","label_source":"model_prediction","training_eligible":false}') AS metadata
FROM messages WHERE confidence >= 0.35""", "messages")
def _(i: Inputs):
    v = i.messages.select("id", "account_sub", F.col("message_type").alias("channel"), "sender", F.col("confidence").alias("risk_score"), F.lit("review").alias("action"))
    return f.persist_rule(v)


@query("W7_keyset_page", f"""
WITH page AS (SELECT * FROM messages WHERE account_sub='acct3' AND label IS NULL AND id < 900 ORDER BY id DESC LIMIT 51),
kept AS (SELECT * FROM page ORDER BY id DESC LIMIT 50), n AS (SELECT count(*) AS n FROM page)
SELECT {SQL_BASE}, n.n > 50 AS has_more, CASE WHEN n.n > 50 THEN (SELECT min(id) FROM kept) END AS next_cursor FROM kept, n""", "messages")
def _(i: Inputs):
    return f.keyset_page(f.threats_page_filter(i.messages, "acct3"), 900, 50).select(*BASE, "has_more", "next_cursor")


@query("T1_top_by_confidence", f"SELECT {SQL_BASE} FROM messages ORDER BY confidence DESC, id DESC LIMIT 100", "messages")
def _(i: Inputs):
    return i.messages.orderBy(F.desc("confidence"), F.desc("id")).limit(100).select(*BASE)


@query("T2_channel_slices", f"""
SELECT {SQL_BASE} FROM (SELECT *, row_number() OVER (PARTITION BY message_type ORDER BY id DESC) AS rn FROM messages)
WHERE rn <= CASE message_type WHEN 'phishing' THEN 12 WHEN 'smishing' THEN 40 ELSE 80 END""", "messages")
def _(i: Inputs):
    from msgsieve.operators.ordered import top_per_key
    sizes = {"phishing": 12, "smishing": 40, "vishing": 80}
    top = top_per_key(i.messages, ["message_type"], [F.desc("id")], max(sizes.values()))
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return top.filter(F.col("rank") <= size[F.col("message_type")]).select(*BASE)
