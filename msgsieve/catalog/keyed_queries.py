"""Duplicate handling and keyed-snapshot queries."""

from pyspark.sql import functions as F

from msgsieve.catalog import sqltext as q
from msgsieve.catalog.registry import Inputs, query
from msgsieve.functions.text import text_or_empty
from msgsieve.operators import dedup, keyed as k


def _halves(i: Inputs):
    """Stored mail and a re-delivered batch: the batch is every message, stored are the graded ones."""
    m = i.messages.withColumn("ingest_fp", F.sha2("body", 256))
    stored = m.filter(F.col("label").isNotNull())
    return m, stored


_ID = """
k AS (SELECT id, account_sub, mailbox_id, label,
  CASE WHEN coalesce(provider,'')<>'' THEN concat('1|', provider, '|', provider_uid, '|', uidvalidity, '|', coalesce(folder,'')) END AS us,
  CASE WHEN coalesce(provider,'')<>'' THEN concat('1|', provider, '|', provider_uid, '|', uidvalidity, '|', coalesce(folder,'INBOX')) END AS ub,
  concat('2|', rfc_message_id) AS m, concat('3|', sha256(body)) AS f FROM messages),
b AS (SELECT id, account_sub, mailbox_id, unnest([ub, m, f]) AS key FROM k), s AS (SELECT id AS eid, account_sub, mailbox_id, unnest([us, m, f]) AS key FROM k WHERE label IS NOT NULL),
x AS (SELECT b.id, left(b.key, 1) AS tier, eid FROM b JOIN s ON b.key = s.key AND b.account_sub = s.account_sub AND b.mailbox_id = s.mailbox_id),
best AS (SELECT id, CAST(tier AS int) AS tier, eid AS existing_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, eid) AS rn FROM x) WHERE rn = 1)"""


@query("J2_existing_matches", f"WITH {_ID} SELECT id, tier, existing_id FROM best", "messages")
def _(i: Inputs):
    batch, stored = _halves(i)
    return dedup.existing_matches(batch, stored)


@query("U5_missing_after_ingest", f"WITH {_ID} SELECT id, account_sub, mailbox_id FROM messages WHERE id NOT IN (SELECT id FROM best)", "messages")
def _(i: Inputs):
    return dedup.new_messages(*_halves(i)).select("id", "account_sub", "mailbox_id")


@query("D12_append_messages", f"WITH {_ID} SELECT id, account_sub FROM messages WHERE label IS NOT NULL UNION ALL SELECT id, account_sub FROM messages WHERE id NOT IN (SELECT id FROM best)", "messages")
def _(i: Inputs):
    batch, stored = _halves(i)
    return k.append_messages(stored, batch).select("id", "account_sub")


def _collapse_sql(dupes: str, key: str, stamp: str) -> str:
    hit = f"d.keep_id IS NOT NULL AND m.id <> d.keep_id AND m.label IS NULL"
    return f"""WITH d AS ({dupes}) SELECT m.id, CASE WHEN {hit} THEN 0 ELSE m.label END AS label, CASE WHEN {hit} THEN 0 ELSE m.is_threat END AS is_threat,
 CASE WHEN {hit} THEN least(m.confidence, 0.05) ELSE m.confidence END::DOUBLE AS confidence, CASE WHEN {hit} THEN '{stamp}' END AS stamp FROM messages m LEFT JOIN d ON d.{key} = m.{key}"""


@query("J3_collapse_duplicates", _collapse_sql("SELECT rfc_message_id, min(id) AS keep_id FROM messages GROUP BY 1 HAVING count(*) > 1", "rfc_message_id", "collapsed_rfc_message_id"), "messages")
def _(i: Inputs):
    return dedup.collapse_duplicates(i.messages).select("id", "label", "is_threat", "confidence", "stamp")


@query("J4_collapse_sender_flood", _collapse_sql("SELECT sender, min(id) AS keep_id FROM messages WHERE label IS NULL AND (sender ILIKE '%@gmail.com%' OR sender ILIKE '%arnazon%') GROUP BY 1 HAVING count(*) > 2", "sender", "collapsed_sender_flood"), "messages")
def _(i: Inputs):
    return dedup.collapse_sender_flood(i.messages, ["%@gmail.com%", "%arnazon%"]).select("id", "label", "is_threat", "confidence", "stamp")


@query("W2_keep_first_id", "SELECT rfc_message_id, min(id) AS keep_id, count(*) AS n FROM messages GROUP BY 1 HAVING count(*) > 1", "messages")
def _(i: Inputs):
    return dedup.keep_first_id(i.messages, "rfc_message_id")


@query("W1_latest_per_key", "SELECT max(id) AS id, coalesce(nullif(rfc_message_id,''), subject) AS thread FROM messages GROUP BY 2", "messages")
def _(i: Inputs):
    m = i.messages
    return dedup.latest_per_key(m.select("id", dedup.thread_key(m).alias("thread")), F.col("thread"), F.col("id"))


@query("J5_sender_siblings", """
WITH one AS (SELECT sender FROM messages WHERE id = 20 AND account_sub = 'acct6'),
s AS (SELECT m.id, substr(m.subject, 1, 120) AS subject, m.confidence, coalesce(nullif(m.rfc_message_id,''), m.subject) AS thread FROM messages m JOIN one ON one.sender = m.sender WHERE m.account_sub='acct6' AND m.label IS NULL AND m.id <> 20)
SELECT thread, id, subject, confidence FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY id DESC) AS rn FROM s) WHERE rn = 1 ORDER BY thread LIMIT 80""", "messages")
def _(i: Inputs):
    return dedup.sender_siblings(i.messages, "acct6", 20)


# --- snapshots ---------------------------------------------------------------
@query("D1_upsert_numbers", """
WITH n AS (SELECT number AS e164, arg_max(risk, seq) AS risk FROM (SELECT concat('+1888', right(concat('0000000', e.user_id), 7)) AS number, CAST((e.event_id * 53) % 101 AS double) / 100 AS risk, e.event_id AS seq FROM events e) GROUP BY 1)
SELECT coalesce(n.e164, r.e164) AS e164, coalesce(n.risk, r.risk) AS risk FROM number_reputation r FULL JOIN n ON n.e164 = r.e164""", "number_reputation")
def _(i: Inputs):
    return k.upsert_numbers(*number_changes(i)).select("e164", "risk")


def number_changes(i: Inputs):
    old = i.view("number_reputation").select("e164", "risk")
    e = i.table("events")
    new = e.select(F.concat(F.lit("+1888"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("e164"),
                   ((F.col("event_id") * 53 % 101).cast("double") / 100).alias("risk"), F.col("event_id").alias("seq"))
    return old, new


@query("D2_upsert_fleet_keys", """
WITH n AS (SELECT sender_key, 0.7 AS c, count(DISTINCT account_sub) AS n FROM reports GROUP BY 1), o AS (SELECT sender_key, confidence, 1 AS report_count FROM fleet UNION ALL SELECT 'bulk1.example', 0.5, 2)
SELECT coalesce(n.sender_key, o.sender_key) AS sender_key, least(o.confidence, n.c)::DOUBLE AS confidence, coalesce(n.n, o.report_count) AS report_count FROM o FULL JOIN n ON n.sender_key = o.sender_key""", "reports fleet")
def _(i: Inputs):
    return k.upsert_fleet_keys(*fleet_changes(i))


def fleet_changes(i: Inputs):
    old = i.view("fleet").withColumn("report_count", F.lit(1)).unionByName(
        i.spark.createDataFrame([("bulk1.example", 0.5, 2)], "sender_key string, confidence double, report_count int"))
    new = i.view("reports").groupBy("sender_key").agg(F.lit(0.7).alias("confidence"), F.count_distinct("account_sub").alias("report_count"))
    return old, new


@query("D3_upsert_trial_fp", """
WITH n AS (SELECT fingerprint, count(*) AS n, max(signup_id % 90) AS r, arg_max(ip, signup_id) AS ip FROM signups WHERE fingerprint IS NOT NULL GROUP BY 1)
SELECT coalesce(n.fingerprint, o.fingerprint) AS fingerprint, coalesce(o.attempts, 0) + coalesce(n.n, 0) AS attempts, greatest(o.risk_score, n.r) AS risk_score, coalesce(n.ip, o.last_ip) AS last_ip FROM trial_fp o FULL JOIN n ON n.fingerprint = o.fingerprint""", "trial_fp signups")
def _(i: Inputs):
    return k.upsert_trial_fp(*trial_changes(i))


def trial_changes(i: Inputs):
    return i.view("trial_fp"), i.view("signups").filter("fingerprint is not null").withColumn("risk_score", F.col("signup_id") % 90)


_SAFE = """
l AS (SELECT DISTINCT m.account_sub, lower(trim(m.sender)) AS sender_pattern FROM grades g JOIN messages m ON m.id = g.message_id AND m.account_sub = g.account_sub WHERE g.verdict = 'safe'),
n AS (SELECT account_sub, sender_pattern, list_extract(string_split(sender_pattern, '@'), -1) AS domain, CASE WHEN contains(sender_pattern,'%') THEN 'pattern' WHEN contains(sender_pattern,'@') THEN 'exact' ELSE 'domain' END AS match_type FROM l WHERE sender_pattern <> '')"""


@query("D8_learn_safe_senders", f"WITH {_SAFE} SELECT account_sub, sender_pattern, domain, match_type, true AS auto_learned FROM n", "messages grades")
def _(i: Inputs):
    return k.learn_safe_senders(i.view("grades"), i.messages)


@query("D4_upsert_safe_senders", f"""
WITH {_SAFE}, o AS (SELECT account_sub, pattern AS sender_pattern, match_type FROM safe_rules)
SELECT coalesce(n.account_sub, o.account_sub) AS account_sub, coalesce(n.sender_pattern, o.sender_pattern) AS sender_pattern, coalesce(n.match_type, o.match_type) AS match_type, n.sender_pattern IS NOT NULL AS auto_learned
FROM o FULL JOIN n ON n.account_sub = o.account_sub AND n.sender_pattern = o.sender_pattern""", "messages grades safe_rules")
def _(i: Inputs):
    return k.upsert_safe_senders(*safe_sender_changes(i)).select("account_sub", "sender_pattern", "match_type", "auto_learned")


def safe_sender_changes(i: Inputs):
    old = i.view("safe_rules").select("account_sub", F.col("pattern").alias("sender_pattern"), "match_type", F.lit(False).alias("auto_learned"))
    new = k.learn_safe_senders(i.view("grades"), i.messages).select("account_sub", "sender_pattern", "match_type", "auto_learned").withColumn("seq", F.lit(1))
    return old, new


@query("D5_upsert_queue", """
WITH r AS (SELECT DISTINCT message_id, CASE WHEN verdict='block' THEN 'junk' ELSE 'trash' END AS action FROM grades)
SELECT coalesce(r.message_id, o.message_id) AS message_id, coalesce(r.action, o.action) AS action, CASE WHEN r.message_id IS NULL OR o.status = 'ok' THEN o.status ELSE 'pending' END AS status, coalesce(o.attempts, 0) AS attempts, r.message_id IS NOT NULL AS touched
FROM queue o FULL JOIN r ON r.message_id = o.message_id AND r.action = o.action""", "queue grades")
def _(i: Inputs):
    return k.upsert_queue(*queue_changes(i))


def queue_changes(i: Inputs):
    requests = i.view("grades").select("message_id", F.when(F.col("verdict") == "block", "junk").otherwise("trash").alias("action"))
    return i.view("queue").select("message_id", "action", "status", "attempts"), requests


@query("D6_insert_if_absent", "SELECT c_custkey AS account, 'old' AS origin FROM customer UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def _(i: Inputs):
    return k.insert_if_absent(*account_changes(i), ["account"])


def account_changes(i: Inputs):
    old = i.table("customer").select(F.col("c_custkey").alias("account"), F.lit("old").alias("origin"))
    return old, i.table("events").select(F.col("user_id").alias("account"), F.lit("new").alias("origin"))


@query("D7_apply_grades", """
WITH own AS (SELECT message_id AS id, account_sub, CASE verdict WHEN 'block' THEN 1 WHEN 'safe' THEN 0 END AS l, graded_at AS t FROM grades),
c AS (SELECT m.account_sub, m.sender, o.l, o.t, m.id AS src FROM messages m JOIN own o ON o.id = m.id AND o.account_sub = m.account_sub WHERE o.l IS NOT NULL),
j AS (SELECT m.id, m.label, m.is_threat, m.confidence, o.l AS ol, o.t AS ot, c.l AS cl, c.t AS ct FROM messages m LEFT JOIN own o ON o.id = m.id AND o.account_sub = m.account_sub LEFT JOIN c ON c.account_sub = m.account_sub AND c.sender = m.sender AND c.src <> m.id),
a AS (SELECT id, label, is_threat, confidence, ol, ot, arg_min(cl, ct) FILTER (WHERE label IS NULL AND (ot IS NULL OR ct < ot)) AS pre, arg_min(cl, ct) FILTER (WHERE ot IS NOT NULL AND ol IS NULL AND ct > ot) AS post FROM j GROUP BY ALL),
f AS (SELECT id, CASE WHEN ol IS NOT NULL THEN ol WHEN ot IS NOT NULL THEN post ELSE coalesce(label, pre) END AS label, coalesce(post, ol, pre, is_threat) AS is_threat,
 CASE WHEN pre = 0 OR ol = 0 OR post = 0 THEN 0.0 ELSE confidence END::DOUBLE AS confidence, (ot IS NULL AND pre IS NOT NULL) OR (ot IS NOT NULL AND post IS NOT NULL) AS cascaded FROM a)
SELECT * FROM f""", "messages grades")
def _(i: Inputs):
    return k.apply_grades(i.messages, i.view("grades")).select("id", "label", "is_threat", "confidence", "cascaded")


@query("D9_mark_promoted", "SELECT report_id, sender_key IN ('bulk1.example','bulk4.example') AS promoted_to_fleet, sender_key IN ('bulk1.example','bulk4.example') AS newly_promoted FROM reports", "reports")
def _(i: Inputs):
    keys = i.spark.createDataFrame([("bulk1.example",), ("bulk4.example",)], "sender_key string")
    return k.mark_promoted(i.view("reports"), keys).select("report_id", "promoted_to_fleet", "newly_promoted")


@query("D10_erase_tenant", """
SELECT 'messages' AS "table", count(*) AS removed FROM messages WHERE account_sub='acct2' UNION ALL SELECT 'user_reports', count(*) FROM reports WHERE account_sub='acct2'
UNION ALL SELECT 'provider_action_queue', count(*) FROM queue WHERE account_sub='acct2' UNION ALL SELECT 'safe_senders', count(*) FROM safe_rules WHERE account_sub='acct2'""", "messages reports queue safe_rules")
def _(i: Inputs):
    tables = {"messages": i.messages, "user_reports": i.view("reports"), "provider_action_queue": i.view("queue"), "safe_senders": i.view("safe_rules")}
    return k.erase_tenant(tables, "acct2")[1]


@query("D10_harvest_verified", """
SELECT id, message_type AS channel, subject, md5(body) AS body_md5, label, 'retained-verified' AS source,
 CASE WHEN regexp_extract(lower(trim(sender)), '^[^@\\s]+@([^@\\s]+)$', 1) <> '' THEN concat('redacted@', regexp_extract(lower(trim(sender)), '^[^@\\s]+@([^@\\s]+)$', 1))
  WHEN regexp_matches(trim(sender), '^\\+[0-9]+$') THEN concat('+', repeat('*', greatest(length(trim(sender)) - 5, 0)), right(trim(sender), 4)) ELSE 'redacted' END AS sender
FROM messages WHERE account_sub='acct4' AND label IN (0,1) AND json_extract_string(metadata,'$.label_source') = 'human_grade'""", "messages")
def _(i: Inputs):
    return k.harvest_verified(i.messages, "acct4").select("id", "channel", "subject", F.md5("body").alias("body_md5"), "label", "source", "sender")


@query("D11_metadata_patch", """
SELECT id, json_extract_string(metadata,'$.action') AS action, 'safe' AS review_status, 'console' AS label_source, json_extract_string(metadata,'$.anomaly_level') AS anomaly_level, '3' AS n FROM messages""", "messages")
def _(i: Inputs):
    out = k.metadata_patch(i.messages, F.lit('{"review_status":"safe","label_source":"console","n":3}'))
    g = [F.get_json_object("metadata", f"$.{x}").alias(x) for x in ("action", "review_status", "label_source", "anomaly_level", "n")]
    return out.select("id", *g)


@query("D13_block_list", """
WITH e AS (SELECT sender, max(id) AS seq, arg_max(confidence, id) AS score FROM messages WHERE is_threat = 1 GROUP BY 1)
SELECT m.id, m.sender FROM messages m WHERE m.sender IN (SELECT sender FROM e WHERE score >= 0.6)""", "messages")
def _(i: Inputs):
    m = i.messages
    entries = m.filter("is_threat = 1").select("sender", F.col("confidence").alias("score"), F.col("id").alias("seq"))
    blocked = k.list_upsert(entries.limit(0), entries)
    return k.listed(m, blocked.filter("score >= 0.6")).select("id", "sender")


@query("D14_encrypt_columns", "SELECT id, subject, md5(body) AS body_md5, true AS sealed FROM messages", "messages")
def _(i: Inputs):
    key = F.lit("0123456789abcdef")
    sealed = k.encrypt_columns(i.messages.select("id", "subject", "body"), ["subject", "body"], key)
    marked = sealed.withColumn("sealed", F.col("subject").startswith(k.ENCRYPTED_PREFIX) & F.col("body").startswith(k.ENCRYPTED_PREFIX))
    again = k.encrypt_columns(marked, ["subject", "body"], key)
    return k.decrypt_columns(again, ["subject", "body"], key).select("id", "subject", F.md5("body").alias("body_md5"), "sealed")
