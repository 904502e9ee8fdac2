"""Source and sink queries: files are derived from the given tables, written whole and read back."""

import uuid

from pyspark.sql import functions as F

from msgsieve import schemas
from msgsieve.catalog.registry import Inputs, query
from msgsieve.operators import lookups as lk
from msgsieve.session import checkpoint_dir
from msgsieve.sources import mail, readers as rd, sinks as sk

AS_OF = "2024-01-20 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def folder(i: Inputs, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


def jsonl(i: Inputs, lines, name: str) -> str:
    path = folder(i, name)
    lines.write.option("compression", "none").text(path)
    return path


def arrays(i: Inputs, rows, file, record, name: str) -> str:
    """Files that hold one JSON array each: ``record`` of the rows with the same number ``file``."""
    path = folder(i, name)
    lines = rows.groupBy(file.alias("file")).agg(F.collect_list(record).alias("all")).select(F.to_json("all").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("S2_ingest_records", "SELECT CAST(doc_id AS varchar) AS id, source AS subject FROM documents")
def _(i: Inputs):
    record = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subject"), F.col("text").alias("body"))
    path = arrays(i, i.table("documents"), F.floor(F.col("doc_id") / 100), record, "ingest")
    return rd.read_ingest_batches(i.spark, path).select("id", "subject")


@query("S3_read_feedback", "SELECT event_id AS id, CAST(event_id % 2 AS varchar) AS label, event_type AS source FROM events WHERE event_type NOT IN ('error','signup')")
def _(i: Inputs):
    k = F.col("event_id")
    good = F.to_json(F.struct(k.cast("double").alias("ts"), (k % 2).alias("label"), F.col("event_type").alias("source"), F.struct(F.col("props").alias("subject")).alias("email")))
    line = F.when(F.col("event_type") == "error", F.lit('{"ts": 1, "label":')).when(F.col("event_type") == "signup", "").otherwise(good)
    path = jsonl(i, i.table("events").select(line.alias("value")), "feedback")
    return rd.read_feedback(i.spark, path).select(F.col("ts").cast("bigint").alias("id"), "label", "source")


@query("S4_append_feedback", "SELECT id, CAST(label AS varchar) AS label, 'console-grade' AS source FROM messages WHERE label IS NOT NULL", "messages")
def _(i: Inputs):
    path = folder(i, "feedback")
    m = i.messages.filter("label is not null").withColumn("subject", F.col("id").cast("string"))
    sk.append_feedback(m, path, "console-grade", as_of())
    return rd.read_feedback(i.spark, f"{path}/batch_id=current").select(F.col("email.subject").cast("bigint").alias("id"), "label", "source")


@query("S5_archive_feedback", "SELECT id, 'v1' AS batch_id FROM messages WHERE label IS NOT NULL", "messages")
def _(i: Inputs):
    path = folder(i, "archive")
    sk.archive_feedback(i.messages.filter("label is not null").select("id"), path, "v1")
    return i.spark.read.schema("id bigint, batch_id string").json(path)


@query("S6_read_golden", "SELECT doc_id AS id, toxic AS label FROM labels WHERE quality = 1")
def _(i: Inputs):
    line = F.to_json(F.struct(F.when(F.col("quality") == 1, F.col("toxic")).alias("label"), F.col("doc_id").cast("string").alias("subject"), F.lit("b").alias("body")))
    return rd.read_golden(i.spark, jsonl(i, i.table("labels").select(line.alias("value")), "golden")).select(F.col("subject").cast("bigint").alias("id"), "label")


@query("S7_read_seed_dropins", "SELECT conv_id, turn, CAST(turn % 2 AS int) AS label, md5(text) AS body_md5 FROM conversations WHERE role <> 'assistant' AND length(trim(text)) > 0")
def _(i: Inputs):
    path = folder(i, "seed")
    c = i.table("conversations")
    tag = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    line = F.to_json(F.struct(F.lit("").alias("transcript"), F.col("text").alias("body"), tag.alias("sender"), F.when(F.col("role") != "assistant", (F.col("turn") % 2).cast("string")).otherwise("maybe").alias("label")))
    c.select(line.alias("value")).write.text(path)
    got = i.spark.read.schema(schemas.RECORD).json(path)
    from msgsieve.functions.text import first_non_blank
    out = got.select(first_non_blank(*[F.col(x) for x in rd.SEED_TEXT["vishing"]]).alias("body"), "sender", F.col("label").try_cast("int").alias("label")).filter("body is not null and label is not null")
    return out.select(F.split_part("sender", F.lit(":"), F.lit(1)).cast("bigint").alias("conv_id"), F.split_part("sender", F.lit(":"), F.lit(2)).cast("bigint").alias("turn"), "label", F.md5("body").alias("body_md5"))


@query("S9_load_threat_list", "SELECT url AS body, 'url' AS message_type, 'acct1' AS account_sub, 1 AS is_threat, 1.0::DOUBLE AS confidence FROM pages WHERE page_id % 5 <> 0")
def _(i: Inputs):
    entry = F.struct(F.when(F.col("page_id") % 5 != 0, F.lit("url")).otherwise("").alias("type"), F.col("url").alias("identifier"))
    path = arrays(i, i.table("pages"), F.floor(F.col("page_id") / 100), entry, "threats")
    return rd.read_threat_list(i.spark, path, "acct1").select("body", "message_type", "account_sub", "is_threat", "confidence")


@query("S10_load_labelled_corpus", "SELECT id, md5(body) AS body_md5, sender, 'phishing' AS message_type, 1 AS is_threat, 'analyst_verified' AS label_source FROM messages", "messages")
def _(i: Inputs):
    out = rd.load_labelled_corpus(i.messages)
    return out.select("id", F.md5("body").alias("body_md5"), "sender", "message_type", "is_threat", F.get_json_object("metadata", "$.label_source").alias("label_source"))


def _audit_lines(i: Inputs):
    js = F.to_json(F.struct(F.lit("guard-a").alias("guard_name"), F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id")))
    line = F.concat(F.lit("2024 - INFO - "), F.when(F.col("event_id") % 17 == 0, "{broken").otherwise(js))
    return i.table("events").select(F.col("event_id").alias("pos"), line.alias("value"))


@query("S12_read_audit_log", "SELECT event_id AS pos, event_type, concat('u', user_id) AS user_id FROM events WHERE event_id % 17 <> 0 AND event_type = 'error' ORDER BY event_id LIMIT 100")
def _(i: Inputs):
    return rd.parse_audit_lines(_audit_lines(i), event_type="error", limit=100).select("pos", "event_type", "user_id")


@query("S13_tail_action_log", "SELECT event_id AS seq, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(i: Inputs):
    e = i.table("events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("action"))
    return rd.tail_action_log(e, 50).select("seq", "action")


@query("S14_read_sms_export", "SELECT e.event_id AS msg_id, coalesce(concat('+1888', lpad(CAST(c.c_custkey AS varchar), 7, '0')), 'Unknown') AS sender, epoch_us(e.ts) AS ts_us FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def _(i: Inputs):
    e = i.table("events")
    ns = (F.unix_micros("ts") - F.lit(rd.APPLE_EPOCH * 1_000_000)) * 1000
    m = e.select(F.col("event_id").alias("msg_id"), F.col("props").alias("text"), ns.alias("date"), F.lit(False).alias("is_from_me"), F.col("user_id").alias("handle_id"))
    h = i.table("customer").select(F.col("c_custkey").alias("rowid"), F.concat(F.lit("+1888"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("handle"))
    return rd.read_sms_export(m, h).select("msg_id", "sender", F.unix_micros("ts").alias("ts_us"))


@query("S15_read_call_export", f"SELECT event_id AS call_id, epoch(date_trunc('second', ts))::bigint AS ts_s, event_type = 'click' AS is_facetime FROM events WHERE date_trunc('second', ts) > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND date_trunc('second', ts) <= TIMESTAMP '{AS_OF}'")
def _(i: Inputs):
    e = i.table("events").select(F.col("event_id").alias("call_id"), (F.unix_seconds("ts") - rd.APPLE_EPOCH).alias("date"), F.lit(10).alias("duration"), F.lit("8005551001").alias("phone_number"),
                                 F.lit("in").alias("call_type"), F.when(F.col("event_type") == "click", "x").alias("face_time_data"))
    return rd.read_call_export(e, as_of()).select("call_id", F.unix_seconds("ts").alias("ts_s"), "is_facetime")


@query("S16_ingest_mail", "SELECT doc_id AS id, source AS subject, concat('Ä ', lang, ' <', lang, '@mail.example>') AS sender, md5(trim(text)) AS body_md5, concat('<d', doc_id, '@mail.example>') AS message_id, 2 AS hops FROM documents")
def _(i: Inputs):
    d = i.table("documents")
    head = F.concat(F.lit("From: =?utf-8?q?=C3=84_"), F.col("lang"), F.lit("?= <"), F.col("lang"), F.lit("@mail.example>\nTo: a@b.example\nSubject: "), F.col("source"),
                    F.lit("\nReceived: from x by y\nReceived: from z by x\nMessage-ID: <d"), F.col("doc_id").cast("string"),
                    F.lit("@mail.example>\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=\"b0\"\n\n--b0\nContent-Type: text/html; charset=utf-8\n\n<p>html</p>\n--b0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"))
    raw = F.concat(head, F.base64(F.col("text").cast("binary")), F.lit("\n--b0--\n")).cast("binary")
    out = mail.parse_mail(d.select(F.col("doc_id").cast("string").alias("path"), raw.alias("content")))
    return out.select(F.col("path").cast("bigint").alias("id"), "subject", "sender", F.md5(F.trim("body")).alias("body_md5"), "message_id", F.size("received").alias("hops"))


def _cache(i: Inputs):
    p, e = i.table("pages"), i.table("events")
    return p.join(e.select(F.col("event_id").alias("page_id"), F.timestamp_micros(F.unix_micros("ts")).alias("cached_at")), "page_id").select(
        F.md5("url").alias("url_key"), "url", F.lit(10).alias("risk_score"), (F.col("cached_at") + F.make_dt_interval(hours=F.lit(282))).alias("cached_at"))


_FRESH = f"SELECT p.url FROM pages p JOIN events e ON e.event_id = p.page_id WHERE TIMESTAMP '{AS_OF}' - (e.ts + INTERVAL 282 HOUR) < INTERVAL 7 DAY"


@query("S17_url_cache_misses", f"SELECT DISTINCT url, md5(url) AS url_key FROM pages WHERE url NOT IN ({_FRESH})")
def _(i: Inputs):
    return rd.url_cache_misses(i.table("pages"), _cache(i), as_of())


@query("S17_write_url_cache", "SELECT DISTINCT md5(url) AS url_key, url FROM pages")
def _(i: Inputs):
    path = folder(i, "urlcache")
    sk.write_url_cache(lk.url_risk(i.table("pages").select("url").distinct()), path, as_of())
    return rd.fresh_url_cache(i.spark.read.schema(schemas.URL_CACHE).parquet(path), as_of()).select("url_key", "url")


@query("S18_bench_snapshot", f"SELECT event_id AS id, TIMESTAMP '{AS_OF}' - ts > INTERVAL 6 HOUR AS stale FROM events")
def _(i: Inputs):
    path, hist = folder(i, "snap"), folder(i, "history")
    sk.write_bench_snapshot(i.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("generated_at")), path, hist)
    got = i.spark.read.schema("id bigint, generated_at timestamp").json(path)
    return rd.bench_snapshot(got, as_of()).select("id", "stale")


@query("S19_dead_letters", "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'threat' WHEN 'view' THEN 'processing' ELSE 'other' END AS kind FROM events WHERE NOT (event_type IN ('click','view') AND event_id % 5 = 0)")
def _(i: Inputs):
    path = folder(i, "dlq")
    k = F.col("event_id")
    rows = i.table("events").select(F.when(F.col("event_type") == "click", "threat").when(F.col("event_type") == "view", "processing").otherwise("other").alias("kind"), k.alias("id"),
                                    F.when(k % 5 == 0, "anon").otherwise("acct1").alias("account_sub"), F.col("props").alias("payload"), F.lit("x").alias("error"), F.lit(2).alias("retries"), F.col("ts").alias("failed_at"))
    sk.write_dead_letters(rows, path)
    return rd.read_dead_letters(i.spark, path).select("id", "kind")


@query("S20_write_alerts", "SELECT id, message_type AS type, confidence FROM messages WHERE is_threat = 1", "messages")
def _(i: Inputs):
    path = folder(i, "alerts")
    sk.write_alerts(i.messages, path, as_of())
    return i.spark.read.schema("id bigint, type string, confidence double").json(path)


@query("S22_threat_reports", "SELECT concat('THR-', id) AS report_id, sender, confidence AS threat_score, array_to_string(list_sort(list_distinct(regexp_extract_all(received, '\\b((?:[0-9]{1,3}\\.){3}[0-9]{1,3})\\b', 1))), ',') AS originating_ips FROM messages WHERE is_threat = 1", "messages")
def _(i: Inputs):
    return sk.threat_reports(i.messages).select("report_id", "sender", "threat_score", "originating_ips")


@query("U1_training_set", """
SELECT id, label, 'db' AS origin FROM messages WHERE label IN (0,1) AND json_extract_string(metadata,'$.label_source') = 'human_grade' UNION ALL
SELECT message_id, CASE verdict WHEN 'block' THEN 1 ELSE 0 END, 'feedback' FROM grades WHERE verdict IN ('block','safe') UNION ALL SELECT item_id, 0, 'seed' FROM benchmark""", "messages grades")
def _(i: Inputs):
    from msgsieve.plans.training import training_set
    m = i.messages
    fb = i.view("grades").select(F.col("message_id").alias("id"), F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "safe", 0).alias("label"), F.lit("console-grade").alias("source"), F.lit("text").alias("text"), F.lit("").alias("sender"))
    seed = i.table("benchmark").select(F.col("item_id").alias("id"), F.lit(0).alias("label"), "text", F.lit("").alias("sender"))
    return training_set(seed, fb, m.select("id", "label", "metadata", F.col("body").alias("text"), "sender"), seed.limit(0)).select("id", "label", "origin")


@query("U4_set_intersection", "SELECT p.event_id, list_has_any(a, b) AS overlaps, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS missing FROM (SELECT event_id, [concat('k', event_id % 3), concat('k', event_id % 5), 'z'] AS a, [concat('k', user_id % 4), concat('k', event_id % 7)] AS b FROM events) p")
def _(i: Inputs):
    from msgsieve.functions.sets import compare_sets

    def key(c, n):
        return F.concat(F.lit("k"), (F.col(c) % n).cast("string"))
    e = i.table("events").select("event_id", F.array_distinct(F.array(key("event_id", 3), key("event_id", 5), F.lit("z"))).alias("a"), F.array_distinct(F.array(key("user_id", 4), key("event_id", 7))).alias("b"))
    return compare_sets(e, "a", "b").select("event_id", "overlaps", F.array_join("common", ",").alias("common"), F.array_join("missing", ",").alias("missing"))


@query("S21_retrain_report", "SELECT channel, count(*) AS n, CAST(count_if(pred IS NULL) AS bigint) AS errors FROM predictions GROUP BY 1", "predictions")
def _(i: Inputs):
    """Per-channel run results written as one report and read back."""
    p, path = i.view("predictions"), folder(i, "report")
    runs = [p.filter(F.col("channel") == c).groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("pred").isNull()).alias("errors"))
            for c in ("phishing", "smishing", "vishing")]
    sk.write_retrain_report(runs, path)
    return i.spark.read.schema("channel string, n bigint, errors bigint").json(path)
