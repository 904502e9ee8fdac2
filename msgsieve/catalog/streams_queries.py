"""Streaming queries: each reads a driver table as a file stream, runs to the end and returns what was written."""

import uuid

from pyspark.sql import functions as F

from msgsieve.catalog import fixtures
from msgsieve.catalog.columns_queries import HIGH
from msgsieve.catalog.keyed_queries import _ID
from msgsieve.catalog.lookups_queries import SAFE, _GEO
from msgsieve.catalog.registry import Inputs, ORACLES, query
from msgsieve.catalog.rollups_queries import PS, _SEQ  # noqa: F401
from msgsieve.catalog.verdict_queries import VERDICT
from msgsieve.models import text_model as tm
from msgsieve.operators import dedup
from msgsieve.plans.ingest import batch_ingest
from msgsieve.session import checkpoint_dir
from msgsieve.streaming import deadletter as dl, flow, state


def place(i: Inputs, name: str) -> str:
    return f"{checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(i: Inputs, name: str):
    """A driver table as a stream, be it one file or a folder of parts."""
    schema = i.spark.read.parquet(f"{i.sf_dir}/{name}.parquet").schema
    # As a pattern the path may name either; as a plain path a stream takes folders only.
    return flow.file_stream(i.spark, f"{i.sf_dir}/{name}.parque[t]", schema)


def event_stream(i: Inputs):
    return table_stream(i, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def document_stream(i: Inputs):
    return table_stream(i, "documents")


def appended(i: Inputs, df, name: str):
    path = place(i, name)
    flow.append_available(df, path, place(i, f"{name}-ckpt"))
    return i.spark.read.schema(df.schema).parquet(path)


def message_stream(i: Inputs):
    """The portable messages view over the documents as a stream; its other tables are static."""
    i.messages
    document_stream(i).createOrReplaceTempView("documents")
    stream = i.spark.sql(fixtures.VIEWS["messages"].replace("D0)", "D)").replace("D0,", "D,"))
    i.table("documents").createOrReplaceTempView("documents")
    return stream


def published_models(i: Inputs) -> str:
    """Both versions of the model view, published in turn."""
    path, rows = place(i, "models"), i.view("model_terms")
    for version in (1, 2):
        own = rows.filter(F.col("version") == version)
        numbers = {r["term"]: float(r["weight"]) for r in own.filter("kind = 'x'").collect()}
        terms = own.filter("kind = 'w'").withColumn("idx", F.pmod(F.xxhash64("term"), F.lit(2 ** 31 - 1)).cast("int"))
        tm.publish_model(tm.TextModel(terms, (), (), numbers["intercept"], numbers["platt_a"], numbers["platt_b"], True), path, version)
    return path


def model_sql(text: str) -> str:
    """CTEs up to ``ml`` (id, model_pred, model_conf): sums of term weights of the newest version."""
    tok = f"regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)"
    return f"""mt AS (SELECT term, idf, weight FROM model_terms WHERE kind = 'w' AND version = (SELECT max(version) FROM model_terms)),
mx AS (SELECT max(CASE WHEN term = 'intercept' THEN weight END) AS i0, max(CASE WHEN term = 'platt_a' THEN weight END) AS pa, max(CASE WHEN term = 'platt_b' THEN weight END) AS pb
  FROM model_terms WHERE kind = 'x' AND version = (SELECT max(version) FROM model_terms)),
mw AS (SELECT id, {text} AS t, {tok} AS t1 FROM messages),
mg AS (SELECT id, unnest(list_concat(list_concat(t1, list_transform(range(1, greatest(len(t1), 1)), lambda i: array_to_string(list_slice(t1, i, i + 1), ' '))), list_transform(range(1, greatest(len(t1) - 1, 1)), lambda i: array_to_string(list_slice(t1, i, i + 2), ' ')))) AS term FROM mw),
mc AS (SELECT id, term, (ln(count(*)) + 1) * any_value(idf) AS x, any_value(weight) AS w FROM mg JOIN mt USING (term) GROUP BY id, term),
mm AS (SELECT id, sum(x * w) / sqrt(sum(x * x)) AS m FROM mc GROUP BY id),
mp AS (SELECT mw.id, CASE WHEN length(trim(t)) = 0 THEN 0 ELSE 1 / (1 + exp(-((coalesce(m, 0) + i0) * pa + pb))) END AS p, length(trim(t)) = 0 AS blank FROM mw LEFT JOIN mm USING (id) CROSS JOIN mx),
ml AS (SELECT id, (NOT blank AND p >= 0.5)::int AS model_pred, CASE WHEN blank THEN 0 WHEN p >= 0.5 THEN p ELSE 1 - p END AS model_conf FROM mp)"""


@query("R1_stream_score", f"""
WITH {VERDICT}, {model_sql("trim(concat(sender, ' ', body))")},
s AS (SELECT pv.id, coalesce(policy_pred, model_pred) AS pred, coalesce(policy_confidence, model_conf) AS conf FROM pv JOIN ml USING (id))
SELECT id, pred, round(conf, 6) AS conf, CASE WHEN pred = 1 AND conf >= 0.85 THEN 'quarantine' WHEN pred = 1 THEN 'review' ELSE 'pass' END AS action, 2 AS model_version FROM s""", "messages fleet model_terms")
def _(i: Inputs):
    out = place(i, "scored")
    flow.score_available(message_stream(i), "smishing", published_models(i), out, place(i, "ckpt"), i.view("fleet"), ["id", "pred", "conf", "action", "model_version"])
    return i.spark.read.schema("id bigint, pred int, conf double, action string, model_version int").parquet(out).withColumn("conf", F.round("conf", 6)).drop("batch")


@query("R1_stream_policy", f"""
WITH {VERDICT}, s AS (SELECT id, coalesce(policy_pred, 0) AS pred, coalesce(policy_confidence, 0.5) AS conf FROM pv)
SELECT id, CASE WHEN pred = 1 AND conf >= 0.85 THEN 'quarantine' WHEN pred = 1 THEN 'review' ELSE 'pass' END AS action FROM s""", "messages fleet")
def _(i: Inputs):
    return appended(i, flow.stream_score(message_stream(i), "smishing", i.view("fleet")).select("id", "action"), "policy")


@query("R3_retry_dead_letter", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'stored' END AS place FROM events WHERE NOT (event_type = 'error' AND event_id % 5 = 0)")
def _(i: Inputs):
    e = event_stream(i).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "anon").otherwise("acct1").alias("account_sub"), "event_type")
    good, dead = place(i, "good"), place(i, "dead")
    flow.run_available(e, dl.durable_sink(good, dead, F.col("event_type") == "error"), place(i, "ckpt"))
    a = i.spark.read.schema("id bigint, batch_id int").parquet(good).select("id", F.lit("stored").alias("place"))
    return a.unionByName(i.spark.read.schema("id bigint, batch_id int").parquet(dead).select("id", F.lit("dead").alias("place")))


@query("R5_replay_dead_letters", "WITH h AS (SELECT * FROM (SELECT * FROM events WHERE user_id % 6 <> 0 AND event_type='click')) SELECT event_id AS id FROM h WHERE NOT EXISTS (SELECT 1 FROM h f WHERE f.event_id % 97 = 96 AND (f.ts < h.ts OR (f.ts = h.ts AND f.event_id <= h.event_id)))")
def _(i: Inputs):
    e = i.table("events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("user_id") % 6 == 0, "").otherwise("acct1").alias("account_sub"), F.col("ts").alias("failed_at"))
    return dl.replay_dead_letters(e, F.col("id") % 97 != 96, "click")[0].select("id")


@query("R6_stream_dedup", "SELECT user_id, count(*) > 0 AS seen FROM events GROUP BY 1")
def _(i: Inputs):
    e = flow.stream_dedup(event_stream(i).select("user_id", "ts"), ["user_id"], "ts", "60 days")
    return appended(i, e, "dedup").groupBy("user_id").agg((F.count("*") == 1).alias("seen"))


@query("R7_stream_duplicate_requests", ORACLES["R7_duplicate_requests"])
def _(i: Inputs):
    log = event_stream(i).select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 50).alias("key"),
                                 F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("request_hash"), ((F.col("event_id") % 3) * 3_600_000_000).alias("done_us"))
    return appended(i, state.stream_duplicate_requests(log, expire=False), "requests").withColumn("key", F.col("key").cast("bigint"))


@query("R8_stream_grade_velocity", ORACLES["W3_grade_velocity"])
def _(i: Inputs):
    g = event_stream(i).select(F.col("event_id").alias("id"), "ts", F.when(F.col("user_id") % 2 == 0, "phishing").otherwise("smishing").alias("channel"),
                               F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("campaign_id"),
                               F.when(F.col("event_type") == "click", "block").when(F.col("event_type") == "view", "safe").otherwise("unsure").alias("verdict"))
    return appended(i, state.stream_grade_velocity(g, expire=False), "velocity").select("id", "n", "fired")


@query("R9_stream_over_limit", ORACLES["W6_token_bucket_flags"].replace("SELECT id, key, allowed, round(tokens, 6) AS tokens FROM w", "SELECT id, key, allowed FROM w"))
def _(i: Inputs):
    log = event_stream(i).select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 50).alias("key"))
    return appended(i, state.stream_over_limit(log, 2.0, 0.00008, expire=False), "limit").select("id", F.col("key").cast("bigint").alias("key"), "allowed")


@query("R10_stream_kpis", "WITH h AS (SELECT date_trunc('hour', ts) AS h, event_type AS channel, count(*) AS threats FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) SELECT epoch_us(h) AS hour_us, channel, threats FROM h")
def _(i: Inputs):
    e = event_stream(i).select("ts", F.col("event_type").alias("message_type"), (F.col("event_id") % 2 == 0).cast("int").alias("is_threat"))
    path = place(i, "kpis")
    # Complete result of each batch, replacing the one before: the open hours are included.
    q = (flow.stream_kpis(e).writeStream.outputMode("complete").option("checkpointLocation", place(i, "ckpt"))
         .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start())
    q.awaitTermination()
    return i.spark.read.schema("hour timestamp, channel string, threats bigint").parquet(path).select(F.unix_micros("hour").alias("hour_us"), "channel", "threats")


@query("R11_stream_profiles", f"WITH s AS (SELECT source AS sender, doc_id AS id, (" + PS.replace("subject", "lang").replace("body", "text").replace("sender", "source") + ")::DOUBLE AS s FROM documents) SELECT sender AS email, count(*) AS email_count, round(list_reduce(list(s ORDER BY id), lambda a, b: a * 0.8 + b * 0.2), 6) AS threat_score FROM s GROUP BY 1")
def _(i: Inputs):
    m = document_stream(i).select(F.col("doc_id").alias("id"), F.col("source").alias("sender"), F.col("lang").alias("subject"), F.col("text").alias("body"), F.timestamp_seconds("doc_id").alias("ts"))
    path = place(i, "profiles")
    p = state.stream_profiles(m)
    q = p.writeStream.outputMode("update").option("checkpointLocation", place(i, "ckpt")).foreachBatch(
        lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/b={n}")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = i.spark.read.schema("email string, threat_score double, email_count bigint, first_us bigint, last_us bigint, batch bigint").parquet(path)
    return dedup.latest_per_key(got.select("email", "email_count", F.round("threat_score", 6).alias("threat_score"), "batch"), F.col("email"), F.col("batch")).drop("batch")


@query("R12_poll_increment", "SELECT count(*) AS rows FROM events")
def _(i: Inputs):
    return appended(i, event_stream(i).select("event_id"), "poll").agg(F.count("*").alias("rows"))


def fleet_report_stream(i: Inputs):
    return event_stream(i).select(F.col("ts").alias("created_at"), F.concat(F.lit("bulk"), (F.col("event_id") % 9).cast("string")).alias("sender_key"),
                                  F.concat(F.lit("acct"), F.col("user_id").cast("string")).alias("account_sub"), (F.col("event_type") == "view").alias("expected"))


# Windows end at midnight; those that the watermark (a day behind the newest unexpected report) has passed are closed.
_FLEET = """
r AS (SELECT epoch_us(ts) AS t, concat('bulk', event_id % 9) AS sender_key, user_id FROM events WHERE event_type <> 'view'),
k AS (SELECT (t // 86400000000 + 1 + d) * 86400000000 AS window_us, sender_key, user_id FROM r, range(30) AS x(d)),
f AS (SELECT window_us, sender_key, count(DISTINCT user_id) AS reporters FROM k WHERE window_us <= (SELECT max(t) FROM r) - 86400000000 GROUP BY 1, 2)"""


@query("R13_stream_fleet_counts", f"WITH {_FLEET} SELECT window_us, sender_key, reporters FROM f")
def _(i: Inputs):
    out = appended(i, flow.stream_fleet_counts(fleet_report_stream(i)), "fleet")
    return out.select(F.unix_micros("window_end").alias("window_us"), "sender_key", "reporters")


@query("R13_sketch_error", f"WITH {_FLEET} SELECT sender_key, count(*) AS windows, true AS within FROM f GROUP BY 1")
def _(i: Inputs):
    """Closed windows per key, and whether no sketch is off by more than five of its standard deviations."""
    exact = appended(i, flow.stream_fleet_counts(fleet_report_stream(i)), "fleet")
    sketch = appended(i, flow.stream_fleet_sketch(fleet_report_stream(i)), "fleet-sketch").withColumnRenamed("reporters", "about")
    both = exact.join(sketch, ["window_end", "sender_key"], "full")
    off = F.abs(F.col("about") - F.col("reporters")) / F.col("reporters")
    return both.groupBy("sender_key").agg(F.count("*").alias("windows"), F.every(F.coalesce(off <= 5 * 0.05, F.lit(False))).alias("within"))


@query("R4_durable_persist", "SELECT event_id AS id FROM events WHERE event_id % 10 <> 3")
def _(i: Inputs):
    e = event_stream(i).select(F.col("event_id").alias("id"), F.lit("acct1").alias("account_sub"))
    good, dead, ckpt = place(i, "good"), place(i, "dead"), place(i, "ckpt")
    sink = dl.durable_sink(good, dead, F.col("id") % 10 == 3)
    # The same batch written twice, as after a failure, leaves one copy.
    flow.run_available(e, lambda df, n: (sink(df, n), sink(df, n))[0], ckpt)
    return i.spark.read.schema("id bigint, batch_id int").parquet(good).select("id")


@query("R15_batch_ingest", f"""
WITH fresh AS (SELECT id, received FROM messages WHERE id NOT IN (SELECT id FROM (WITH {_ID} SELECT id FROM best))),
links AS (SELECT id, n FROM ({HIGH} SELECT id, n FROM high)),
policy AS (SELECT id, policy_pred, policy_confidence FROM (WITH {VERDICT} SELECT * FROM pv)),
model AS (SELECT * FROM (WITH {model_sql("trim(concat(sender, ' ', body))")} SELECT * FROM ml)),
allowed AS (SELECT id, tier FROM (WITH {SAFE} SELECT * FROM safe)),
place AS (SELECT ip, country_code, risk_level FROM (WITH {_GEO} SELECT * FROM geo)),
origin AS (SELECT id, list_extract(list_sort(list_distinct(list_filter(regexp_extract_all(received, '\\b([0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}})\\b', 1),
  lambda ip: len(list_filter(string_split(ip, '.'), lambda o: CAST(o AS int) > 255)) = 0 AND NOT regexp_matches(ip, '^(127\\.|10\\.|192\\.168\\.|172\\.16\\.|172\\.31\\.)')))), 1) AS ip FROM fresh),
v AS (SELECT id, coalesce(links.n, 0) AS n, CASE WHEN tier IS NOT NULL THEN 0.02 ELSE coalesce(policy_confidence, model_conf) END AS c, CASE WHEN tier IS NOT NULL THEN 0 ELSE coalesce(policy_pred, model_pred) END AS p
  FROM fresh JOIN policy USING (id) JOIN model USING (id) LEFT JOIN links USING (id) LEFT JOIN allowed USING (id))
SELECT v.id, CASE WHEN n > 0 THEN 1 ELSE p END AS is_threat, round(CASE WHEN n > 0 THEN greatest(c, 0.85) ELSE c END, 6)::DOUBLE AS confidence, country_code, risk_level, n::int AS high_risk_links
FROM v JOIN origin USING (id) LEFT JOIN place ON place.ip = origin.ip""", "messages fleet ip_ranges safe_rules model_terms")
def _(i: Inputs):
    m = i.timeless_messages.withColumn("ingest_fp", F.sha2("body", 256))
    stored = m.filter(F.col("label").isNotNull())
    model = tm.load_model(i.spark, published_models(i))
    out = batch_ingest(m, stored, i.view("fleet"), i.view("ip_ranges"), i.view("safe_rules"), model=model)
    return out.select("id", "is_threat", F.round("confidence", 6).alias("confidence"), "country_code", "risk_level", "high_risk_links")


@query("A21_stream_stats", "SELECT count(*) AS submitted, count_if(event_type <> 'error')::bigint AS processed, count_if(event_type='error')::bigint AS dead_lettered, count_if(event_type='click')::bigint AS threats, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS avg_latency_ms, 0 AS dropped FROM events")
def _(i: Inputs):
    from msgsieve.operators.rollups import stream_stats
    e = i.table("events")
    v = e.filter("event_type <> 'error'").select((F.col("event_type") == "click").alias("is_threat"), F.col("value").alias("latency_ms"))
    out = stream_stats(v, e.filter("event_type = 'error'").select(F.lit(2).alias("retries")))
    return out.select("submitted", "processed", "dead_lettered", "threats", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "dropped")




@query("R2_bounded_intake", "SELECT event_id AS id FROM events")
def _(i: Inputs):
    """Batches are bounded by the source's own admission control (files per trigger); no row is refused."""
    e = event_stream(i).select(F.col("event_id").alias("id"))
    path = place(i, "intake")
    flow.run_available(e, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch_id={n}"), place(i, "ckpt"))
    return i.spark.read.schema("id bigint, batch_id int").parquet(path).select("id")
