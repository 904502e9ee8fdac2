"""Readers: message tables, ingest batches, logs, exports, packs, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve import schemas
from msgsieve.functions.text import first_non_blank, text_or_empty
from msgsieve.operators.filters import require_tenant, tenant_scope
from msgsieve.operators.lookups import sms_with_handles

MESSAGE_COLUMNS = ["id", "account_sub", "message_type", "sender", "ts", "subject", "is_threat", "confidence", "label", "metadata"]
APPLE_EPOCH = 978_307_200


def read_messages(spark: SparkSession, path: str, account_sub: str | None = None) -> DataFrame:
    """Message facts with a fixed column list; tenant and column pruning reach the scan."""
    df = spark.read.schema(schemas.MESSAGE).parquet(path)
    if account_sub is not None:
        df = tenant_scope(df, account_sub)
    return df.select(*MESSAGE_COLUMNS)


def _good(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_ingest_batches(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Records of all JSON-array files, or of the ``newest`` by name; entries that are no objects are skipped.

    Only the list of file names is ordered, never the records.
    """
    raw = spark.read.schema(schemas.INGEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    named = raw.withColumn("file", F.col("_metadata.file_name"))
    if newest is None:
        return _good(named)
    names = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file")).orderBy(F.desc("file")).limit(newest))
    return _good(named.join(F.broadcast(names), "file"))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines; blank and broken lines are dropped."""
    df = spark.read.schema(schemas.FEEDBACK).option("mode", "PERMISSIVE").json(path)
    return _good(df).filter(F.col("label").isNotNull())


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Held-out lines that carry a label."""
    return _good(spark.read.schema(schemas.GOLDEN).option("mode", "PERMISSIVE").json(path)).filter(F.col("label").isNotNull())


SEED_TEXT = {"phishing": ["body", "text", "message", "snippet"], "smishing": ["body", "message", "text"], "vishing": ["transcript", "body", "text"]}


def read_seed_dropins(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """Labelled drop-in lines as channel records; lines without text or a whole-number label are dropped."""
    df = spark.read.schema(schemas.RECORD).option("pathGlobFilter", "*.jsonl").option("mode", "PERMISSIVE").json(path)
    text = first_non_blank(*[F.col(c) for c in SEED_TEXT[channel]])
    sender = F.coalesce(first_non_blank(F.col("from"), F.col("sender"), F.col("caller_id")), F.lit(""))
    out = df.select(text.alias("body"), sender.alias("sender"), F.col("label").try_cast("int").alias("label"))
    return out.filter(F.col("body").isNotNull() & F.col("label").isNotNull())


def read_campaign_packs(spark: SparkSession, path: str) -> DataFrame:
    """Pack files as (number, campaign_id, action, label, ord); label entries may be text or {number, label}."""
    raw = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").schema(
        "campaign_id string, block array<string>, label array<variant>, default_label string").json(path)
    raw = raw.withColumns({"file": F.col("_metadata.file_name")})
    raw = raw.withColumn("campaign_id", F.coalesce("campaign_id", F.regexp_replace("file", r"\.json$", "")))
    fallback = F.coalesce("default_label", F.lit("Suspicious caller"))
    # Few files: the rank of a file name orders the packs.
    files = raw.select("file").distinct()
    order = files.groupBy().agg(F.array_sort(F.collect_set("file")).alias("_all"), F.lit(1).alias("_k"))
    raw = raw.withColumn("_k", F.lit(1)).join(F.broadcast(order), "_k").withColumn("ord", F.array_position("_all", F.col("file")))
    block = raw.select(F.explode("block").alias("number"), "campaign_id", F.lit("block").alias("action"), F.lit("").alias("label"), "ord")
    entry = raw.select("campaign_id", fallback.alias("fallback"), "ord", F.explode("label").alias("e"))
    number = F.coalesce(F.try_variant_get("e", "$.number", "string"), F.try_variant_get("e", "$", "string"))
    named = F.coalesce(F.try_variant_get("e", "$.label", "string"), F.col("fallback"))
    label = entry.select(number.alias("number"), "campaign_id", F.lit("label").alias("action"), named.alias("label"), "ord")
    return block.unionByName(label)


def read_threat_list(spark: SparkSession, path: str, account_sub: str) -> DataFrame:
    """Bulk threat list as confirmed threat messages of one tenant; entries without a type are skipped."""
    sub = require_tenant(account_sub)
    raw = spark.read.schema(schemas.THREAT).option("multiLine", True).json(path)
    return raw.filter(text_or_empty(F.col("type")) != "").select(
        F.lit(sub).alias("account_sub"), F.col("type").alias("message_type"), F.when(F.col("type") == "sender", F.col("identifier")).alias("sender"),
        F.col("identifier").alias("body"), F.lit(1).alias("is_threat"), F.lit(1.0).alias("confidence"), "metadata")


def load_labelled_corpus(df: DataFrame, source: str = "corpus") -> DataFrame:
    """Verified corpus rows in message form: body else subject."""
    content = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("subject"))
    return df.select("id", content.alias("body"), "sender",
                     F.to_json(F.struct("subject", F.lit(1).alias("label"),
                                        F.lit("analyst_verified").alias("label_source"), F.lit(source).alias("source"))).alias("metadata"),
                     F.lit("phishing").alias("message_type"), F.lit(1).alias("is_threat"))


class ChallengeError(ValueError):
    """A challenge file breaks its non-training contract."""


def read_action_challenge(spark: SparkSession, path: str) -> DataFrame:
    """Challenge rows; refuses files that are trainable, claim evidence or carry labels."""
    raw = spark.read.schema(schemas.CHALLENGE).option("multiLine", True).json(path)
    bad = raw.agg(
        F.coalesce(F.bool_or(F.coalesce(F.col("purpose") != "action_challenge", F.lit(True))), F.lit(True)).alias("purpose"),
        F.bool_or(F.coalesce("training_eligible", F.lit(True))).alias("trainable"),
        F.bool_or(F.coalesce("release_evidence", F.lit(True))).alias("evidence"),
        F.bool_or(F.exists("rows", lambda r: r["label"].isNotNull())).alias("labelled")).first()
    broken = [k for k, v in bad.asDict().items() if v]
    if broken:
        raise ChallengeError(f"challenge contract broken: {', '.join(broken)}")
    return raw.select(F.explode("rows").alias("r")).select("r.id", "r.group_id", "r.taxonomy", "r.expected_action", "r.scenario", "r.transcript")


def parse_audit_lines(lines: DataFrame, guard: str | None = None, event_type: str | None = None, user: str | None = None,
                      limit: int | None = None) -> DataFrame:
    """Audit events from text lines (pos, value): JSON after the last `` - ``; filters combine; first ``limit``."""
    e = F.from_json(F.substring_index("value", " - ", -1), schemas.AUDIT)
    out = lines.select("pos", e.alias("e")).filter(F.col("e.event_type").isNotNull() | F.col("e.guard_name").isNotNull()).select("pos", "e.*")
    for name, want in (("guard_name", guard), ("event_type", event_type), ("user_id", user)):
        if want is not None:
            out = out.filter(F.col(name) == want)
    return out.orderBy("pos").limit(limit) if limit else out


def read_audit_log(spark: SparkSession, path: str, **filters) -> DataFrame:
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return parse_audit_lines(lines, **filters)


def tail_action_log(df: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` actions, oldest first."""
    return df.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")


def apple_time(value: Column, unit: str) -> Column:
    """Export clock to an instant: seconds or nanoseconds since 2001, or plain epoch seconds."""
    if unit == "apple_ns":
        return F.timestamp_micros(F.floor(value.cast("decimal(20,0)") / 1000).cast("bigint") + F.lit(APPLE_EPOCH * 1_000_000))
    if unit == "apple_s":
        return F.timestamp_seconds(value + APPLE_EPOCH)
    return F.timestamp_seconds(value)


def read_sms_export(messages: DataFrame, handles: DataFrame, unit: str = "apple_ns", limit: int | None = None) -> DataFrame:
    return sms_with_handles(messages, handles, limit=limit).withColumn("ts", apple_time(F.col("date"), unit))


def read_call_export(calls: DataFrame, as_of: Column, unit: str = "apple_s") -> DataFrame:
    """Calls of the last day, newest first."""
    ts = apple_time(F.col("date"), unit)
    out = calls.withColumn("ts", ts).filter((F.col("ts") > as_of - F.make_dt_interval(days=F.lit(1))) & (F.col("ts") <= as_of))
    return out.select("call_id", "ts", "duration", F.col("phone_number").alias("caller_id"), F.lit("voice").alias("type"), "call_type",
                      F.coalesce(F.length("face_time_data") > 0, F.lit(False)).alias("is_facetime")).orderBy(F.desc("ts"), "call_id")


def fresh_url_cache(cache: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Cached link verdicts still valid, the newest per link."""
    ok = cache.filter(as_of - F.col("cached_at") < F.make_dt_interval(days=F.lit(days)))
    cols = [c for c in cache.columns if c != "url_key"]
    return ok.groupBy("url_key").agg(F.max_by(F.struct(*cols), "cached_at").alias("v")).select("url_key", "v.*")


def url_cache_misses(links: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Distinct links without a valid cached verdict."""
    keyed = links.select("url").distinct().withColumn("url_key", F.md5("url"))
    return keyed.join(fresh_url_cache(cache, as_of).select("url_key"), "url_key", "left_anti")


def bench_snapshot(df: DataFrame, as_of: Column, max_age_hours: int = 6) -> DataFrame:
    """Snapshots with a ``stale`` flag by age."""
    return df.withColumn("stale", as_of - F.col("generated_at") > F.make_dt_interval(hours=F.lit(max_age_hours)))


def read_dead_letters(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    df = spark.read.schema(schemas.DEAD_LETTER).parquet(path)
    return df.filter(F.col("kind") == kind) if kind else df
