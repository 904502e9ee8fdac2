"""Rollups: counts, distributions, profiles, statistics, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.functions.text import has_any, text_or_empty
from msgsieve.operators.filters import cleared, json_field, valid_tenant, with_threat_flag
from msgsieve.operators.ordered import newest_rank
from msgsieve.operators.quantiles import values_at


def kpi_by_channel(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.col("message_type").alias("channel"))
            .agg(F.count("*").alias("total"), F.coalesce(F.sum("is_threat"), F.lit(0)).alias("threats")).orderBy(F.desc("total"), "channel"))


def kpi_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.coalesce(F.sum("is_threat"), F.lit(0)).alias("threats"))


def kpi_json_dist(df: DataFrame, key: str) -> DataFrame:
    """Counts per value of a metadata key, over rows that have the key."""
    v = json_field(F.col("metadata"), key)
    return df.select(v.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))


def threats_per_hour(df: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return (df.filter((F.col("is_threat") == 1) & (F.col("ts") > since)).groupBy(F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.count("*").alias("threats")))


def kpi_rollup(df: DataFrame) -> DataFrame:
    """Threats by channel and hour with subtotals."""
    return (df.filter(F.col("is_threat") == 1).withColumn("hour", F.date_trunc("hour", "ts"))
            .rollup("message_type", "hour").agg(F.count("*").alias("threats")))


def review_counts(df: DataFrame) -> DataFrame:
    """Band counts of the review queue."""
    held = F.count_if(F.col("label").isNull() & (F.col("confidence") >= 0.85))
    return df.agg(held.alias("total"), held.alias("quarantined"), F.lit(0).alias("potential"), F.lit(0).alias("unsure"))


def inbox_counts(df: DataFrame) -> DataFrame:
    """Threat and cleared counts; graded-safe rows count as cleared."""
    flagged = with_threat_flag(df.withColumn("_cleared", cleared(df)))
    live = ~F.col("_cleared")
    return flagged.agg(F.count_if(live & F.col("threat")).alias("threat"), F.count_if(~live | ~F.col("threat")).alias("cleared"),
                       F.count("*").alias("all"))


def dashboard_stats(df: DataFrame) -> DataFrame:
    n = F.count("*")
    flagged = with_threat_flag(df.withColumn("_cleared", cleared(df)))
    return flagged.agg(n.alias("total"), F.count_if(~F.col("_cleared") & F.col("threat")).alias("threats"),
                       F.concat(F.format_string("%.1f", F.greatest(F.lit(0.1), n / 60)), F.lit("/m")).alias("rate"))


# --- shared threat list ------------------------------------------------------
FLEET_AUTO, FLEET_REVIEW, FLEET_CAP, FLEET_DAYS = 8, 3, 0.75, 30


def fleet_promotion(reports: DataFrame, as_of: Column, enabled: bool = False) -> DataFrame:
    """Distinct reporters per sender key in 30 days and what follows; off unless enabled.

    Distinct counting dedups (key, reporter) on the map side first, so one
    heavily reported key is spread over many tasks.
    """
    since = as_of - F.make_dt_interval(days=F.lit(FLEET_DAYS))
    n = (reports.filter((F.col("sender_key") != "") & (F.col("expected") == F.lit(False)) & (F.col("created_at") >= since))
         .groupBy("sender_key").agg(F.count_distinct("account_sub").alias("count")))
    status = (F.when(F.lit(not enabled), "disabled").when(F.col("count") >= FLEET_AUTO, "auto_promoted")
              .when(F.col("count") >= FLEET_REVIEW, "analyst_review").otherwise("recorded"))
    return n.withColumns({"status": status, "confidence": F.when(F.lit(enabled) & (F.col("count") >= FLEET_AUTO), F.lit(FLEET_CAP))})


# --- sender profiles ---------------------------------------------------------
PROFILE_WORDS = ["urgent", "verify", "suspended", "action required", "click here"]
PROFILE_TLDS = [".ru", ".cn", ".top", ".xyz"]


def profile_score(sender: Column, subject: Column, body: Column) -> Column:
    low, head = F.lower(text_or_empty(body)), F.lower(text_or_empty(subject))
    hits = sum(((low.contains(w) | head.contains(w)).cast("int") for w in PROFILE_WORDS), F.lit(0))
    domain = F.when(sender.contains("@"), F.element_at(F.split(sender, "@"), -1)).otherwise("unknown")
    return F.least(F.lit(0.3), hits * 0.1) + F.when(has_any(domain, PROFILE_TLDS), 0.2).otherwise(0.0)


def sender_profiles(df: DataFrame, first_only: bool = False) -> DataFrame:
    """Count, first and last time and a decayed score (.8 old + .2 new) per sender.

    The fold is linear, so a message's share depends only on how many newer
    messages its sender has: .2 x .8^newer, and .8^newer for the first one.
    Ranks come from day slices, so no sender is ever gathered in one task.
    """
    s = profile_score(F.col("sender"), F.col("subject"), F.col("body"))
    rows = df.select("sender", "id", "ts", s.alias("_s"))
    if first_only:
        rows = rows.groupBy("sender").agg(F.min_by(F.struct("id", "ts", "_s"), F.struct("ts", "id")).alias("r")).select("sender", "r.*")
    ranked = newest_rank(rows, ["sender"], "ts", "id")
    first = F.col("_newer") == F.col("_total") - 1
    weight = F.pow(F.lit(0.8), F.col("_newer")) * F.when(first, 1.0).otherwise(0.2)
    agg = ranked.groupBy(F.col("sender").alias("email")).agg(
        F.count("*").alias("email_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.sum(weight * F.col("_s")).alias("threat_score"))
    return agg.withColumn("domain", F.when(F.col("email").contains("@"), F.element_at(F.split("email", "@"), -1)).otherwise("unknown"))


def profile_report(profiles: DataFrame) -> DataFrame:
    s = F.col("threat_score")
    threat = F.count_if(s > 0.5)
    return profiles.agg(F.count("*").alias("total_profiles"), threat.alias("threat_profiles"), F.count_if(s > 0.7).alias("high_risk"),
                        F.count_if((s > 0.3) & (s <= 0.7)).alias("medium_risk"), (F.count("*") - threat).alias("low_risk"))


# --- run statistics ----------------------------------------------------------
def ingest_stats(df: DataFrame, seconds: float, errors: DataFrame | None = None) -> DataFrame:
    n = F.count("*")
    out = df.agg(n.alias("total_emails"), F.count_if(F.col("is_threat") == 1).alias("threats_detected"),
                 F.count_distinct("provider").alias("providers_processed"), F.lit(float(seconds)).alias("processing_time"))
    out = out.withColumns({"emails_per_second": F.col("total_emails") / F.col("processing_time"),
                           "threat_detection_rate": F.col("threats_detected") / F.greatest("total_emails", F.lit(1))})
    if errors is None:
        return out.withColumn("errors", F.lit(0).cast("bigint"))
    # Two single-row frames meet on a constant key.
    bad = errors.agg(F.count("*").alias("errors"), F.lit(1).alias("_k"))
    return out.withColumn("_k", F.lit(1)).join(F.broadcast(bad), "_k").drop("_k")


def latency_summary(df: DataFrame, channel: str = "channel", value: str = "ms") -> DataFrame:
    """Average, median, 95th and maximum by channel; index rule, no interpolation."""
    n = F.col("n")
    p95 = F.floor(n * 0.95) - 1
    at = values_at(df, [channel], value, {"p50": F.floor(n / 2), "p95": F.when(p95 < 0, n - 1).otherwise(p95)})
    basic = df.groupBy(channel).agg(F.avg(value).alias("avg"), F.max(value).alias("max"))
    return at.join(basic, channel)


def dataset_fingerprint(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """16 hex digits that change when any labelled text changes.

    The row hashes are added up in eight parts, so the result does not depend
    on row order and needs one partial sum per task instead of the whole set
    in one place.
    """
    h = F.sha2(F.concat(F.col(label).cast("string"), F.col(text)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_p{i}") for i in range(8)]
    agg = df.filter(F.col(label).isNotNull()).select(label, text).agg(F.count("*").alias("n"), *parts)
    joined = F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(F.col(f"_p{i}").cast("string"), F.lit("0")) for i in range(8)])
    return agg.select("n", F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and balanced weight n / (classes x rows) per class; ``both`` is false if a class is missing."""
    per = df.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("rows"))
    whole = per.agg(F.sum("rows").alias("n"), F.count("*").alias("classes"), F.lit(1).alias("_k"))
    out = per.withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k")
    return out.select(label, "rows", (F.col("n") / (F.lit(2) * F.col("rows"))).alias("weight"), (F.col("classes") == 2).alias("both"))


def queue_drain_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("status").isin("ok", "failed")).alias("processed"), F.count_if(F.col("status") == "ok").alias("ok"),
                  F.count_if(F.col("status") == "failed").alias("failed"))


def dlq_depth(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count("*").alias("pending"))


def trial_abuse_score(signups: DataFrame, history: DataFrame) -> DataFrame:
    """Points for trial abuse, capped at 100; below 70 is allowed."""
    fp = F.trim(text_or_empty(F.col("fingerprint")))
    j = signups.withColumn("_fp", fp).join(history.select(F.col("fingerprint").alias("_h"), "attempts"), F.col("_fp") == F.col("_h"), "left")
    ua = F.lower(text_or_empty(F.col("user_agent")))
    odd = (ua == "") | (~ua.contains("mozilla") & ~ua.contains("applewebkit"))
    raw = (F.when(F.length("_fp") < 8, 35).otherwise(0) + F.when(odd, 15).otherwise(0)
           + F.when(text_or_empty(F.col("ip")).isin("", "127.0.0.1", "::1", "unknown"), 10).otherwise(0)
           + F.when(F.col("attempts") >= 2, 40).when(F.col("attempts").isNotNull(), 15).otherwise(0))
    wanted = F.coalesce(F.col("want_trial"), F.lit(False))
    return j.select("signup_id", F.when(wanted, F.least(raw, F.lit(100))).otherwise(0).alias("score"), (~wanted | (raw < 70)).alias("allow"))


def metrics_text_totals(lines: DataFrame) -> DataFrame:
    """Total requests and in-flight gauge from exposition text; the last gauge line wins.

    ``lines`` has (pos, value).
    """
    ok = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    name, num = F.regexp_extract("value", r"^(.*) (\S+)$", 1), F.regexp_extract("value", r"^(.*) (\S+)$", 2).try_cast("double")
    p = ok.select("pos", name.alias("name"), num.alias("v")).filter(F.col("v").isNotNull() & (F.col("name") != ""))
    gauge = F.max_by(F.when(F.col("name").startswith("http_requests_in_flight"), F.col("v")),
                     F.when(F.col("name").startswith("http_requests_in_flight"), F.col("pos")))
    return p.agg(F.coalesce(F.sum(F.when(F.col("name").startswith("http_requests_total"), F.col("v"))), F.lit(0.0)).cast("bigint").alias("total_requests"),
                 F.coalesce(gauge, F.lit(0.0)).cast("bigint").alias("in_flight"))


def stream_stats(verdicts: DataFrame, dead: DataFrame, submitted: int | None = None) -> DataFrame:
    """Stream totals from the verdict and dead-letter tables."""
    d = dead.agg(F.count("*").alias("dead_lettered"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retried"), F.lit(1).alias("_k"))
    v = verdicts.agg(F.count("*").alias("processed"), F.count_if("is_threat").alias("threats"), F.avg("latency_ms").alias("avg_latency_ms"),
                     F.lit(1).alias("_k"))
    out = v.join(F.broadcast(d), "_k").drop("_k")
    total = F.lit(submitted) if submitted is not None else F.col("processed") + F.col("dead_lettered")
    return out.withColumns({"submitted": total, "dropped": total - F.col("processed") - F.col("dead_lettered"), "errors": F.col("dead_lettered")})


def tenantless_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~valid_tenant(F.col("account_sub"))).alias("tenantless"))
