"""Writers: feedback, caches, snapshots, dead letters, alerts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.functions.features import header_ips
from msgsieve.operators.filters import valid_tenant

TENANT_BOUND_KINDS = ["threat", "processing"]


def append_feedback(df: DataFrame, path: str, source: str, as_of: Column, batch_id: str = "current") -> None:
    """Append labelled rows with time and source under the open batch."""
    (df.withColumns({"ts": F.unix_micros(as_of) / 1e6, "source": F.lit(source)})
     .select("ts", F.col("label").cast("string").alias("label"), "source", F.struct("subject", "body", F.col("sender").alias("from"), "sender").alias("email"))
     .write.mode("append").json(f"{path}/batch_id={batch_id}"))


def archive_feedback(df: DataFrame, path: str, stamp: str) -> None:
    """Write the used feedback as its own stamped batch; the open batch starts anew under another id."""
    df.write.mode("overwrite").json(f"{path}/batch_id={stamp}")


def write_url_cache(verdicts: DataFrame, path: str, as_of: Column) -> None:
    """Append new link verdicts; ``verdicts`` has url, risk_score, threat_level, flags."""
    from msgsieve.functions.urls import netloc
    (verdicts.select(F.md5("url").alias("url_key"), "url", netloc(F.col("url")).alias("domain"), "risk_score", "threat_level", "flags", as_of.alias("cached_at"))
     .write.mode("append").parquet(path))


def write_bench_snapshot(df: DataFrame, path: str, history_path: str | None = None) -> None:
    """Replace the snapshot; keep a history row when asked."""
    df.write.mode("overwrite").json(path)
    if history_path:
        df.write.mode("append").json(history_path)


def dead_letter_rows(df: DataFrame) -> DataFrame:
    """Rows fit to store: tenant-bound kinds need a tenant."""
    return df.filter(~F.col("kind").isin(TENANT_BOUND_KINDS) | valid_tenant(F.col("account_sub")))


def write_dead_letters(df: DataFrame, path: str) -> None:
    dead_letter_rows(df).write.mode("append").partitionBy("kind").parquet(path)


def alert_rows(df: DataFrame, as_of: Column) -> DataFrame:
    """One alert per detected threat."""
    return df.filter(F.col("is_threat") == 1).select(
        "id", F.col("message_type").alias("type"), as_of.alias("timestamp"), F.struct("sender", "subject").alias("data"), "confidence")


def write_alerts(df: DataFrame, path: str, as_of: Column) -> None:
    alert_rows(df, as_of).write.mode("append").json(path)


def threat_reports(df: DataFrame, recipient: str = "internal") -> DataFrame:
    """One report row per threat with the addresses it came through."""
    ips = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("received", F.lit("")), F.lit(r"\b((?:\d{1,3}\.){3}\d{1,3})\b"), F.lit(1))))
    return df.filter(F.col("is_threat") == 1).select(
        F.concat(F.lit("THR-"), F.col("id").cast("string")).alias("report_id"), "sender", "subject", F.col("confidence").alias("threat_score"),
        F.lit(recipient).alias("recipient"), F.array_join(ips, ",").alias("originating_ips"),
        F.array_join(header_ips(F.col("received")), ",").alias("public_ips"), "return_path",
        F.col("rfc_message_id").alias("message_id"), F.col("auth_results").alias("authentication"))


def write_threat_reports(df: DataFrame, path: str, recipient: str = "internal") -> None:
    threat_reports(df, recipient).write.mode("append").json(path)


def retrain_report(results: list[DataFrame]) -> DataFrame:
    """Per-channel run results as one table."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def write_retrain_report(results: list[DataFrame], path: str) -> None:
    retrain_report(results).write.mode("overwrite").json(path)
