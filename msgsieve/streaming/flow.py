"""Stream sources, scoring, windows and duplicate removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.functions import policy as po
from msgsieve.functions.features import flatten_text, normalise_records
from msgsieve.functions.verdict import risk_verdict
from msgsieve.models.text_model import TextModel, load_model, score_messages
from msgsieve.operators.lookups import match_fleet_keys


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64, glob: str | None = None) -> DataFrame:
    """Bounded intake: at most so many new files per trigger; offsets replace polling, so no late row is lost."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> None:
    """Process everything that is there, batch by batch, and stop; other triggers run on."""
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def append_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there into parquet files, exactly once."""
    query = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def policy_records(records: DataFrame, channel: str, fleet: DataFrame | None = None) -> DataFrame:
    """Channel fields, policy signals and the policy's verdict; columns and one look-up join, so it is the same for batch and stream."""
    r = normalise_records(records, channel).withColumn("sender", F.col("from"))
    r = r.withColumns({c: F.lit(None).cast("string") for c in ("auth_results", "received_spf", "dkim_signature", "return_path", "list_unsubscribe") if c not in records.columns})
    r = match_fleet_keys(r, fleet) if fleet is not None else r.withColumns({"fleet_hit": F.lit(False), "fleet_confidence": F.lit(None).cast("double")})
    return po.policy_verdict(po.policy_signals(r))


def verdict_rows(r: DataFrame, channel: str) -> DataFrame:
    """The policy's verdict where it has one, else the classifier's (``model_pred``, ``model_conf``), else pass; then the decision matrix."""
    model = [F.col(c) if c in r.columns else F.lit(None) for c in ("model_pred", "model_conf")]
    r = r.withColumns({"pred": F.coalesce("policy_pred", model[0], F.lit(0)), "conf": F.coalesce("policy_confidence", model[1], F.lit(0.5)),
                       "anomaly_level": F.lit("NORMAL"), "novelty": F.lit(0.0), "sender_risk": F.lit(0.0), "link_risk": F.lit(0.0)})
    return risk_verdict(r).withColumn("channel", F.lit(channel))


def stream_score(records: DataFrame, channel: str, fleet: DataFrame | None = None) -> DataFrame:
    """Record to verdict by policy alone; with a classifier use ``score_available``."""
    return verdict_rows(policy_records(records, channel, fleet), channel)


def classified(df: DataFrame, model: TextModel, channel: str) -> DataFrame:
    """Add ``model_pred``, ``model_conf`` and ``model_version`` by a join of the records' terms with the model's term table."""
    text = flatten_text(channel, F.col("subject"), F.col("body"), F.col("sender"))
    scored = score_messages(model, df.select("id", text.alias("text"))).select("id", F.col("pred").alias("model_pred"), F.col("conf").alias("model_conf"))
    return df.join(scored, "id", "left").withColumn("model_version", F.lit(model.version))


def score_available(records: DataFrame, channel: str, models: str, path: str, checkpoint: str, fleet: DataFrame | None = None, keep: list[str] | None = None) -> None:
    """Score everything that is there and stop.

    Each micro-batch takes the newest complete version of the model table
    under ``models``, so a version published during the run is used from the
    next batch on.  A batch that is done again replaces its own folder.
    """
    def score(batch: DataFrame, number: int) -> None:
        model = load_model(batch.sparkSession, models)
        rows = policy_records(batch, channel, fleet)
        rows = classified(rows, model, channel) if model else rows.withColumn("model_version", F.lit(0))
        out = verdict_rows(rows, channel)
        out.select(*(keep or out.columns)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(records, score, checkpoint)


def stream_dedup(df: DataFrame, keys: list[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """First row per key within the delay; state is dropped when the watermark passes."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_kpis(df: DataFrame, ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Hourly threat counts by channel on event time."""
    return (df.withWatermark(ts, delay).filter(F.col("is_threat") == 1)
            .groupBy(F.window(ts, "1 hour").alias("w"), F.col("message_type").alias("channel"))
            .agg(F.count("*").alias("threats")).select(F.col("w.start").alias("hour"), "channel", "threats"))


def fleet_reports(df: DataFrame, delay: str) -> DataFrame:
    """Unexpected reports with a sender key and a reporter, and the 30-day windows moved daily that hold them."""
    return (df.filter((F.col("expected") == F.lit(False)) & F.col("sender_key").isNotNull() & F.col("account_sub").isNotNull())
            .withWatermark("created_at", delay).select(F.window("created_at", "30 days", "1 day").alias("w"), "sender_key", "account_sub"))


def stream_fleet_counts(df: DataFrame, delay: str = "1 day") -> DataFrame:
    """Exact distinct reporters per sender key over 30 days, moved daily; each window is emitted once, when it is closed.

    Two stateful operators in a row: the first lets each reporter of a key and
    window through once and forgets it with the window, the second counts.  The
    state of the first is spread by reporter, so a key that everybody reports
    is no hot group; the second keeps one number a key and window.
    """
    once = fleet_reports(df, delay).dropDuplicates(["w", "sender_key", "account_sub"])
    return (once.groupBy("w", "sender_key").agg(F.count("*").alias("reporters"))
            .select(F.col("w.end").alias("window_end"), "sender_key", "reporters"))


def stream_fleet_sketch(df: DataFrame, delay: str = "1 day", rsd: float = 0.05) -> DataFrame:
    """The same counts from a sketch of fixed size a key and window, with relative standard deviation ``rsd``."""
    return (fleet_reports(df, delay).groupBy("w", "sender_key").agg(F.approx_count_distinct("account_sub", rsd).alias("reporters"))
            .select(F.col("w.end").alias("window_end"), "sender_key", "reporters"))
