"""Batch ingest: screen, links, geography, profiles, dedup, score, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgsieve.functions.features import header_ips, screen_injection
from msgsieve.functions.policy import policy_signals, policy_verdict
from msgsieve.models.text_model import TextModel
from msgsieve.operators import lookups as lk
from msgsieve.operators.dedup import new_messages
from msgsieve.streaming.flow import classified


def batch_ingest(batch: DataFrame, stored: DataFrame, fleet: DataFrame, ranges: DataFrame, safe_rules: DataFrame, screen: bool = False,
                 model: TextModel | None = None, channel: str = "smishing") -> DataFrame:
    """New rows of a batch with verdict and origin, ready to append.

    Order: optional injection screen, dedup against the store, link verdicts,
    allow-list, shared list, policy, classifier, origin.  Dedup comes before
    the costly columns so that re-delivered mail is not scored again.  The
    allow-list outranks the policy, the policy the classifier.
    """
    if screen:
        batch = screen_injection(batch).filter(~F.col("quarantined")).select(*batch.columns)
    fresh = new_messages(batch, stored)
    links = lk.with_high_risk_links(fresh)
    verdict = policy_verdict(policy_signals(lk.match_fleet_keys(links, fleet)))
    if model is not None:
        verdict = classified(verdict, model, channel)
    learned = [F.col(c) if c in verdict.columns else F.lit(None) for c in ("model_pred", "model_conf")]
    safe = lk.match_safe_senders(fresh, safe_rules).select("id", "tier")
    out = verdict.join(safe, "id", "left").withColumn("origin_ip", F.get(header_ips(F.col("received")), 0))
    geo = lk.ip_geo(out.select(F.col("origin_ip").alias("ip")), ranges).select(F.col("ip").alias("origin_ip"), "country_code", "risk_level")
    out = out.join(geo, "origin_ip", "left")
    risky = F.col("high_risk_links") > 0
    conf = F.when(F.col("tier").isNotNull(), 0.02).otherwise(F.coalesce("policy_confidence", learned[1], F.lit(0.5)))
    return out.withColumns({
        "confidence": F.when(risky, F.greatest(conf, F.lit(0.85))).otherwise(conf),
        "is_threat": F.when(risky, 1).when(F.col("tier").isNotNull(), 0).otherwise(F.coalesce("policy_pred", learned[0], F.lit(0)))})
