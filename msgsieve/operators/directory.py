"""Block and label directory of phone numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgsieve.functions.phones import e164
from msgsieve.functions.verdict import directory_action
from msgsieve.operators.filters import hot_numbers, tenant_scope


def directory(messages: DataFrame, numbers: DataFrame, seeds: DataFrame, packs: DataFrame, account_sub: str) -> DataFrame:
    """(number, action, label): a block beats any label, the first label in source order wins.

    ``numbers`` (e164, risk, verdict), ``seeds`` (number), ``packs`` (number,
    action, label, ord).  Each source is reduced to (rank, ord) rows and merged
    by one map-side combined aggregate.
    """
    calls = tenant_scope(messages, account_sub).filter(F.col("message_type").isin("vishing", "smishing") & (F.col("is_threat") == 1))
    seen = (calls.withColumn("_a", directory_action(F.col("metadata"), F.col("label")))
            .select(e164(F.col("sender")).alias("number"), "_a.action", "_a.label", F.lit(1).alias("src"),
                    F.struct((-F.unix_micros("ts")).alias("a"), (-F.col("id")).alias("b")).alias("ord"))
            .filter(F.col("number").startswith("+")))

    def order(a, b):
        return F.struct(F.lit(a).cast("bigint").alias("a") if isinstance(a, int) else a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    hot = hot_numbers(numbers)
    verdict = F.initcap(F.replace(F.coalesce(F.nullif(F.col("verdict"), F.lit("")), F.lit("Suspicious caller")), F.lit("_"), F.lit(" ")))
    vendor = hot.select(e164(F.col("e164")).alias("number"), F.when(F.col("risk") >= 0.85, "block").otherwise("label").alias("action"),
                        F.when(F.col("risk") >= 0.85, "").otherwise(verdict).alias("label"), F.lit(2).alias("src"),
                        order((-F.col("risk") * 1_000_000), F.lit(0)).alias("ord")).filter(F.col("number") != "")
    seed = seeds.select(e164(F.col("number")).alias("number"), F.lit("block").alias("action"), F.lit("").alias("label"), F.lit(3).alias("src"),
                        order(0, F.lit(0)).alias("ord")).filter(F.col("number").startswith("+"))
    pack = packs.select(e164(F.col("number")).alias("number"), "action", "label", F.lit(4).alias("src"),
                        order(0, F.col("ord")).alias("ord")).filter(F.col("number").startswith("+"))
    rows = seen.unionByName(vendor).unionByName(seed).unionByName(pack).filter(F.col("action") != "none")
    first = F.min(F.when(F.col("action") == "label", F.struct("src", "ord", "label")))
    agg = rows.groupBy("number").agg(F.bool_or(F.col("action") == "block").alias("_block"), first.alias("_first"))
    return agg.select("number", F.when(F.col("_block"), "block").otherwise("label").alias("action"),
                      F.when(F.col("_block"), "").otherwise(F.col("_first.label")).alias("label"))
