"""Exact duplicates: group by 128-bit content hash, compare bytes inside groups.

The texts are compared as grouping keys: ``(hash, text)`` is aggregated with a
map-side combine, so a group of any size reaches the shuffle as at most one
row per task.  Only digests travel back to the rows.  A hash that stands for
more than one text (a collision) is resolved on the text itself.

Defined cases: a null text counts as empty.  Rows without an id never win over
rows with one.  Rows repeated with the same id share one decision.  Other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, ascii_lower, cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = ascii_lower,
                     hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names which id of equal texts stays: "smallest" or "largest".
    """
    winner = {"smallest": F.min, "largest": F.max}[keep]
    rows = as_columns(docs, doc_id="long", text="string").select("doc_id", normalise(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", hash_of(F.col("text")).alias("hash"))
    groups = rows.groupBy("hash", "text").agg(winner("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut_lineage(groups.select("hash", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    by_hash = groups.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                                         F.max("group_size").alias("group_size"), F.max("text_sha256").alias("text_sha256"))
    plain = rows.select("doc_id", "hash").join(by_hash.where("texts = 1"), "hash")
    found = plain.select("doc_id", "keep_id", "group_size", "text_sha256")
    collided = by_hash.where("texts > 1").select("hash")
    if not collided.isEmpty():
        several = rows.join(collided, "hash", "left_semi")
        texts = several.groupBy("hash", "text").agg(winner("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = several.join(texts, ["hash", "text"]).select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
        found = found.unionByName(again)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
