"""Duplicate handling on ingest and in the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.functions.text import text_or_empty
from msgsieve.operators.filters import tenant_scope


def latest_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate instead of a window: partial maxima are taken before the
    shuffle, so a key holding a third of all rows costs one row per task.
    """
    picked = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return picked.select("_row.*")


def thread_key(df: DataFrame) -> Column:
    """Message-ID when present, else the subject."""
    return F.coalesce(F.nullif(F.col("rfc_message_id"), F.lit("")), F.col("subject"))


def keep_first_id(df: DataFrame, key: str) -> DataFrame:
    """(key, keep_id, n) for keys that occur more than once."""
    return (df.filter(text_or_empty(F.col(key)) != "").groupBy(key)
            .agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter(F.col("n") > 1))


def _collapsed(df: DataFrame, dupes: DataFrame, key: str, stamp: str) -> DataFrame:
    joined = df.join(dupes.select(key, "keep_id"), key, "left")
    hit = F.col("keep_id").isNotNull() & (F.col("id") != F.col("keep_id")) & F.col("label").isNull()
    return joined.withColumn("_hit", hit).withColumns({
        "label": F.when(F.col("_hit"), 0).otherwise(F.col("label")),
        "is_threat": F.when(F.col("_hit"), 0).otherwise(F.col("is_threat")),
        "confidence": F.when(F.col("_hit"), F.least("confidence", F.lit(0.05))).otherwise(F.col("confidence")),
        "stamp": F.when(F.col("_hit"), F.lit(stamp))}).drop("_hit", "keep_id")


def collapse_duplicates(df: DataFrame) -> DataFrame:
    """Clear ungraded copies of a Message-ID, keeping the first id."""
    return _collapsed(df, keep_first_id(df, "rfc_message_id"), "rfc_message_id", "collapsed_rfc_message_id")


def collapse_sender_flood(df: DataFrame, patterns: list[str], above: int = 2) -> DataFrame:
    """Clear ungraded excess rows of the named senders, keeping the first id."""
    from msgsieve.operators.filters import ilike_any
    flood = (df.filter(F.col("label").isNull() & ilike_any(text_or_empty(F.col("sender")), patterns)).groupBy("sender")
             .agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter(F.col("n") > above))
    return _collapsed(df, flood, "sender", "collapsed_sender_flood")


def sender_siblings(df: DataFrame, account_sub: str, message_id: int, limit: int = 80) -> DataFrame:
    """Ungraded messages of the same sender as one message, one per thread."""
    scoped = tenant_scope(df, account_sub)
    one = scoped.filter(F.col("id") == int(message_id)).select("sender").limit(1)
    same = scoped.filter(F.col("label").isNull() & (F.col("id") != int(message_id))).join(F.broadcast(one), "sender")
    same = same.withColumn("thread", thread_key(same))
    newest = latest_per_key(same.select("thread", "id", F.substring("subject", 1, 120).alias("subject"), "confidence"), F.col("thread"), F.col("id"))
    return newest.orderBy("thread").limit(limit)


# --- ingest ------------------------------------------------------------------
def identity_keys(df: DataFrame) -> DataFrame:
    """Tagged identity keys of each row, strongest first: provider uid, Message-ID, fingerprint."""
    def part(c: str) -> Column:
        return text_or_empty(F.col(c))
    uid = F.when((part("provider") != "") & (part("provider_uid") != ""), F.concat_ws(
        "|", F.lit("1"), F.lower(F.trim("provider")), F.col("provider_uid"), part("uidvalidity"), part("folder")))
    mid = F.when(part("rfc_message_id") != "", F.concat(F.lit("2|"), F.col("rfc_message_id")))
    fp = F.when(part("ingest_fp") != "", F.concat(F.lit("3|"), F.col("ingest_fp")))
    return df.select("id", "account_sub", "mailbox_id", F.explode(F.array_compact(F.array(uid, mid, fp))).alias("key"))


def existing_matches(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, existing_id): the stored row each batch row duplicates, within tenant and mailbox.

    All three identity tests share one pass over the stored table.  Stored keys
    are reduced to their first id before the join, so a key that occurs in any
    number of stored rows meets each batch row once.
    """
    b = identity_keys(batch.withColumn("folder", F.when(text_or_empty(F.col("folder")) == "", "INBOX").otherwise(F.col("folder"))))
    s = identity_keys(stored).groupBy("account_sub", "mailbox_id", "key").agg(F.min("id").alias("existing_id"))
    return (b.join(s, ["account_sub", "mailbox_id", "key"])
            .groupBy("id").agg(F.min(F.struct(F.substring("key", 1, 1).alias("tier"), "existing_id")).alias("m"))
            .select("id", "m.existing_id", F.col("m.tier").cast("int").alias("tier")))


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows not stored yet (EXCEPT by identity); running it again adds nothing."""
    return batch.join(existing_matches(batch, stored), "id", "left_anti")
