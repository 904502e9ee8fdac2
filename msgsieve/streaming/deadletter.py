"""Retries, durable writes, dead letters and their replay."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.operators.filters import valid_tenant
from msgsieve.sources.sinks import dead_letter_rows

RETRIES, BACKOFF_S = 2, 0.2


def with_retry(action: Callable[[], None], retries: int = RETRIES, backoff: float = BACKOFF_S) -> bool:
    """True when the action worked within the allowed tries."""
    for attempt in range(retries + 1):
        try:
            action()
            return True
        except Exception:  # the dead-letter store takes over
            if attempt < retries:
                time.sleep(backoff * (attempt + 1))
    return False


def letters(df: DataFrame, kind: str, error: Column, retries: int = RETRIES) -> DataFrame:
    """Rows in dead-letter form; the payload is the whole row as JSON."""
    return df.select(F.lit(kind).alias("kind"), "id", "account_sub", F.to_json(F.struct(*df.columns)).alias("payload"), error.alias("error"),
                     F.lit(retries).alias("retries"), F.current_timestamp().alias("failed_at"))


def split_bad_rows(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    flag = F.coalesce(bad, F.lit(True))
    return df.filter(~flag), df.filter(flag)


def durable_sink(path: str, dead_path: str, bad: Column, kind: str = "threat") -> Callable[[DataFrame, int], None]:
    """Batch writer for ``foreachBatch``.

    Good rows go to a folder named by the batch id, so a repeated batch
    replaces itself.  Bad rows, and whole batches whose write keeps failing,
    become dead letters the same way; the stream goes on.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        good, broken = split_bad_rows(batch, bad)
        written = with_retry(lambda: good.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
        dead = letters(broken, kind, F.lit("bad_row"), 0)
        if not written:
            dead = dead.unionByName(letters(good, kind, F.lit("write_failed")))
        dead_letter_rows(dead).write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}")

    return sink


def replay_dead_letters(stored: DataFrame, works: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    """(replayed, kept): oldest first, stop at the first failure, keep the rest.

    ``works`` says whether the sink takes a row.  Rows without a tenant are
    never replayed.
    """
    mine = stored.filter(F.col("kind") == kind)
    head = mine.filter(valid_tenant(F.col("account_sub")))
    stop = head.filter(~F.coalesce(works, F.lit(False))).agg(F.min(F.struct("failed_at", "id")).alias("stop"), F.lit(1).alias("_k"))
    marked = head.withColumn("_k", F.lit(1)).join(F.broadcast(stop), "_k", "left")
    replayed = marked.filter(F.col("stop").isNull() | (F.struct("failed_at", "id") < F.col("stop"))).drop("_k", "stop")
    kept = stored.join(replayed.select("kind", "id"), ["kind", "id"], "left_anti")
    return replayed, kept
