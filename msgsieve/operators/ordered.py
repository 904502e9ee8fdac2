"""Ordered jobs: latest per key, top-k per key, trailing windows, folds, queues, chains."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.operators.lives import opens, with_record


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key as ``rank`` 1..k.

    Spark keeps only ``k`` rows per key on the map side before the shuffle
    (window group limit), so a hot key never reaches one task whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


DAY_US = 86_400_000_000


CELLS = 4096  # cells of a page of time; a page has at most so many counts


def _slice_of(ts: str, width_us: int = DAY_US) -> Column:
    return F.floor(F.unix_micros(ts) / width_us)


def _cell_of(page: str, width_us: int) -> Column:
    """Cell of ``_t`` in its page: instants a page apart have the same cell."""
    return F.floor((F.col("_t") - F.col(page) * width_us) * CELLS / width_us)


def newest_rank(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Add ``_newer`` (newer rows of the key) and ``_total``.

    Rows are ranked inside cells of about 21 seconds; offsets come from the
    counts of a day's cells and of the days, so a hot key is spread over its
    days and a busy hour over its cells.  Rows without a time come last.
    """
    rows = df.withColumns({"_k": F.struct(*keys), "_t": F.unix_micros(ts), "_day": F.coalesce(_slice_of(ts), F.lit(-(1 << 40)))})
    rows = rows.withColumn("_cell", F.coalesce(_cell_of("_day", DAY_US), F.lit(0)))
    inside = Window.partitionBy("_k", "_day", "_cell").orderBy(F.desc_nulls_last(ts), F.desc(tie))
    cells = rows.groupBy("_k", "_day", "_cell").agg(F.count("*").alias("_n"))
    days = cells.groupBy("_k", "_day").agg(F.sum("_n").alias("_n"))
    cells = cells.withColumn("_in_day", F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_day").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = Window.partitionBy("_k").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"_before": F.coalesce(F.sum("_n").over(later), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy("_k"))})
    offsets = cells.drop("_n").join(days.drop("_n"), ["_k", "_day"])
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(offsets, ["_k", "_day", "_cell"])
    return ranked.withColumn("_newer", F.col("_before") + F.col("_in_day") + F.col("_r") - 1).drop("_r", "_before", "_in_day", "_cell", "_day", "_t", "_k")


def trailing_count(df: DataFrame, keys: list[str], ts: str, tie: str, window_us: int) -> DataFrame:
    """Add ``n``: events of the key in the open trailing window, in arrival order (ts, tie).

    Time is cut into pages one window long, pages into cells.  A window is the
    events of its page up to this one and those of the page before that are
    later than its begin, so two ranks inside cells and the counts of a page's
    cells give ``n``: a busy window of one key is spread over its cells.
    Events without a time are left out.
    """
    rows = df.withColumns({"_k": F.struct(*keys), "_t": F.unix_micros(ts)}).where("_t is not null").withColumn("_page", F.floor(F.col("_t") / window_us))
    rows = rows.withColumn("_cell", _cell_of("_page", window_us))
    place = ["_k", "_page", "_cell"]
    counts = rows.groupBy(*place).agg(F.count("*").alias("_n"))
    # The cells where windows begin are asked for too, also those without events.
    asked = counts.select("_k", (F.col("_page") - 1).alias("_page"), "_cell", F.lit(0).cast("long").alias("_n"))
    page = Window.partitionBy("_k", "_page")
    offsets = (counts.unionByName(asked).groupBy(*place).agg(F.sum("_n").alias("_n"))
               .withColumns({"_upto": F.coalesce(F.sum("_n").over(page.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(page)}).drop("_n"))
    ranked = (rows.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("_t", tie))).join(offsets.drop("_all"), place)
              .withColumn("_here", F.col("_r") + F.col("_upto")).drop("_r", "_upto"))
    begins = ranked.withColumns({"_page": F.col("_page") - 1, "_t": F.col("_t") - window_us, "_ask": F.lit(1)})
    own = rows.select(*place, "_t", F.lit(0).alias("_ask"))
    # Events at the very begin of a window are out of it: they are counted before it is asked.
    upto = Window.partitionBy(*place).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = begins.unionByName(own, allowMissingColumns=True).withColumn("_gone", F.sum(1 - F.col("_ask")).over(upto)).where("_ask = 1")
    return (both.join(offsets, place).withColumn("n", F.col("_here") + F.col("_all") - F.col("_upto") - F.col("_gone"))
            .drop("_k", "_t", "_page", "_cell", "_here", "_ask", "_gone", "_upto", "_all"))


def grade_velocity(grades: DataFrame, threshold: int = 8, window_us: int = 3_600_000_000) -> DataFrame:
    """Block and safe grades per channel and campaign in the trailing hour; fires only at exactly the threshold."""
    used = grades.filter(F.col("verdict").isin("block", "safe"))
    out = trailing_count(used, ["channel", "campaign_id"], "ts", "id", window_us)
    return out.withColumn("fired", F.col("n") == threshold)


def checkout_velocity(events: DataFrame, limit: int = 8, window_us: int = 600_000_000) -> DataFrame:
    """Trailing ten-minute count per key; allowed up to the limit."""
    return trailing_count(events, ["key"], "ts", "id", window_us).withColumn("allow", F.col("n") <= limit)


# --- ordered folds -----------------------------------------------------------
def ordered_fold(df: DataFrame, keys: list[str], ts: str, tie: str, step: Callable, schema: str, idle_us: int | None) -> DataFrame:
    """Run ``step(state, row) -> (state, outputs)`` over each key's rows in order.

    ``idle_us`` is a pause after which the state is as if new: a key's history
    is cut there, and the pieces run as separate groups.  Rows stream through
    the task batch by batch with only the current state in memory, so a group
    may be larger than memory.  Null ``idle_us`` means the order is inherent.
    """
    rows = df.withColumn("_t", F.unix_micros(ts))
    if idle_us is None:
        rows = rows.withColumn("_piece", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("_b", F.floor(F.col("_t") / idle_us))
        # An empty bucket between two busy ones proves a pause of at least ``idle_us``.
        busy = rows.select(*keys, "_b").distinct()
        w = Window.partitionBy(*keys).orderBy("_b")
        gap = F.coalesce((F.col("_b") - F.lag("_b").over(w) > 1).cast("long"), F.lit(0))
        pieces = busy.withColumn("_gap", gap).withColumn("_piece", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
        rows = rows.join(pieces, [*keys, "_b"]).drop("_b")
    placed = rows.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "_t", tie)
    group = [*keys, "_piece"]

    def run(batches):
        current, state = None, None
        for pdf in batches:
            outs = []
            records = pdf.to_dict("records")
            for row in records:
                ident = tuple(row[g] for g in group)
                if ident != current:
                    current, state = ident, None
                state, out = step(state, row)
                outs.append(out)
            yield pd.DataFrame(outs) if outs else pd.DataFrame(columns=[f.split()[0] for f in schema.split(",")])

    return placed.mapInPandas(run, schema)


def request_rate(events: DataFrame, limit: int = 30, window_us: int = 60_000_000) -> DataFrame:
    """Allowed or not, at most ``limit`` allowed requests in the trailing minute; refused ones do not count.

    With one request a window the allowed ones are found by doubled pointers;
    more need the order of the key.
    """
    rows = events.select("id", "key", "ts")
    if limit == 1:
        left = (window_us - (F.col("_t") - F.col("record.born"))) / 1e6
        return (with_record(rows, ["key"], "ts", "id", window_us, []).withColumn("allowed", opens("id"))
                .select("id", "key", "allowed", F.when(F.col("allowed"), 0.0).otherwise(left).alias("retry_after")))

    def step(state, row):
        recent = [t for t in (state or []) if row["_t"] - t < window_us]
        ok = len(recent) < limit
        if ok:
            recent.append(row["_t"])
        return recent, {"id": row["id"], "key": row["key"], "allowed": ok, "retry_after": 0.0 if ok else (window_us - (row["_t"] - recent[0])) / 1e6}

    return ordered_fold(rows, ["key"], "ts", "id", step,
                        f"id long, key {events.schema['key'].dataType.simpleString()}, allowed boolean, retry_after double", window_us)


def bucket_step(state: tuple[float, int] | None, t_us: int, capacity: float, rate: float) -> tuple[tuple[float, int], bool, float]:
    """One token-bucket decision: new state, allowed, seconds to wait."""
    level, last = state if state is not None else (capacity, t_us)
    level = min(capacity, level + (t_us - last) / 1e6 * rate)
    if level >= 1.0:
        return (level - 1.0, t_us), True, 0.0
    return (level, t_us), False, (1.0 - level) / rate


def token_bucket_flags(log: DataFrame, capacity: float = 120.0, rate: float = 20.0) -> DataFrame:
    """Over-limit flag and wait per request; a bucket is full again after capacity / rate seconds."""
    def step(state, row):
        state, ok, wait = bucket_step(state, row["_t"], capacity, rate)
        return state, {"id": row["id"], "key": row["key"], "allowed": ok, "tokens": state[0], "retry_after": wait}

    return ordered_fold(log.select("id", "key", "ts"), ["key"], "ts", "id", step,
                        f"id long, key {log.schema['key'].dataType.simpleString()}, allowed boolean, tokens double, retry_after double",
                        int(capacity / rate * 1e6) + 1)


def duplicate_requests(log: DataFrame, ttl_us: int = DAY_US) -> DataFrame:
    """Verdict per request of a key: new, in_flight, replay or conflict.

    A key's record lives for the TTL from its first request; ``done_us`` is the
    time that request takes.
    """
    rows = with_record(log.select("id", "key", "ts", "request_hash", "done_us"), ["key"], "ts", "id", ttl_us + 1, ["request_hash", "done_us"])
    verdict = (F.when(opens("id"), "new").when(~F.col("record.request_hash").eqNullSafe(F.col("request_hash")), "conflict")
               .when(F.col("_t") >= F.col("record.born") + F.col("record.done_us"), "replay").otherwise("in_flight"))
    return rows.select("id", "key", verdict.alias("verdict"))


# --- action queue ------------------------------------------------------------
def lease_queue(queue: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """Oldest due actions, leased for five minutes."""
    c = F.col
    due = ((F.trim(F.coalesce("account_sub", F.lit(""))) != "") & c("mailbox_id").isNotNull() & (c("attempts") < 5) & (c("next_attempt_at") <= as_of)
           & ((c("status") == "pending") | ((c("status") == "processing") & (c("lease_until") < as_of))))
    picked = queue.filter(due).orderBy("created_at", "id").limit(n)
    return picked.withColumns({"status": F.lit("processing"), "attempts": c("attempts") + 1, "lease_until": as_of + F.make_dt_interval(mins=F.lit(5))})


def retry_schedule(queue: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Queue after a run: done, to be retried after 2^attempts seconds (at most 300), or failed."""
    r = results.select("id", F.col("ok").alias("_ok"))
    j = queue.join(r, "id", "left")
    status = (F.when(F.col("_ok").isNull(), F.col("status")).when(F.col("_ok"), "ok").when(F.col("attempts") < 5, "pending").otherwise("failed"))
    wait = F.least(F.lit(300.0), F.pow(F.lit(2.0), F.greatest(F.lit(1), "attempts")))
    retry = F.col("_ok").isNotNull() & ~F.col("_ok") & (F.col("attempts") < 5)
    return j.withColumns({"status": status, "next_attempt_at": F.when(retry, as_of + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).otherwise(F.col("next_attempt_at"))}).drop("_ok")


# --- audit chain -------------------------------------------------------------
def chain_hash(previous: Column) -> Column:
    """Hash of one audit event; ``payload`` is its canonical sorted-key JSON text."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), "event_type", "stream_id", "payload", "hashed_at"), 256)


def verify_audit_chain(events: DataFrame) -> DataFrame:
    """Add ``link_ok`` (previous hash is the event before) and ``hash_ok``.

    The event before is looked up inside day slices; the first event of a day
    takes the last hash of the stream's previous busy day.
    """
    rows = events.withColumn("_slice", _slice_of("ts"))
    inside = Window.partitionBy("stream_id", "_slice").orderBy("id")
    days = rows.groupBy("stream_id", "_slice").agg(F.max_by("event_hash", "id").alias("_last"))
    before = days.withColumn("_before", F.lag("_last").over(Window.partitionBy("stream_id").orderBy("_slice"))).drop("_last")
    j = rows.withColumn("_lag", F.lag("event_hash").over(inside)).join(before, ["stream_id", "_slice"])
    prior = F.coalesce("_lag", "_before", F.lit(""))
    return (j.withColumns({"link_ok": F.coalesce("previous_hash", F.lit("")) == prior, "hash_ok": chain_hash(F.col("previous_hash")) == F.col("event_hash")})
            .drop("_lag", "_before", "_slice"))


def append_audit_chain(new: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Extend each stream's chain; ``last`` has (stream_id, event_hash) of the stored ends.

    Each hash needs the one before, so a stream is a sequence by nature; it is
    streamed through one task with one hash in memory.
    """
    rows = new if last is None else new.join(last.select("stream_id", F.col("event_hash").alias("_end")), "stream_id", "left")
    if last is None:
        rows = rows.withColumn("_end", F.lit(None).cast("string"))

    def step(state, row):
        previous = state if state is not None else (row["_end"] or "")
        text = "|".join([previous, row["event_type"], row["stream_id"], row["payload"], row["hashed_at"]])
        digest = hashlib.sha256(text.encode()).hexdigest()
        return digest, {"id": row["id"], "stream_id": row["stream_id"], "event_type": row["event_type"], "payload": row["payload"],
                        "hashed_at": row["hashed_at"], "ts": row["ts"], "previous_hash": previous or None, "event_hash": digest}

    return ordered_fold(rows, ["stream_id"], "ts", "id", step,
                        "id long, stream_id string, event_type string, payload string, hashed_at string, ts timestamp, previous_hash string, event_hash string", None)


# --- registry ----------------------------------------------------------------
def latest_versions(registry: DataFrame) -> DataFrame:
    """Versions per channel, newest first by numeric suffix, with the one to roll back to.

    A registry holds tens of rows per channel.
    """
    num = F.coalesce(F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int"), F.lit(0))
    w = Window.partitionBy("channel").orderBy("_n")
    ranked = registry.withColumn("_n", num).withColumn("previous", F.lag("version").over(w))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("_n"))))
    return ranked.withColumn("is_latest", F.col("rank") == 1).drop("_n")


def reservoir(df: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """Uniform, repeatable sample of ``k`` rows: the smallest salted hashes."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h").limit(k).drop("_h")
