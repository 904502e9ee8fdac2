"""Keyed state on streams: velocity, rate limits, duplicate requests, sender profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from msgsieve.operators.ordered import bucket_step
from msgsieve.operators.rollups import profile_score

HOUR_US = 3_600_000_000


def _state(handle: StatefulProcessorHandle, name: str, schema: str, ttl_ms: int | None):
    return handle.getValueState(name, schema) if ttl_ms is None else handle.getValueState(name, schema, ttl_ms)


def _in_order(rows: Iterator[pd.DataFrame]) -> list[dict]:
    """Rows of one key in one micro-batch; the intake bound limits their number."""
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(["t", "id"]).to_dict("records") if parts else []


class Velocity(StatefulProcessor):
    """Times of the trailing window per key; fires when the count equals the threshold."""

    def __init__(self, threshold: int, window_us: int, expire: bool):
        self.threshold, self.window_us, self.expire = threshold, window_us, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = _state(handle, "times", "value array<long>", 2 * self.window_us // 1000 if self.expire else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.times.get()[0]) if self.times.exists() else []
        out = []
        for r in _in_order(rows):
            recent = [t for t in recent if r["t"] - t < self.window_us] + [r["t"]]
            out.append({"id": r["id"], "key": key[0], "n": len(recent), "fired": len(recent) == self.threshold})
        self.times.update((recent,))
        yield pd.DataFrame(out, columns=["id", "key", "n", "fired"])

    def close(self) -> None:
        pass


class TokenBucket(StatefulProcessor):
    """Token level and last time per key."""

    def __init__(self, capacity: float, rate: float, expire: bool):
        self.capacity, self.rate, self.expire = capacity, rate, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A bucket left alone for capacity / rate seconds is full, that is, new.
        full_ms = int(self.capacity / self.rate * 1000) + 60_000
        self.bucket = _state(handle, "bucket", "level double, last long", full_ms if self.expire else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.bucket.get()) if self.bucket.exists() else None
        out = []
        for r in _in_order(rows):
            state, ok, wait = bucket_step(state, r["t"], self.capacity, self.rate)
            out.append({"id": r["id"], "key": key[0], "allowed": ok, "retry_after": wait})
        self.bucket.update(state)
        yield pd.DataFrame(out, columns=["id", "key", "allowed", "retry_after"])

    def close(self) -> None:
        pass


class Requests(StatefulProcessor):
    """First request of a key with its hash and finish time, kept for the TTL."""

    def __init__(self, ttl_us: int, expire: bool):
        self.ttl_us, self.expire = ttl_us, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = _state(handle, "record", "born long, hash string, done long", self.ttl_us // 1000 if self.expire else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.record.get()) if self.record.exists() else None
        out = []
        for r in _in_order(rows):
            if state is None or r["t"] - state[0] > self.ttl_us:
                state, kind = (r["t"], r["request_hash"], r["done_us"]), "new"
            elif state[1] != r["request_hash"]:
                kind = "conflict"
            else:
                kind = "replay" if r["t"] >= state[0] + state[2] else "in_flight"
            out.append({"id": r["id"], "key": key[0], "verdict": kind})
        self.record.update(state)
        yield pd.DataFrame(out, columns=["id", "key", "verdict"])

    def close(self) -> None:
        pass


class Profile(StatefulProcessor):
    """Running sender profile."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", "score double, n long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.profile.get()) if self.profile.exists() else None
        for r in _in_order(rows):
            state = (r["s"], 1, r["t"], r["t"]) if state is None else (state[0] * 0.8 + r["s"] * 0.2, state[1] + 1, state[2], r["t"])
        if state is not None:
            self.profile.update(state)
            yield pd.DataFrame([{"email": key[0], "threat_score": state[0], "email_count": state[1], "first_us": state[2], "last_us": state[3]}])

    def close(self) -> None:
        pass


def _mode(expire: bool) -> str:
    """State expires on the processing clock.

    That clock keeps a query alive for ever, so a run that must end by itself
    (``availableNow``) passes ``expire=False`` and keeps its state.
    """
    return "ProcessingTime" if expire else "None"


def _keyed(df: DataFrame, *extra: str) -> DataFrame:
    """``key`` as text, event time as ``t``."""
    return df.select("id", F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("t"), *extra)


def stream_grade_velocity(grades: DataFrame, threshold: int = 8, window_us: int = HOUR_US, expire: bool = True) -> DataFrame:
    used = grades.filter(F.col("verdict").isin("block", "safe")).withColumn("key", F.concat_ws(":", "channel", "campaign_id"))
    return _keyed(used).groupBy("key").transformWithStateInPandas(
        Velocity(threshold, window_us, expire), "id long, key string, n long, fired boolean", "Append", _mode(expire))


def stream_over_limit(log: DataFrame, capacity: float = 120.0, rate: float = 20.0, expire: bool = True) -> DataFrame:
    return _keyed(log).groupBy("key").transformWithStateInPandas(
        TokenBucket(capacity, rate, expire), "id long, key string, allowed boolean, retry_after double", "Append", _mode(expire))


def stream_duplicate_requests(log: DataFrame, ttl_us: int = 24 * HOUR_US, expire: bool = True) -> DataFrame:
    return _keyed(log, "request_hash", "done_us").groupBy("key").transformWithStateInPandas(
        Requests(ttl_us, expire), "id long, key string, verdict string", "Append", _mode(expire))


def stream_profiles(messages: DataFrame) -> DataFrame:
    """Profiles changed by each micro-batch; the latest row per sender is current."""
    s = profile_score(F.col("sender"), F.col("subject"), F.col("body"))
    rows = messages.select("id", F.col("sender").alias("key"), F.unix_micros("ts").alias("t"), s.alias("s"))
    return rows.groupBy("key").transformWithStateInPandas(
        Profile(), "email string, threat_score double, email_count long, first_us long, last_us long", "Update", "None")
