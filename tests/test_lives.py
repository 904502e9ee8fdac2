"""Records of a fixed life: against a walk along each key, and one key that never pauses."""
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from msgsieve.operators import ordered as od
from msgsieve.operators.lives import opens, with_record

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id long, key string, ts timestamp, request_hash string, done_us long"


def walk(rows, ttl):
    """id -> (verdict, the record's birth) by going along each key."""
    out, alive = {}, {}
    for id_, key, ts, digest, done in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        t = (ts - START) // timedelta(microseconds=1)
        if key not in alive or t - alive[key][0] > ttl:
            alive[key] = (t, digest, done)
            out[id_] = "new"
        elif alive[key][1] != digest:
            out[id_] = "conflict"
        else:
            out[id_] = "replay" if t >= alive[key][0] + alive[key][2] else "in_flight"
    return out


@pytest.mark.parametrize("ttl,span", [(3, 40), (99, 300), (99, 30_000), (86_400, 86_400 * 9)])
def test_requests_equal_a_walk(spark, ttl, span):
    rng = random.Random(ttl + span)
    rows = [(n, rng.choice(["a", "a", "a", "b", "", None]), START + timedelta(microseconds=rng.randrange(span)), rng.choice("xy"), rng.randrange(ttl)) for n in range(400)]
    got = od.duplicate_requests(spark.createDataFrame(rows, LOG), ttl).collect()
    assert {r.id: r.verdict for r in got} == walk(rows, ttl)
    assert len(got) == len(rows)


def test_one_request_a_window_equals_the_fold(spark):
    rng = random.Random(7)
    rows = [(n, rng.choice("ab"), START + timedelta(microseconds=rng.randrange(90_000)), "x", 0) for n in range(500)]
    log = spark.createDataFrame(rows, LOG)
    fold = od.ordered_fold(log.select("id", "key", "ts"), ["key"], "ts", "id",
                           lambda s, r: (s, {"id": r["id"], "born": s}) if s is not None and r["_t"] - s < 700 else (r["_t"], {"id": r["id"], "born": r["_t"]}), "id long, born long", 700)
    births = {r.id: r.born for r in fold.collect()}
    base = int(START.timestamp()) * 1_000_000
    at = {r[0]: base + (r[2] - START) // timedelta(microseconds=1) for r in rows}
    opened = {}
    for n, born in births.items():
        opened[rows[n][1], born] = min(n, opened.get((rows[n][1], born), n)) if at[n] == born else opened.get((rows[n][1], born), 10**9)
    got = od.request_rate(log, limit=1, window_us=700).collect()
    assert {r.id: r.allowed for r in got} == {n: opened[rows[n][1], b] == n for n, b in births.items()}
    assert all(r.retry_after == (0.0 if r.allowed else (700 - at[r.id] + births[r.id]) / 1e6) for r in got)


def test_rows_without_time_or_rows(spark):
    rows = [(1, "a", None, "x", 5), (2, "a", None, "y", 5), (3, None, START, "x", 5), (4, None, START, "x", 0)]
    got = od.duplicate_requests(spark.createDataFrame(rows, LOG), 10)
    assert {r.id: r.verdict for r in got.collect()} == {1: "new", 2: "new", 3: "new", 4: "in_flight"}
    assert od.duplicate_requests(spark.createDataFrame([], LOG), 10).collect() == []


def test_one_key_that_never_pauses(spark):
    """A million requests of one key, one a second, records of 100 seconds: 10,000 in a row."""
    log = spark.range(1_000_000).select("id", F.lit("hot").alias("key"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
    out = with_record(log, ["key"], "ts", "id", 100_000_000, [])
    plan = out._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "BatchEvalPython" not in plan
    got = out.select("id", opens("id").alias("new"), "record.born").agg(
        F.count("*").alias("n"), F.sum(F.col("new").cast("int")).alias("new"), F.sum((F.col("born") != F.floor(F.col("id") / 100) * 100_000_000).cast("int")).alias("wrong")).first()
    assert (got.n, got.new, got.wrong) == (1_000_000, 10_000, 0)
