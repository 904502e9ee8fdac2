"""Trailing counts and newest ranks against brute force, and one busy hour of one key."""
import random

import pytest
from pyspark.sql import functions as F

from msgsieve.operators import ordered as od


@pytest.mark.parametrize("window,span", [(7, 40), (5_000, 20_000), (1_000_000, 3_000_000)])
def test_counts_equal_brute_force(spark, window, span):
    rng = random.Random(window)
    rows = [(n, rng.choice(["a", "a", "b", None]), rng.randrange(-span, span)) for n in range(300)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, key string, us long").select("id", "key", F.timestamp_micros("us").alias("ts"))
    want = {i: sum(k == key and (t, j) <= (at, i) and t > at - window for j, k, t in rows[:-1]) for i, key, at in rows[:-1]}
    got = od.trailing_count(df, ["key"], "ts", "id", window)
    assert got.columns == ["id", "key", "ts", "n"]
    assert {r.id: r.n for r in got.collect()} == want


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(3 * od.DAY_US), rng.randrange(60)])) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, us long").select("id", "key", F.timestamp_micros("us").alias("ts"))
    order = lambda i, t: (t is not None, t or 0, i)
    want = {i: (sum(k == key and order(j, t) > order(i, at) for j, k, t in rows), sum(k == key for _, k, _ in rows)) for i, key, at in rows}
    assert {r.id: (r._newer, r._total) for r in od.newest_rank(df, ["key"], "ts", "id").collect()} == want


def test_busy_hour_of_one_key(spark):
    """A million events of one key in one hour: every cell holds a few hundred, and the counts are right."""
    n, hour = 1_000_000, 3_600_000_000
    df = spark.range(n).select("id", F.lit("hot").alias("key"), F.timestamp_micros(F.col("id") * (hour // n)).alias("ts"))
    cells = df.withColumns({"_t": F.unix_micros("ts"), "_page": F.lit(0)}).groupBy(od._cell_of("_page", hour)).count()
    assert cells.agg(F.max("count")).first()[0] < 300
    out = od.trailing_count(df, ["key"], "ts", "id", hour)
    assert out.where(F.col("n") != F.col("id") + 1).count() == 0
    out = od.trailing_count(df, ["key"], "ts", "id", hour // 4)
    assert out.agg(F.sum((F.col("n") != F.least(F.col("id") + 1, F.lit(n // 4))).cast("int")), F.count("*")).first()[:] == (0, n)
