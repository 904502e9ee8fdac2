"""Exact neighbours by pairs of blocks: equal to brute force, and no vector is shuffled for each cell it visits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.operators import lookups as lk


def brute(x, labels, k):
    out = set()
    for q in range(len(x)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        rows = [j for j in range(len(x)) if labels is None or labels[j] == labels[q]]
        out |= {(q, j, r + 1, round(d[j], 9)) for r, j in enumerate(sorted(rows, key=lambda j: (d[j], j))[:k])}
    return out


@pytest.mark.parametrize("shape", ["spread", "clusters", "alike"])
def test_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(lk, "CELL_ROWS", 10)
    monkeypatch.setattr(lk, "PART_BYTES", 1000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(230, 6))
    if shape == "clusters":
        x = x * 0.01 + rng.integers(0, 5, 230)[:, None] * 10
    if shape == "alike":
        x[::2] = 1.0
    x = x.astype("float32").astype("float64")
    labels = rng.integers(0, 3, 230)
    labels[7] = 9  # alone
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, labels))], "vec_id long, vec array<float>, label int")
    row = lambda r: (r.query_id, r.match_id, r["rank"], round(r.distance, 9))
    assert set(map(row, lk.similar_messages(df, df, 4, pivots=8).collect())) == brute(x, None, 4)
    assert set(map(row, lk.similar_messages(df, df, 3, same=["label"], pivots=8).collect())) == brute(x, labels, 3)
    few = lk.similar_messages(df.where("vec_id % 50 = 0"), df.where("vec_id < 3"), 5).collect()
    assert len(few) == 5 * 3 and {r["rank"] for r in few} == {1, 2, 3}
    assert lk.similar_messages(df.where("false"), df, 2).collect() == []
    best = lk.nearest_label(df, df.withColumn("is_threat", F.col("label") > 0)).select("query_id", "match_id", "rank", "distance")
    assert set(map(row, best.collect())) == brute(x, None, 1)


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lk, "CELL_ROWS", 10)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(100)], "vec_id long, vec array<float>")
    plan = lk.similar_messages(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    # Before, queries and corpus rows were copied to each cell and slice and met by a shuffle on these.
    assert "CartesianProduct" in plan and "FlatMapCoGroupsInPandas" not in plan
