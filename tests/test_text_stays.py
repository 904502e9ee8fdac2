"""Two states of the messages are compared without a shuffle of their texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from msgsieve.catalog.registry import Inputs
from msgsieve.catalog.snapshot_queries import OLDER, states
from msgsieve.operators import hash_tree as ht


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.range(1, 3001).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(9).alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id % 500 = 0")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


def events(spark, folder, times):
    ids = spark.range(1, 40_001).select(F.col("id").alias("event_id")).where("event_id % 7 <> 0")
    some = ids.where("event_id % 100 = 3")
    for _ in range(times):
        ids = ids.unionByName(some)
    ids = ids.unionByName(spark.range(3).select(F.lit(None).cast("long").alias("event_id")))
    ids.select("event_id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts")).write.parquet(str(folder / "events.parquet"))
    return Inputs(spark, str(folder))


def test_same_rows_as_messages(spark, folder):
    i = events(spark, folder, 2)
    a, b = i.messages.drop("ts"), i.timeless_messages
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert a.count() == b.count() > 3000
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_text_is_shuffled(spark, folder):
    i = events(spark, folder, 0)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        old, new = states(i)
        for side in (old, new):
            assert "SortMergeJoin" not in side._jdf.queryExecution().executedPlan().toString()
        ranges = ht.differing_ranges(*[ht.hash_tree(x, "id", OLDER[1:]) for x in (old, new)])
        plan = ht.changed_rows(old, new, "id", OLDER[1:], ranges)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_ingest_texts_do_not_meet_events(spark, tmp_path, monkeypatch):
    """R15 needs no time of an event: its messages are read without one, a repeated event still repeats its message."""
    from msgsieve import catalog
    from msgsieve.catalog.registry import QUERIES, Inputs
    catalog.load()
    spark.createDataFrame([(i, f"text {i}", "en", "web", 6) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2,), (3,), (3,)], "event_id long").selectExpr(
        "event_id", "timestamp'2024-01-01' as ts", "event_id as user_id", "'view' as event_type", "1.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(Inputs, "messages", property(lambda self: 1 / 0))
    got = QUERIES["R15_batch_ingest"](Inputs(spark, str(tmp_path)))
    ids = sorted(r["id"] for r in got.collect())
    assert set(ids) == {2, 3, 4} and ids.count(3) > 1
