"""Connected components of a long chain: few rounds, and plans whose size estimate does not grow with them."""
from pyspark.sql import functions as F

from msgsieve.llm import components as cc


def test_long_chain(spark, monkeypatch):
    n, rounds = 400, []
    real = getattr(cc, "written", None)
    if real:
        monkeypatch.setattr(cc, "written", lambda df, path: rounds.append(path) or real(df, path))
    i = F.col("id")
    links = spark.range(n).select((i * 7919 % n).alias("a"), ((i + 1) * 7919 % n).alias("b")).where(i < n - 1)
    links = links.unionByName(spark.createDataFrame([(5000, 5001), (5001, 5000), (5002, 5001), (7000, 7000), (None, 3)], "a long, b long"))
    found = cc.components(links)
    # Before, rounds multiplied the estimate until it filled the driver.
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
    got = {r.node: r.comp for r in found.collect()}
    assert got == {k: 0 for k in range(n)} | {k: 5000 for k in (5000, 5001, 5002)}
    assert len(rounds) <= 14


def test_no_links(spark):
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
