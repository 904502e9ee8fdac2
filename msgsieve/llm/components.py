"""Connected components of a links table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgsieve.llm.common import discard, scratch, written


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable from each node of ``links`` (a, b: long).

    Every round, all nodes of one label take the smallest label next to any of
    them.  Minima are aggregated with a map-side combine, so a node with any
    number of links is no burden; rounds grow with the logarithm of the
    longest chain.  Each round is written and read back, and the one before it
    deleted.
    """
    spark = links.sparkSession
    sides, path = scratch(spark, "links"), scratch(spark, "labels")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct(), sides)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp")), path)
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = step.select(F.col("old").alias("root"), F.col("comp").alias("best")).unionByName(step.select(F.col("node").alias("root"), F.col("comp").alias("best")))
        up = up.groupBy(F.col("root").alias("old")).agg(F.min("best").alias("best"))
        before, path = path, scratch(spark, "labels")
        step = written(step.join(up, "old").select("node", "old", F.least("comp", "best").alias("comp")), path)
        labels = step.select("node", "comp")
        discard(spark, before)
        if step.where("old <> comp").isEmpty():
            discard(spark, sides)
            return labels
