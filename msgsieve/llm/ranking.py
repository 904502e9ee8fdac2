"""Ranks and running sums inside groups of any size, without one task per group.

Rows of a group are dealt to chunks that are ordered among themselves.  Each
chunk is ranked on its own; what precedes a chunk comes from a small table of
chunk totals.  With about sqrt(rows) chunks both windows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, group: list[str], chunk: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows before this one, by (chunk, order)."""
    own = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    inside = rows.withColumn("_own", F.sum(value).over(own) - F.col(value))
    return inside.join(totals.drop("_sum"), [*group, chunk]).withColumn(out, F.col("_ahead") + F.col("_own")).drop("_ahead", "_own")
