"""Records that live for a fixed time from the first request that finds none alive.

Which request opens a record depends on the one before, which looks like a
walk along the key.  Here every request points to the first one after the
life it would open; the requests that really open a record are those that
the pointers reach from a request with nothing before it.  Pointers are
doubled twice a round, so a chain of n records takes log4(n) rounds of equal
joins, and a key that never pauses is spread over its time slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from msgsieve.session import cut_lineage

SLICES = 64


def _pointers(times: DataFrame, pages: DataFrame, life_us: int) -> DataFrame:
    """(_k, at, to): the first instant of the key at ``at + life_us`` or later.

    ``at + life_us`` lies in the next page, in the slice of the same number.
    The instant is looked for in that slice, then in the page's later slices,
    then in the page after.  Pairs that leave a run of pages have no row.
    """
    own = times.select("_k", "_page", "_slice", F.col("_t").alias("when"), F.col("_t").alias("own"), F.lit(None).cast("long").alias("ask"))
    ask = times.select("_k", (F.col("_page") + 1).alias("_page"), "_slice", (F.col("_t") + life_us).alias("when"), F.lit(None).cast("long").alias("own"), F.col("_t").alias("ask"))
    later = Window.partitionBy("_k", "_page", "_slice").orderBy(F.desc("when")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = own.unionByName(ask).withColumn("inside", F.min("own").over(later)).where("ask is not null")
    behind = F.array_min(F.transform(F.filter("lows", lambda x: x["slice"] > F.col("_slice")), lambda x: x["low"]))
    after = pages.select("_k", (F.col("_page") - 1).alias("_page"), F.col("low").alias("after"))
    here = pages.select("_k", "_page", "lows").join(after, ["_k", "_page"], "left")
    return (asked.join(here, ["_k", "_page"])
            .select("_k", F.col("ask").alias("at"), F.coalesce("inside", behind, "after").alias("to")).where("to is not null"))


def _leap(first: DataFrame, then: DataFrame) -> DataFrame:
    """Pointers that follow ``first``, then ``then``."""
    onward = then.select("_k", F.col("at").alias("to"), F.col("to").alias("beyond"))
    return first.join(onward, ["_k", "to"]).select("_k", "at", F.col("beyond").alias("to"))


def _reached(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(_k, at): instants that the pointers reach from ``starts``, themselves included."""
    def follow(found: DataFrame, jump: DataFrame) -> DataFrame:
        return found.unionByName(found.join(jump, ["_k", "at"]).select("_k", F.col("to").alias("at")))

    nodes = starts.unionByName(pointers.select("_k", F.col("to").alias("at"))).distinct()
    jump = cut_lineage(pointers.join(nodes, ["_k", "at"], "left_semi"))
    reached = starts
    while not jump.isEmpty():
        # ``jump`` leaps 4^n records; ``reached`` holds all that fewer leaps reach.
        twice = _leap(jump, jump)
        reached = cut_lineage(follow(follow(reached, jump), twice))
        jump = cut_lineage(_leap(twice, twice))
    return reached


def with_record(df: DataFrame, keys: list[str], ts: str, tie: str, life_us: int, keep: list[str]) -> DataFrame:
    """Add ``_t`` and ``record``: the row that opened the record alive at this row.

    ``record`` holds ``born`` (microseconds), ``tie`` and the columns ``keep``.
    A row opens a record when none is alive, that is, when none was opened in
    the last ``life_us`` microseconds, its own instant included; of rows of
    one instant the smallest ``tie`` comes first and must be unique.  A null
    in a key is a key; a row without a time opens a record of its own.
    """
    page = F.floor(F.col("_t") / life_us)
    rows = df.withColumns({"_k": F.struct(*keys), "_t": F.unix_micros(ts)}).withColumn("_page", page)
    timed = rows.where("_t is not null")
    part = F.floor((F.col("_t") - F.col("_page") * life_us) * SLICES / life_us)
    times = timed.select("_k", "_page", "_t").distinct().withColumn("_slice", part)
    lows = times.groupBy("_k", "_page", "_slice").agg(F.min("_t").alias("low"))
    # At most SLICES entries a page.
    pages = cut_lineage(lows.groupBy("_k", "_page").agg(F.collect_list(F.struct(F.col("_slice").alias("slice"), "low")).alias("lows"), F.min("low").alias("low")))
    before = pages.select("_k", (F.col("_page") + 1).alias("_page"))
    starts = pages.join(before, ["_k", "_page"], "left_anti").select("_k", F.col("low").alias("at"))
    opened = _reached(starts, _pointers(times, pages, life_us)).withColumnRenamed("at", "_t")

    record = F.struct(F.col("_t").alias("born"), F.col(tie).alias("tie"), *keep)
    records = timed.join(opened, ["_k", "_t"], "left_semi").groupBy("_k", "_page", "_t").agg(F.min_by(record, F.col(tie)).alias("record"))
    # Lives are a page long: a page opens one record at most and meets the one of the page before.
    shift = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    around = (records.select("_k", "_page", "record", shift).groupBy("_k", (F.col("_page") + F.col("shift")).alias("_page"))
              .agg(F.max_by("record", F.when(F.col("shift") == 0, 1)).alias("_own"), F.max_by("record", F.when(F.col("shift") == 1, 1)).alias("_old")))
    alive = F.when(F.col("_own.born") <= F.col("_t"), F.col("_own")).otherwise(F.col("_old"))
    found = timed.join(around, ["_k", "_page"]).withColumn("record", alive).drop("_own", "_old")
    alone = rows.where("_t is null").withColumn("record", record)
    return found.unionByName(alone).drop("_k", "_page")


def opens(tie: str) -> Column:
    """Whether the row is the one that opened its record."""
    return F.col("_t").eqNullSafe(F.col("record.born")) & F.col(tie).eqNullSafe(F.col("record.tie"))
