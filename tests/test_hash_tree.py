"""Hash trees: a changed row is found by following the ranges that differ."""
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from msgsieve.operators import hash_tree as ht

SCHEMA = "id long, a string, b int"


def tree(df):
    return ht.hash_tree(df, "id", ["a", "b"])


def diff(spark, old, new):
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    ranges = ht.differing_ranges(tree(a), tree(b))
    changed = ht.changed_rows(a, b, "id", ["a", "b"], ranges)
    return {(r.lo, r.hi): (r.n_old, r.n_new) for r in ranges.collect()}, sorted(((r.id, r.change, r.copies) for r in changed.collect()), key=repr)


def test_one_changed_row_among_many(spark):
    old = spark.range(-5000, 300_000).select((F.col("id") * 1_000_003).alias("id"), F.concat(F.lit("t"), "id").alias("a"), (F.col("id") % 9).cast("int").alias("b"))
    new = old.withColumn("b", F.when(F.col("id") == 1_000_003 * 77_777, 99).otherwise(F.col("b")))
    one, two = tree(old), tree(new)
    ranges = ht.differing_ranges(one, two).collect()
    assert [(r.n_old, r.n_new) for r in ranges] == [(1, 1)] and ranges[0].lo <= 1_000_003 * 77_777 <= ranges[0].hi
    found = ht.changed_rows(old, new, "id", ["a", "b"], ht.differing_ranges(one, two))
    assert sorted(tuple(r) for r in found.collect()) == [(1_000_003 * 77_777, "added", 1), (1_000_003 * 77_777, "removed", 1)]
    assert ht.root(one).first().root != ht.root(two).first().root and ht.root(one).first().n == 305_000
    # The order and the spread of the rows don't matter.
    assert ht.root(tree(old.orderBy(F.rand(5)).repartition(3))).first() == ht.root(one).first()


def test_nulls_repeated_rows_and_borders(spark):
    old = [(None, "x", 1), (None, "x", 1), (1, None, 2), (1, "", 2), (-1, "y", None), (1 << 62, "z", 4), (-(1 << 63), "low", 5), ((1 << 63) - 1, "high", 6)]
    assert diff(spark, old, list(reversed(old))) == ({}, [])
    assert diff(spark, old, old[1:]) == ({(None, None): (2, 1)}, [(None, "removed", 1)])
    changed = [x if x[0] != (1 << 63) - 1 else (x[0], "High", 6) for x in old]
    top = (1 << 63) - 1
    assert diff(spark, old, changed) == ({(top - 1023, top): (1, 1)}, [(top, "added", 1), (top, "removed", 1)])
    # Null is not empty text, and values don't run into their neighbours.
    assert diff(spark, [(1, None, 2)], [(1, "", 2)])[1] == [(1, "added", 1), (1, "removed", 1)]
    assert len({r.h for r in spark.createDataFrame([("ab", "c"), ("a", "bc"), ("1:a", "c")], "x string, y string").select(ht.row_hash(["x", "y"]).alias("h")).collect()}) == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tuple(ht.root(tree(none)).first()) == (0, hashlib.sha256(b"").hexdigest())
    assert diff(spark, [], []) == ({}, [])
    assert diff(spark, [], [(5, "a", 1)]) == ({(0, 1023): (0, 1)}, [(5, "added", 1)])


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_comparison(spark, seed):
    def some(s):
        return [(r.id if r.id % 11 else None, f"t{r.v}", int(r.v)) for r in spark.range(3000).select((F.col("id") * 37 % 20_000 - 9000).alias("id"), F.floor(F.rand(s) * 1.02).alias("v")).collect()]
    old, new = some(seed), some(seed + 100)
    a, b = Counter(old), Counter(new)
    want = sorted([(key, "added", n) for (key, t), n in Counter({((x[0], x), 1)[0]: m for x, m in (b - a).items()}).items()]
                  + [(key, "removed", n) for (key, t), n in Counter({((x[0], x), 1)[0]: m for x, m in (a - b).items()}).items()], key=repr)
    ranges, rows = diff(spark, old, new)
    assert rows == want
    assert set(ranges) == {(None, None) if x[0] is None else (x[0] >> 10 << 10, (x[0] >> 10 << 10) + 1023) for x in ((a - b) + (b - a))}
