"""Hash tree of a table over ranges of its key: one root, and the ranges in which two tables differ.

Row order: ranges ascend by key (null first, then signed order); inside a
range rows count as a multiset.  A leaf digest is therefore a sum over row
hashes, which every task adds up before anything is shuffled, so a key that
holds a third of all rows costs one row per task.  A leaf covers 1024 keys, a
node 2048 nodes of the level below, and the height is the same for every
table of 64-bit keys, so two trees always line up.

Defined cases: null keys make a range of their own; null columns differ from
empty text; repeated rows count; an empty table has no nodes, zero rows and
the hash of the empty text as its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.session import cut_lineage

SPAN_BITS = 10
FANOUT_BITS = 11
FEW_RANGES = 1 << 20    # so many ranges are sent to every task
TOP = 4     # level whose nodes hang under the root: 2^(64 - 10 - 4 * 11) of them at most, and the null one


def row_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns as text, each with its length in front, so that borders count."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def _number(key: Column, level: int) -> Column:
    return F.shiftright(key.cast("long"), SPAN_BITS + FANOUT_BITS * level)


def leaves(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(level, node, n, digest) of the lowest level; text is read once."""
    rows = df.select(_number(F.col(key), 0).alias("node"), row_hash([key, *columns]).alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}") for i in range(8)]
    added = rows.groupBy("node").agg(F.count("*").alias("n"), *sums)
    digest = F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(8)]), 256)
    return added.select(F.lit(0).alias("level"), "node", "n", digest.alias("digest"))


def _joined(children: Column) -> Column:
    """Digest of (node, digest) pairs in ascending order of node, null first."""
    named = F.transform(F.array_sort(children), lambda c: F.concat(F.coalesce(c["node"].cast("string"), F.lit("-")), F.lit(":"), c["digest"]))
    return F.sha2(F.concat_ws(",", named), 256)


def _children() -> Column:
    # The flag puts null in front; a node has at most 2^FANOUT_BITS children.
    return F.collect_list(F.struct(F.col("node").isNotNull().alias("known"), "node", "digest"))


def hash_tree(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(level, node, n, digest) of all levels from the leaves to ``TOP``.

    The leaves are written once, then the tree; a level has at most as many
    nodes as the one below, on dense keys 2048 times fewer.
    """
    level = cut_lineage(leaves(df, key, columns))
    tree = level
    for number in range(1, TOP + 1):
        up = level.withColumn("_up", F.shiftright("node", FANOUT_BITS)).groupBy("_up").agg(F.sum("n").alias("n"), _children().alias("_c"))
        level = up.select(F.lit(number).alias("level"), F.col("_up").alias("node"), "n", _joined(F.col("_c")).alias("digest"))
        tree = tree.unionByName(level)
    return cut_lineage(tree)


def root(tree: DataFrame) -> DataFrame:
    """One row (n, root): the digest over the top level, 1024 nodes and the null one at most."""
    top = tree.where(F.col("level") == TOP).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _children().alias("_c"))
    return top.select("n", F.when(F.size("_c") == 0, F.sha2(F.lit(""), 256)).otherwise(_joined(F.col("_c"))).alias("root"))


def differing_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(lo, hi, n_old, n_new): key ranges, both ends included, in which two trees differ.

    The trees are followed from the top: below a node that is equal on both
    sides nothing is compared.  Null ends stand for the null keys.
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))

    def differing(nodes: DataFrame) -> DataFrame:
        def of(side: Column, value: str) -> Column:
            return F.max(F.when(side, F.col(value)))

        pairs = nodes.groupBy("node").agg(of(~F.col("_new"), "digest").alias("_a"), of(F.col("_new"), "digest").alias("_b"),
                                          of(~F.col("_new"), "n").alias("n_old"), of(F.col("_new"), "n").alias("n_new"))
        return pairs.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))

    found = differing(both.where(F.col("level") == TOP))
    for level in range(TOP - 1, -1, -1):
        marked = found.select(F.col("node").alias("_p"))
        nodes = both.where(F.col("level") == level).withColumn("_up", F.shiftright("node", FANOUT_BITS))
        found = differing(nodes.join(marked, F.col("_up").eqNullSafe(F.col("_p")), "left_semi").drop("_up"))
    lo = F.shiftleft("node", SPAN_BITS)
    return found.select(lo.alias("lo"), (lo + F.lit((1 << SPAN_BITS) - 1)).alias("hi"), "n_old", "n_new")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str], ranges: DataFrame) -> DataFrame:
    """(key, change, copies): rows of the ranges that only ``old`` (removed) or only ``new`` (added) holds.

    A row that changed is there twice.  Only rows of differing ranges are
    hashed and shuffled; hashes are counted per task first.
    """
    marked = cut_lineage(ranges.select(F.shiftright("lo", SPAN_BITS).alias("_p")))
    if marked.count() <= FEW_RANGES:
        marked = F.broadcast(marked)  # their estimated size would have every text shuffled

    def side(df: DataFrame, sign: int) -> DataFrame:
        rows = df.join(marked, _number(F.col(key), 0).eqNullSafe(F.col("_p")), "left_semi")
        return rows.select(F.col(key).cast("long").alias(key), row_hash([key, *columns]).alias("_h"), F.lit(sign).alias("_sign"))

    balance = side(old, -1).unionByName(side(new, 1)).groupBy(key, "_h").agg(F.sum("_sign").alias("_b")).where("_b <> 0")
    return balance.select(key, F.when(F.col("_b") > 0, "added").otherwise("removed").alias("change"), F.abs("_b").alias("copies"))
