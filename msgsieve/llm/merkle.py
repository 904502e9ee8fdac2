"""Merkle manifest of a table, and a check of presented rows against it with octopus multiproofs.

Leaves of a group stand in key order.  While a level has several nodes, every
``width`` consecutive ones (the last run may have fewer, even one) become the
digest of their hex texts joined; what remains is the group's root.  The roots
of all groups, in group order (null first, bytewise), make one more tree.

1. Leaves are range-partitioned by (group, key) and packed into leaf blocks of
   at most ``BLOCK`` leaves of one group.  A block's place comes from block
   sizes alone, so a group that holds most rows is spread like any other.
2. Frontier: a block sends the largest nodes it can compute alone, about
   ``2 log n``.  Rounds of ``LEVELS`` levels fold them: what lies below one
   node of the round's top level is one group of at most ``2 ** LEVELS`` nodes.
3. Octopus: from its place alone each block names the minimal union of nodes
   that the proofs of all its leaves need and it cannot derive (the border
   nodes of each level), fetches them with one join, derives the shared
   interior nodes once, and expands every leaf's proof from them locally.

Defined cases: an empty table has no rows and no root.  A lone leaf is its own
root.  A null key comes first; a null group is a group of its own, and first.
Rows that repeat a key are leaves of their own, ordered by leaf.  Columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.llm.common import cut_lineage, scratch

BLOCK = 1 << 13
LEVELS = 10
HEX = 64
NODE = "grp string, size long, level int, idx long, hash string, root boolean"
Path = list[tuple[list[bytes], list[bytes]]]


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: each value as byte count, ``:``, text; ``-`` for null."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def join_digests(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def level_sizes(size: int, width: int) -> list[int]:
    """Number of nodes of each level of a tree, from the leaves to the root."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // width))
    return sizes


def frontier(leaves: list[bytes], start: int, size: int, width: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(level, index, digest, is root) of the largest nodes that the leaves from ``start`` on give without others."""
    nodes, a = leaves, start
    for level, count in enumerate(level_sizes(size, width)):
        b = a + len(nodes)
        if count == 1:
            yield level, 0, nodes[0], True
            return
        low, high = -(-a // width), b // width if b < count else -(-b // width)
        if low >= high:
            yield from ((level, a + i, x, False) for i, x in enumerate(nodes))
            return
        yield from ((level, i, nodes[i - a], False) for i in (*range(a, low * width), *range(high * width, b)))
        nodes, a = [join_digests(nodes[p * width - a:(p + 1) * width - a]) for p in range(low, high)], low


def missing_nodes(start: int, n: int, size: int, width: int) -> Iterator[tuple[int, int]]:
    """(level, index) of every node that the proofs of ``n`` leaves from ``start`` on need and these leaves do not give."""
    low, high = start, start + n - 1
    for level, count in enumerate(level_sizes(size, width)[:-1]):
        yield from ((level, i) for i in range(low // width * width, low))
        yield from ((level, i) for i in range(high + 1, min(high // width * width + width, count)))
        low, high = low // width, high // width


def derive_interior(leaves: list[bytes], start: int, size: int, width: int, fetched: dict[tuple[int, int], bytes]) -> tuple[list[tuple[int, list[bytes]]], bytes]:
    """(first index and nodes of each level above which the leaves lie, root)."""
    levels, nodes, low = [], leaves, start
    for level, count in enumerate(level_sizes(size, width)[:-1]):
        high = low + len(nodes)
        first = low // width * width
        nodes = [fetched[level, i] for i in range(first, low)] + nodes + [fetched[level, i] for i in range(high, min(-(-high // width) * width, count))]
        levels.append((first, nodes))
        nodes, low = [join_digests(nodes[i:i + width]) for i in range(0, len(nodes), width)], first // width
    return levels, nodes[0]


def expand_path(levels: list[tuple[int, list[bytes]]], position: int, width: int) -> Path:
    """The run's other nodes before and after the leaf's ancestor, level by level."""
    path = []
    for first, nodes in levels:
        i = position - first
        run = i // width * width
        path.append((nodes[run:i], nodes[i + 1:run + width]))
        position //= width
    return path


def fold(leaf: bytes, path: Path) -> bytes:
    for before, after in path:
        leaf = join_digests([*before, leaf, *after])
    return leaf


def _blocks(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Blocks of consecutive leaves (grp, key, leaf, presented), written: part, seq, grp, n, keys, leaves, changed, presented."""
    rows = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "key", "leaf", "presented")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        grp, keys, own, changed, presented = None, [], [], [], []

        def out() -> pa.RecordBatch:
            values = [part], [seq], [grp], [len(keys)], [keys], ["".join(own)], [changed], ["".join(presented)]
            kinds = pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.string()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "seq", "grp", "n", "keys", "leaves", "changed", "presented"])

        for batch in batches:
            for g, key, leaf, other in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if keys and (g != grp or len(keys) == BLOCK):
                    yield out()
                    seq, keys, own, changed, presented = seq + 1, [], [], [], []
                grp = g
                if other is not None and other != leaf:
                    changed.append(len(keys))
                    presented.append(other)
                keys.append(key)
                own.append(leaf)
        if keys:
            yield out()

    path = scratch(leaves.sparkSession, "merkle-blocks")
    rows.mapInArrow(pack, "part int, seq long, grp string, n long, keys array<string>, leaves string, changed array<int>, presented string").write.parquet(path)
    return leaves.sparkSession.read.parquet(path)


def _places(blocks: DataFrame) -> DataFrame:
    """part, seq, grp, n, start, size: where each block lies in its group's tree."""
    lengths = blocks.select("part", "seq", "grp", "n")
    inside = Window.partitionBy("grp", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lengths.groupBy("grp", "part").agg(F.sum("n").alias("own"))
    parts = parts.select("grp", "part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("ahead"))
    sizes = lengths.groupBy("grp").agg(F.sum("n").alias("size"))
    placed = lengths.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["grp", "part"]).join(sizes, "grp")
    return cut_lineage(placed.select("part", "seq", "grp", "n", (F.col("ahead") + F.col("inside")).alias("start"), "size"))


def _split(leaves: str) -> list[bytes]:
    data = leaves.encode()
    return [data[i:i + HEX] for i in range(0, len(data), HEX)]


def _nodes(blocks: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """Every node that spans blocks, and each block's largest own ones."""
    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                found = [(row.grp, row.size_, level, i, x.decode(), top) for level, i, x, top in frontier(_split(row.leaves), row.start, row.size_, width)]
                yield pd.DataFrame(found, columns=["grp", "size", "level", "idx", "hash", "root"])

    placed = blocks.select("part", "seq", "leaves").join(places, ["part", "seq"]).withColumnRenamed("size", "size_")
    sent = cut_lineage(placed.select("grp", "start", "size_", "leaves").mapInPandas(send, NODE))
    largest = sent.agg(F.max("size")).first()[0] or 0
    height, found, carried = len(level_sizes(largest, width)) - 1, [sent], None
    step = max(1, int(LEVELS / (width - 1).bit_length()))
    for low in range(0, height, step):
        top = low + step
        here = sent.where((F.col("level") >= low) & (F.col("level") < top) & ~F.col("root"))
        here = here if carried is None else here.unionByName(carried)
        under = F.expr(f"idx div cast(pow({width}, {top} - level) as bigint)").alias("under")
        folded = cut_lineage(here.groupBy("grp", under).applyInPandas(_folder(width, top), NODE))
        carried = folded.where((F.col("level") == top) & ~F.col("root"))
        found.append(folded)
    store = found[0]
    for more in found[1:]:
        store = store.unionByName(more)
    return store


def _folder(width: int, top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def up(rows: pd.DataFrame) -> pd.DataFrame:
        grp, size = rows["grp"].iloc[0], int(rows["size"].iloc[0])
        sizes, out = level_sizes(size, width), []
        at: dict[int, dict[int, bytes]] = {}
        for level, i, x in zip(rows["level"], rows["idx"], rows["hash"]):
            at.setdefault(int(level), {})[int(i)] = x.encode()
        for level in range(min(at), min(top, len(sizes) - 1)):
            nodes = at.get(level, {})
            for parent in sorted({i // width for i in nodes}):
                run = [nodes[i] for i in range(parent * width, min(parent * width + width, sizes[level]))]
                value = join_digests(run)
                at.setdefault(level + 1, {})[parent] = value
                out.append((grp, size, level + 1, parent, value.decode(), sizes[level + 1] == 1))
        return pd.DataFrame(out, columns=["grp", "size", "level", "idx", "hash", "root"])

    return up


def _multiproofs(places: DataFrame, store: DataFrame, width: int) -> DataFrame:
    """part, seq, fetched: for each block the missing nodes, each once."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, seqs, groups, levels, ids = [], [], [], [], []
            for part, seq, grp, n, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                for level, i in missing_nodes(start, n, size, width):
                    parts.append(part), seqs.append(seq), groups.append(grp), levels.append(level), ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in ((parts, pa.int32()), (seqs, pa.int64()), (groups, pa.string()), (levels, pa.int32()), (ids, pa.int64()))],
                                             ["part", "seq", "grp", "level", "idx"])

    wanted = places.select("part", "seq", "grp", "n", "start", "size").mapInArrow(name, "part int, seq long, grp string, level int, idx long")
    # At most 2 * (width - 1) nodes a level and block.
    return wanted.join(store.select("grp", "level", "idx", "hash"), ["grp", "level", "idx"]).groupBy("part", "seq").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("fetched"))


def _expanded(blocks: DataFrame, placed: DataFrame, proofs: DataFrame, width: int, one: Callable, schema: str) -> DataFrame:
    """``one(row, position, leaf, presented, path, root)`` for every leaf of every block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                fetched = {(x["level"], x["idx"]): x["hash"].encode() for x in (row.fetched if row.fetched is not None else ())}
                leaves = _split(row.leaves)
                levels, root = derive_interior(leaves, row.start, row.size_, width, fetched)
                presented = dict(zip(row.changed, _split(row.presented)))
                yield pd.DataFrame([one(row, i, leaf, presented.get(i, leaf), expand_path(levels, row.start + i, width), root) for i, leaf in enumerate(leaves)],
                                   columns=[c.split()[0] for c in schema.split(", ")])

    whole = blocks.drop("n", "grp").join(placed.withColumnRenamed("size", "size_"), ["part", "seq"]).join(proofs, ["part", "seq"], "left")
    return whole.mapInPandas(run, schema)


def _tagged(group: Column) -> Column:
    """Null first, then bytewise, without nulls."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group))


def audit(rows: DataFrame, width: int = 2) -> DataFrame:
    """Check presented leaves against the manifest of all rows.

    ``rows`` has grp (string), key (long), leaf (hex digest of the row) and
    presented (hex digest of the row as somebody presents it; null: the same).
    Returns key, grp, leaf, subroot, root, proof_sha256 (digest of the proof's
    nodes, level by level over subroot to root, left to right), folded_root
    (from the presented leaf and the proof) and verified.
    """
    spark = rows.sparkSession
    path = scratch(spark, "merkle-leaves")
    rows = rows.select(_tagged(F.col("grp").cast("string")).alias("grp"), F.col("key").cast("long").alias("number"), "leaf", "presented")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    leaves = spark.read.parquet(path).withColumn("key", F.col("number").cast("string"))
    blocks = _blocks(leaves, ["grp", "number", "leaf", "row"])
    places = _places(blocks)
    store = _nodes(blocks, places, width)
    upper = _group_paths(store.where("root").select("grp", "hash"), width)
    proofs = _multiproofs(places, store, width)

    def one(row, i, leaf, presented, path, subroot):
        path = path + [([x.encode() for x in p["before"]], [x.encode() for x in p["after"]]) for p in row.path]
        folded = fold(presented, path).decode()
        return (row.keys[i], row.grp, leaf.decode(), subroot.decode(), row.top, join_digests([x for before, after in path for x in (*before, *after)]).decode(), folded, folded == row.top)

    found = _expanded(blocks, places.join(upper, "grp"), proofs, width, one,
                      "key string, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumn("key", F.col("key").cast("long")).withColumn("grp", F.expr("if(grp = '', null, substr(grp, 2))"))


def _group_paths(roots: DataFrame, width: int) -> DataFrame:
    """grp, top, path: the proof of each group's root in the tree of all groups' roots."""
    leaves = roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("hash").alias("leaf"), F.lit(None).cast("string").alias("presented"))
    blocks = _blocks(leaves, ["key"])
    places = _places(blocks)
    store = _nodes(blocks, places, width)

    def one(row, i, leaf, presented, path, root):
        return row.keys[i], root.decode(), [{"before": [x.decode() for x in before], "after": [x.decode() for x in after]} for before, after in path]

    return cut_lineage(_expanded(blocks, places, _multiproofs(places, store, width), width, one, "grp string, top string, path array<struct<before:array<string>,after:array<string>>>"))
