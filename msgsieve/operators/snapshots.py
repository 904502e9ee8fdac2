"""Keyed snapshots on shared storage: a change rewrites only the pieces that hold its keys.

A snapshot is cut into pieces by the leading bits of a hash of the key, one
file each.  A version is a manifest, one row a piece, that says in which
folder the piece lies; pieces that a change leaves alone stay where they are.
A version counts once its pointer, a small file that must not exist before,
is made: a writer that is lost before that leaves the old version as it was,
and of two writers the later one is refused.  A piece that outgrows
``max_rows`` is cut by further bits of its hash.  Keys are unique, so no
piece has a hot key.

    create(old, path, ["e164"])
    rewrite(spark, path, changes, upsert_numbers)
    read(spark, path)                  # or read(spark, path, version=1)

The driver holds one line a piece of the touched pieces, as Spark's own file
listing does.  Where renaming replaces files (a local disk, object stores)
run one writer at a time.

Defined cases: null parts of a key are values of their own; an empty
snapshot has a manifest without rows; changes without rows make a version
with the same pieces; an unknown version is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from msgsieve.session import cut_lineage

MANIFEST = "depth int, prefix long, rows long, folder string"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class SnapshotConflict(RuntimeError):
    """Another writer made this version."""


@dataclass(frozen=True)
class Version:
    """What a pointer says."""

    number: int
    manifest: str
    keys: list[str]
    max_rows: int
    schema: StructType


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _pointer(path: str, number: int) -> str:
    return f"{path}/versions/{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all complete versions, ascending."""
    store, place = _files(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def load_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    known = versions(spark, path)
    number = known[-1] if number is None and known else number
    if number not in known:
        raise ValueError(f"{path} has no version {number}")
    said = json.loads(spark.read.option("wholetext", True).text(_pointer(path, number)).first()[0])
    return Version(number, said["manifest"], said["keys"], said["max_rows"], StructType.fromJson(said["schema"]))


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    store, place = _files(spark, _pointer(path, version.number))
    said = {"manifest": version.manifest, "keys": version.keys, "max_rows": version.max_rows, "schema": version.schema.jsonValue()}
    if store.exists(place):
        raise SnapshotConflict(f"version {version.number} of {path} exists")
    # The pointer appears whole: it is written aside and renamed, and a rename does not replace a file.
    _, aside = _files(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    out = store.create(aside, False)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    if not store.rename(aside, place):
        raise SnapshotConflict(f"version {version.number} of {path} exists")


def key_hash(keys: list[str]) -> Column:
    """64 bits of the key; a null part differs from every value."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])


def _prefix(depth: Column) -> Column:
    """The leading ``depth`` bits of ``_hash``; a shift by 64 would be none."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("_hash"), (64 - depth).cast("int")))


def _read_pieces(spark: SparkSession, path: str, folders: list[str], schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def _write_pieces(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` (with ``_depth`` and ``_prefix``) one file a piece; gives their manifest rows."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    named = rows.withColumn("_piece", F.format_string("d%d-%d", F.col("_depth").cast("int"), "_prefix")).drop("_depth", "_prefix", "_hash")
    named.repartition("_piece").write.partitionBy("_piece").parquet(f"{path}/{folder}")
    # The rows of each piece, counted from the written files: Parquet footers only.
    piece = F.regexp_extract_all(F.col("_piece"), F.lit(r"(\d+)"), F.lit(1))
    store, place = _files(spark, f"{path}/{folder}")
    if not any(f.isDirectory() for f in store.listStatus(place)):
        return spark.createDataFrame([], MANIFEST)
    written = spark.read.schema("_piece string").option("basePath", f"{path}/{folder}").parquet(f"{path}/{folder}")
    return written.groupBy("_piece").agg(F.count("*").alias("rows")).select(
        F.get(piece, 0).cast("int").alias("depth"), F.get(piece, 1).cast("long").alias("prefix"), "rows",
        F.concat(F.lit(f"{folder}/_piece="), F.col("_piece")).alias("folder"))


def _depth_for(rows: Column, max_rows: int) -> Column:
    """Bits that cut ``rows`` rows into pieces of about ``max_rows`` at most."""
    return F.greatest(F.ceil(F.log2(rows / F.lit(float(max_rows)))), F.lit(0)).cast("int")


def create(df: DataFrame, path: str, keys: list[str], max_rows: int = 2_000_000) -> int:
    """Write ``df``, one row per key, as version 1."""
    spark = df.sparkSession
    if versions(spark, path):
        raise SnapshotConflict(f"{path} holds a snapshot")
    depth = _depth_for(F.lit(float(max(df.count(), 1))), max_rows)
    rows = df.withColumn("_hash", key_hash(keys)).withColumn("_depth", depth)
    manifest = f"manifest/{uuid.uuid4().hex}"
    _write_pieces(rows.withColumn("_prefix", _prefix(F.col("_depth"))), path).write.parquet(f"{path}/{manifest}")
    _publish(spark, path, Version(1, manifest, keys, max_rows, df.schema))
    return 1


def manifest_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(depth, prefix, rows, folder): the pieces of a version."""
    at = load_version(spark, path, version)
    return spark.read.schema(MANIFEST).parquet(f"{path}/{at.manifest}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of the newest complete version, or of the one named."""
    at = load_version(spark, path, version)
    folders = [r.folder for r in spark.read.schema(MANIFEST).parquet(f"{path}/{at.manifest}").select("folder").toLocalIterator()]
    return _read_pieces(spark, path, folders, at.schema)


def _touched(changes: DataFrame, pieces: DataFrame, keys: list[str], depths: list[int]) -> DataFrame:
    """Distinct (depth, prefix) that hold a key of ``changes``: one equal join over the depths in use."""
    asked = changes.select(key_hash(keys).alias("_hash"), F.explode(F.lit(depths)).alias("depth")).select("depth", _prefix(F.col("depth")).alias("prefix")).distinct()
    return pieces.join(asked, ["depth", "prefix"], "left_semi")


def rewrite(spark: SparkSession, path: str, changes: DataFrame, merge: Merge) -> int:
    """New version: ``merge(rows of the touched pieces, changes)`` in their place, all other pieces as they were.

    ``merge`` is any keyed job, such as ``upsert_numbers``: a key that has no
    change must come out as it went in.  ``changes`` has the key columns.
    Keys that no piece covers (their hash range holds no row yet) become
    pieces of the greatest depth in use.  Gives the number of
    the new version.
    """
    at = load_version(spark, path)
    pieces = spark.read.schema(MANIFEST).parquet(f"{path}/{at.manifest}")
    # At most 64 depths.
    depths = sorted(r.depth for r in pieces.select("depth").distinct().collect())
    hit = _touched(changes, pieces, at.keys, depths).collect() if depths else []
    old = _read_pieces(spark, path, [r.folder for r in hit], at.schema)
    # Columns, types and order of the snapshot stay what they are.  The rows are placed and counted from one result of the merge.
    merged = cut_lineage(merge(old, changes).select(*[F.col(f.name).cast(f.dataType) for f in at.schema.fields]).withColumn("_hash", key_hash(at.keys)))
    # Below the deepest piece in use a new piece cannot overlap another.
    deepest = F.lit(depths[-1] if depths else 0)
    apart = merged
    placed = None
    if hit:
        places = spark.createDataFrame([(r.depth, r.prefix) for r in hit], "depth int, prefix long")
        asked = merged.withColumn("depth", F.explode(F.lit(sorted({r.depth for r in hit})))).withColumn("prefix", _prefix(F.col("depth")))
        placed = asked.join(places, ["depth", "prefix"]).select(*merged.columns, "depth", "prefix")
        apart = merged.join(placed.select("_hash").distinct(), "_hash", "left_anti").select(*merged.columns)
    fresh_places = apart.withColumn("depth", deepest).withColumn("prefix", _prefix(F.col("depth")))
    placed = fresh_places if placed is None else placed.unionByName(fresh_places)
    sizes = placed.groupBy("depth", "prefix").agg(F.count("*").alias("_n"))
    more = sizes.select("depth", "prefix", (F.col("depth") + _depth_for(F.col("_n"), at.max_rows)).alias("_depth"))
    rows = placed.join(more, ["depth", "prefix"]).withColumn("_prefix", _prefix(F.col("_depth"))).drop("depth", "prefix")
    fresh = _write_pieces(rows, path)
    kept = pieces.join(spark.createDataFrame([(r.folder,) for r in hit], "folder string"), "folder", "left_anti") if hit else pieces
    manifest = f"manifest/{uuid.uuid4().hex}"
    kept.select("depth", "prefix", "rows", "folder").unionByName(fresh.select("depth", "prefix", "rows", "folder")).write.parquet(f"{path}/{manifest}")
    _publish(spark, path, Version(at.number + 1, manifest, at.keys, at.max_rows, at.schema))
    return at.number + 1
