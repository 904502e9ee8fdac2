"""Sparse text classifier: n-gram tables, logistic training, calibration, scoring.

A model is two small tables, so scoring is a join and a sum:

* ``terms`` (kind, term, idx, idf, weight): at most 15,000 word and 10,000
  character n-grams, a bound fixed by the vocabulary sizes;
* ``extras`` (name, weight) for the structural features, intercept and
  calibration.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from msgsieve.operators.ordered import top_per_key
from msgsieve.operators.quantiles import values_at
from msgsieve.session import checkpoint_dir, cut_lineage, discard, written

WORD_TERMS, CHAR_TERMS = 15_000, 10_000
SLICE_BYTES = 1 << 20  # text whose terms a task holds at a time, if no single text is longer
CELLS = 1 << 20
MIN_CALIBRATION_ROWS = 50
THRESHOLD = 0.5


@dataclass(frozen=True)
class TextModel:
    terms: DataFrame
    structural: tuple[str, ...]
    structural_weights: tuple[float, ...]
    intercept: float
    platt_a: float = 1.0
    platt_b: float = 0.0
    calibrated: bool = False
    kinds: str = "wc"
    version: int = 0


MODEL_ROWS = "kind string, term string, idx int, idf double, weight double"


def publish_model(model: TextModel, path: str, version: int) -> None:
    """Write ``model`` as one version of the model table under ``path``; versions that are there stay as they are.

    A version is complete or absent: readers look for the marker that Spark's
    writer leaves when all of its files are there.
    """
    numbers = [("intercept", model.intercept), ("platt_a", model.platt_a), ("platt_b", model.platt_b), ("calibrated", float(model.calibrated)),
               *[(f"s:{name}", w) for name, w in zip(model.structural, model.structural_weights)]]
    extras = model.terms.sparkSession.createDataFrame([("x", name, i, 0.0, float(v)) for i, (name, v) in enumerate(numbers)], MODEL_ROWS)
    rows = model.terms.select("kind", "term", F.col("idx").cast("int").alias("idx"), "idf", "weight").unionByName(extras)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/version={version}")


def newest_version(spark, path: str) -> int | None:
    """The highest complete version under ``path``, asked from whatever store holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    names = [f.getPath().getName() for f in store.listStatus(place)]
    ready = [int(n.split("=")[1]) for n in names if n.startswith("version=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(ready, default=None)


def load_model(spark, path: str, version: int | None = None) -> TextModel | None:
    """A published version of the model, the newest unless one is named."""
    version = newest_version(spark, path) if version is None else version
    if version is None:
        return None
    rows = spark.read.schema(MODEL_ROWS).parquet(f"{path}/version={version}")
    numbers = {r["term"]: r["weight"] for r in rows.filter("kind = 'x'").orderBy("idx").collect()}  # a row per structural feature
    terms = rows.filter("kind <> 'x'")
    kinds = "".join(sorted(r["kind"] for r in terms.select("kind").distinct().collect()))
    names = [n for n in numbers if n.startswith("s:")]
    return TextModel(terms, tuple(n[2:] for n in names), tuple(numbers[n] for n in names), numbers["intercept"], numbers["platt_a"], numbers["platt_b"],
                     bool(numbers["calibrated"]), kinds or "w", version)


def word_list(text: Column) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def plain_words(text: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


MIX = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(units: np.ndarray, group: np.ndarray, names: pa.Array, hashes: np.ndarray, sizes: tuple[int, ...], gap: str):
    """For each of ``sizes``: (group, code, hashes, terms) of every run of so many units inside one group.

    ``code`` points into ``hashes``, and ``terms(codes)`` makes the terms of some codes.
    """
    at, code, mixed, first = np.arange(len(units)), units, hashes, len(names)

    def terms(codes):
        return names.take(pa.array(codes))

    for n in range(1, max(sizes) + 1):
        if n > 1:
            inside = at + n <= len(units)
            at, code = at[inside], code[inside]
            inside = group[at] == group[at + n - 1]
            at, code = at[inside], code[inside]
            found, code = np.unique(code * first + units[at + n - 1], return_inverse=True)
            mixed = (mixed[found // first] ^ (mixed[found // first] >> np.uint64(29))) * MIX + hashes[found % first]

            def terms(codes, found=found, shorter=terms):
                return pc.binary_join_element_wise(shorter(found[codes] // first), names.take(pa.array(found[codes] % first)), gap)
        if n in sizes:
            yield group[at], code, mixed, terms


def _codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype("int64"), coded.dictionary


def _word_counts(texts: pa.Array):
    """(row, tf, code, hashes, terms) of the 1- to 3-grams of words of each text."""
    split = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    word, names = _codes(split.flatten())
    hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    for rows, code, mixed, terms in _ngrams(word, row, names, hashes, (1, 2, 3), " "):
        key, tf = np.unique(rows * len(mixed) + code, return_counts=True)
        yield key // max(len(mixed), 1), tf, key % max(len(mixed), 1), mixed, terms


def _char_counts(texts: pa.Array):
    """(row, tf, code, hashes, terms) of the 3- to 5-character grams inside blank-padded words; each distinct word is cut once."""
    split = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    word, names = _codes(split.flatten())
    pair, times = np.unique(row * len(names) + word, return_counts=True)
    bits = int(times.max()).bit_length()
    padded = [f" {w} " for w in names.to_pylist()]
    letters, units = np.unique(np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32), return_inverse=True)
    owner = np.repeat(np.arange(len(padded)), [len(w) for w in padded])
    for owners, code, mixed, terms in _ngrams(units.astype("int64"), owner, pa.array([chr(c) for c in letters]), letters.astype("uint64"), (3, 4, 5), ""):
        count = np.bincount(owners, minlength=len(padded))
        start = np.cumsum(count) - count
        mine = pair % len(names)
        each = count[mine]
        # Cell j of a (text, word) pair is the word's j-th gram.
        cell = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[mine], each)
        cells = np.sort((np.repeat(pair // len(names), each) * len(mixed) + code[cell]) << bits | np.repeat(times, each))
        key = cells >> bits
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, tf = key[head], np.add.reduceat(cells & ((1 << bits) - 1), head) if len(head) else head
        yield key // max(len(mixed), 1), tf, key % max(len(mixed), 1), mixed, terms


COUNTERS = {"w": _word_counts, "c": _char_counts}


def _cut_words(text: str, kind: str) -> Column:
    """The words of ``text`` with a blank between them; Spark cuts them."""
    return F.concat_ws(" ", word_list(F.col(text)) if kind == "w" else plain_words(F.col(text)))


def _slices(batch: pa.RecordBatch, column: str):
    """Some rows of ``batch`` at a time: ``SLICE_BYTES`` of words, if no single text is longer."""
    ends = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False).astype("int64")) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1), len(ends)]
    return (batch.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:]) if hi > lo)


def _counted(words: pa.Array, kind: str):
    """What the counter of ``kind`` finds in the texts that have words."""
    full = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)
    if len(full):
        for row, tf, code, mixed, terms in COUNTERS[kind](words.take(pa.array(full))):
            yield full[row], tf, code, mixed, terms


def _row_counts(df: DataFrame, text: str, kind: str) -> DataFrame:
    """(id, kind, term, tf), a row per row and distinct term; nothing is shuffled.

    Spark cuts the words; a task counts the grams of some texts at a time.
    """
    rows = df.select("id", _cut_words(text, kind).alias("words"))
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for part in _slices(batch, "words"):
                for row, tf, code, mixed, terms in _counted(part["words"], kind):
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(row)), terms(np.arange(len(mixed))).take(pa.array(code)), pa.array(tf, pa.int64())], names=["id", "term", "tf"])

    counted = rows.mapInArrow(count, f"id {id_type}, term string, tf bigint")
    return counted.select("id", F.lit(kind).alias("kind"), "term", "tf")


def by_repetition(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id comes once, and those of ids that come more than once, None without any."""
    many = df.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_many"))
    if many.isEmpty():
        return df, None
    same = F.col("id").eqNullSafe(F.col("_many"))
    return df.join(many, same, "left_anti"), df.join(many, same, "left_semi")


def term_counts(df: DataFrame, text: str = "text", kinds: str = "wc") -> DataFrame:
    """(id, kind, term, tf), one row per id and distinct term.

    A row's terms are counted where the row lies.  Only rows whose id comes
    more than once are added up over a shuffle.
    """
    def counted(rows: DataFrame) -> DataFrame:
        parts = [_row_counts(rows, text, k) for k in "wc" if k in kinds]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    once, several = by_repetition(df)
    if several is None:
        return counted(df)
    return counted(once).unionByName(counted(several).groupBy("id", "kind", "term").agg(F.sum("tf").alias("tf")))


def fit_vocabulary(counts: DataFrame, documents: int, part: DataFrame | None = None) -> DataFrame:
    """(kind, term, idx, idf): the most frequent terms per kind with smooth idf; ties by term.

    Most word terms are rare, and these are not shuffled.  ``part`` are the
    counts of some of the rows (by default those of every 32nd id): its leading
    terms, as many as are wanted, are counted over all rows, so the least of
    their totals is at most that of the last term to keep.  The other terms are
    added up in cells by hash, and only those of cells that reach this total
    are counted one by one: no term in another cell can be among the first.
    Pieces of words are few, and a task adds up its own first.
    """
    totals = [F.sum("tf").alias("total"), F.count("*").alias("df")]
    words = counts.filter("kind = 'w'").select("term", "tf", F.pmod(F.xxhash64("term"), F.lit(CELLS)).alias("cell"))
    part = counts.filter(F.pmod(F.xxhash64("id"), F.lit(32)) == 0) if part is None else part
    some = part.filter("kind = 'w'").groupBy("term").agg(F.sum("tf").alias("total"))
    leading = cut_lineage(some.orderBy(F.desc("total"), F.asc("term")).limit(WORD_TERMS).select("term"))
    first = cut_lineage(words.join(F.broadcast(leading), "term", "left_semi").groupBy("term").agg(*totals))
    known = first.agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    bound = known["least"] if known["n"] == WORD_TERMS else 0
    others = words.join(F.broadcast(leading), "term", "left_anti")
    if bound:
        full = cut_lineage(others.groupBy("cell").agg(F.sum("tf").alias("total")).filter(F.col("total") >= bound).select("cell"))
        others = others.join(F.broadcast(full), "cell", "left_semi")
    per = first.unionByName(others.groupBy("term").agg(*totals)).filter(F.col("total") >= bound).select(F.lit("w").alias("kind"), "*")
    per = cut_lineage(per.unionByName(counts.filter("kind = 'c'").groupBy("kind", "term").agg(*totals)))
    return _ranked(per, documents)


def _ranked(per: DataFrame, documents: int) -> DataFrame:
    """The vocabulary out of (kind, term, total, df)."""
    sizes = {"w": WORD_TERMS, "c": CHAR_TERMS}
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    # The exact count of the last term to keep is found first, so that only about
    # 25,000 rows reach the two ranking groups, however many terms there are.
    cut = values_at(per, ["kind"], "total", {"least": F.greatest(F.col("n") - size[F.col("kind")], F.lit(0))}).select("kind", "least")
    kept = per.join(F.broadcast(cut), "kind").filter(F.col("total") >= F.col("least"))
    top = top_per_key(kept, ["kind"], [F.desc("total"), F.asc("term")], max(sizes.values())).filter(F.col("rank") <= size[F.col("kind")])
    offset = F.when(F.col("kind") == "w", 0).otherwise(WORD_TERMS)
    return top.select("kind", "term", (F.col("rank") - 1 + offset).alias("idx"), (F.log(F.lit(1.0 + documents) / (F.col("df") + 1)) + 1).alias("idf"))


def _totals(rows: DataFrame, text: str, kind: str, leading: pa.Array | None = None, full: np.ndarray | None = None) -> DataFrame:
    """(term, total, df) of ``rows`` (id, text, once), added up for some texts at a time; ``df`` counts rows that come once.

    With ``leading``, a task returns the sums of these terms, and of the others
    the total of each cell (cell, total).  With ``full`` besides, it returns
    the other terms of these cells.
    """
    shift = np.uint64(64 - (CELLS - 1).bit_length())

    def work(batches):
        sums, counts, cells = (np.zeros(n, np.int64) for n in ((0, 0, 0) if leading is None or full is not None else (len(leading), len(leading), CELLS)))
        for batch in batches:
            for part in _slices(batch, "words"):
                once = part["once"].to_numpy(zero_copy_only=False).astype("int64")
                for row, tf, code, mixed, terms in _counted(part["words"], kind):
                    total = np.bincount(code, tf, len(mixed)).astype("int64")
                    found = np.bincount(code, once[row], len(mixed)).astype("int64")
                    kept = np.arange(len(mixed))
                    if leading is not None:
                        cell = ((mixed * MIX) >> shift).astype("int64")
                        if full is not None:
                            kept = kept[full[cell]]
                        names = terms(kept)
                        at = pc.index_in(names, value_set=leading).fill_null(-1).to_numpy(zero_copy_only=False)
                        if full is None:
                            known = at >= 0
                            sums[at[known]] += total[known]
                            counts[at[known]] += found[known]
                            cells += np.bincount(cell[~known], total[~known], CELLS).astype("int64")
                            continue
                        kept, names = kept[at < 0], names.filter(pa.array(at < 0))
                    else:
                        names = terms(kept)
                    yield pa.RecordBatch.from_arrays([names, pa.nulls(len(kept), pa.int64()), pa.array(total[kept]), pa.array(found[kept])], columns)
        for k in range(0, len(sums), 65536):
            yield pa.RecordBatch.from_arrays([leading[k:k + 65536], pa.nulls(len(sums[k:k + 65536]), pa.int64()), pa.array(sums[k:k + 65536]), pa.array(counts[k:k + 65536])], columns)
        used = np.flatnonzero(cells)
        for k in range(0, len(used), 65536):
            some = used[k:k + 65536]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some), pa.array(cells[some]), pa.array(np.zeros(len(some), np.int64))], columns)

    columns = ["term", "cell", "total", "df"]
    return rows.select(_cut_words(text, kind).alias("words"), "once").mapInArrow(work, "term string, cell bigint, total bigint, df bigint")


def vocabulary_of(df: DataFrame, documents: int, text: str = "text") -> DataFrame:
    """``fit_vocabulary`` of the terms of ``df`` (id, text), without a row for each text and term.

    The same search: leading terms of every 32nd id, exact sums of these and of
    cells of the others, then the terms of the cells that reach the bound.
    Tasks add up what they count; texts are read for words three times, a 32nd
    of them in the first.
    """
    rows = df.select("id", text)
    once, several = by_repetition(rows)
    rows = once.withColumn("once", F.lit(True))
    added = [F.sum("total").alias("total"), F.sum("df").alias("df")]
    if several is not None:
        # Terms of an id count once for all of its rows: their totals come with the others, the number of ids apart.
        rows = rows.unionByName(several.withColumn("once", F.lit(False)))
        ids = term_counts(several, text).groupBy("kind", "term").agg(F.count("*").alias("df"))
    some = _totals(rows.filter(F.pmod(F.xxhash64("id"), F.lit(32)) == 0), text, "w").groupBy("term").agg(F.sum("total").alias("total"))
    leading = pa.array([r["term"] for r in some.orderBy(F.desc("total"), F.asc("term")).limit(WORD_TERMS).collect()], pa.string())
    first = cut_lineage(_totals(rows, text, "w", leading).groupBy("term", "cell").agg(*added))
    known = first.filter("cell is null").agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    bound = known["least"] if known["n"] == WORD_TERMS else 0
    full = np.ones(CELLS, bool)
    if bound:
        full[:] = False
        full[first.filter((F.col("cell").isNotNull()) & (F.col("total") >= bound)).select("cell").toPandas()["cell"].to_numpy("int64")] = True
    others = _totals(rows, text, "w", leading, full).groupBy("term").agg(*added)
    words = first.filter("cell is null").select("term", "total", "df").unionByName(others.filter(F.col("total") >= bound)).select(F.lit("w").alias("kind"), "*")
    per = words.unionByName(_totals(rows, text, "c").groupBy("term").agg(*added).select(F.lit("c").alias("kind"), "*"))
    if several is not None:
        per = per.unionByName(ids.select("kind", "term", F.lit(0).cast("bigint").alias("total"), "df"))
        per = per.groupBy("kind", "term").agg(*added).filter(F.col("total") > 0)
    return _ranked(cut_lineage(per), documents)


def some_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Word counts of the rows of every 32nd id, for the bound of ``fit_vocabulary``."""
    return term_counts(df.filter(F.pmod(F.xxhash64("id"), F.lit(32)) == 0), text, "w")


def weighted_terms(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The counts of known terms with ``x``, sublinear tf times idf."""
    return counts.join(F.broadcast(vocabulary), ["kind", "term"]).withColumn("x", (F.log("tf") + 1) * F.col("idf"))


def tfidf_rows(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, kind, term, idx, x): sublinear tf times idf, L2-normalised per message and kind."""
    x = weighted_terms(counts, vocabulary)
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id", "kind")))
    return x.withColumn("x", F.col("x") / norm)


@F.udf(VectorUDT())
def _sparse(cells, size):
    cells = sorted((c["idx"], float(c["x"])) for c in cells)
    return SparseVector(size, [i for i, _ in cells], [v for _, v in cells])


def feature_matrix(df: DataFrame, x: DataFrame, structural: list[str]) -> DataFrame:
    """(id, label, features): n-gram blocks and structural block as one sparse vector.

    ``x`` are the weighted term rows of the same messages.  Used for training
    only; scoring needs no vectors.
    """
    cells = x.select("id", "idx", "x")
    base = WORD_TERMS + CHAR_TERMS
    dense = F.filter(F.array(*[F.struct(F.lit(base + i).alias("idx"), F.col(c).cast("double").alias("x")) for i, c in enumerate(structural)]),
                     lambda s: s["x"] != 0) if structural else F.array().cast("array<struct<idx:int,x:double>>")
    packed = cells.groupBy("id").agg(F.collect_list(F.struct("idx", "x")).alias("_cells"))
    joined = df.select("id", "label", dense.alias("_dense")).join(packed, "id", "left")
    whole = F.concat(F.coalesce("_cells", F.array().cast("array<struct<idx:int,x:double>>")), "_dense")
    return joined.select("id", "label", _sparse(whole, F.lit(base + len(structural))).alias("features"))


class Lookup:
    """A term table for look-ups inside a task: per kind its terms with idx, idf and weight."""

    def __init__(self, kinds: dict):
        self.kinds = kinds

    @classmethod
    def of(cls, terms: DataFrame, kinds: str = "wc") -> Lookup | None:
        """None if a term comes twice or lacks a number; then joins do the work."""
        if "weight" not in terms.columns:
            terms = terms.withColumn("weight", F.lit(0.0))
        rows = terms.filter(F.col("kind").isin(*kinds)).select("kind", "term", F.col("idx").cast("int").alias("idx"), F.col("idf").cast("double").alias("idf"), F.col("weight").cast("double").alias("weight")).toPandas()
        if rows.isna().any(axis=None) or rows.duplicated(["kind", "term"]).any():
            return None
        return cls({k: (pa.array(r["term"].tolist(), pa.string()), *[r[c].to_numpy(t) for c, t in (("idx", "int64"), ("idf", "float64"), ("weight", "float64"))]) for k, r in rows.groupby("kind")})

    def counts(self, words: pa.Array, kind: str):
        """(row, place in the table, tf) of the known terms of each text."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if kind in self.kinds:
            for row, tf, code, mixed, terms in _counted(words, kind):
                place = pc.index_in(terms(np.arange(len(mixed))), value_set=self.kinds[kind][0]).fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")[code]
                known = place >= 0
                found.append((row[known], place[known], tf[known]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def cells(self, words: pa.Array, kind: str):
        """(row, place, x); x is sublinear tf times idf, not yet normalised."""
        row, place, tf = self.counts(words, kind)
        return row, place, (np.log(tf) + 1) * self.kinds[kind][2][place] if len(tf) else np.zeros(0)

    def margin(self, words: dict) -> np.ndarray:
        """The n-gram part of the margin of each text."""
        n = len(next(iter(words.values())))
        out = np.zeros(n)
        for kind, texts in words.items():
            row, place, x = self.cells(texts, kind)
            if len(row):
                norm = np.sqrt(np.bincount(row, x * x, n))
                out += np.divide(np.bincount(row, x * self.kinds[kind][3][place], n), norm, out=np.zeros(n), where=norm > 0)
        return out


def encoded(df: DataFrame, vocabulary: DataFrame, structural: list[str], path: str | None = None) -> DataFrame:
    """``feature_matrix`` of the messages ``df``, each packed where it lies; only rows of repeated ids meet over a shuffle.

    With ``path``, texts are counted once: places and counts of the known
    terms are written there, and each use makes vectors of them.
    """
    table = Lookup.of(vocabulary.select("kind", "term", "idx", "idf"))
    once, several = by_repetition(df)
    base = WORD_TERMS + CHAR_TERMS

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return written(rows, f"{path}/{name}") if path else rows

    def slow(rows: DataFrame) -> DataFrame:
        return kept(feature_matrix(rows, tfidf_rows(term_counts(rows), vocabulary), structural), "several")

    if table is None:
        return slow(df)
    idf = np.zeros(base)
    for _, idx, values, _ in table.kinds.values():
        idf[idx] = values
    numbers = [f"s{i}" for i in range(len(structural))]
    vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def lists(row, n, *values):
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))], pa.int32())
        return [pa.ListArray.from_arrays(ends, v) for v in values]

    def count(batches):
        for batch in batches:
            for part in _slices(batch, "w"):
                named = pc.is_valid(part["id"]).to_numpy(zero_copy_only=False)
                found = []
                for kind in "wc":
                    row, place, tf = table.counts(part[kind], kind)
                    found.append([v[named[row]] for v in (row, table.kinds[kind][1][place] if len(place) else place, tf)])
                row, idx, tf = (np.concatenate(v) for v in zip(*found))
                order = np.lexsort((idx, row))
                yield pa.RecordBatch.from_arrays([part["id"], part["label"], *[part[c] for c in numbers], *lists(row, part.num_rows, pa.array(idx[order], pa.int32()), pa.array(tf[order], pa.int32()))],
                                                 ["id", "label", *numbers, "idx", "tf"])

    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            row = np.repeat(np.arange(n), pc.list_value_length(batch["idx"]).to_numpy(zero_copy_only=False))
            idx, tf = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("idx", "tf"))
            x = (np.log(tf) + 1) * idf[idx]
            block = 2 * row + (idx >= WORD_TERMS)
            x = x / np.sqrt(np.bincount(block, x * x, 2 * n))[block]
            for i, c in enumerate(numbers):
                value = batch[c].fill_null(0.0).to_numpy(zero_copy_only=False)
                full = np.flatnonzero(value != 0)
                row, idx, x = np.r_[row, full], np.r_[idx, np.full(len(full), base + i)], np.r_[x, value[full]]
            if numbers:
                order = np.lexsort((idx, row))
                row, idx, x = row[order], idx[order], x[order]
            features = pa.StructArray.from_arrays([pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, base + len(numbers)), pa.int32()), *lists(row, n, pa.array(idx, pa.int32()), pa.array(x, pa.float64()))], fields=list(vector))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], features], ["id", "label", "features"])

    rows = once.select("id", "label", *[_cut_words("text", k).alias(k) for k in "wc"], *[F.col(c).cast("double").alias(name) for name, c in zip(numbers, structural)])
    shown = [df.schema["id"], df.schema["label"]]
    cells = rows.mapInArrow(count, StructType([*shown, *[StructField(c, DoubleType()) for c in numbers], StructField("idx", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))]))
    packed = kept(cells, "once").mapInArrow(pack, StructType([*shown, StructField("features", VectorUDT())]))
    return packed if several is None else packed.unionByName(slow(several))


def balanced_weights(matrix: DataFrame, df: DataFrame) -> DataFrame:
    """``matrix`` with the class weights of its rows ``df``."""
    from msgsieve.operators.rollups import class_balance
    return matrix.join(F.broadcast(class_balance(df).select("label", "weight")), "label")


def train_classifier(df: DataFrame, structural: list[str] | None = None, reg: float = 1e-4, max_iter: int = 100) -> TextModel:
    """Class-balanced logistic model of (id, text, label, structural columns), calibrated when there is enough data."""
    structural = structural or []
    # Joins that lead to the messages run once; the counts of all terms are many times the texts and are made anew for each use.
    path = f"{checkpoint_dir(df.sparkSession)}/training-{uuid.uuid4().hex}"
    df = written(df.select("id", "text", "label", *structural), f"{path}/rows")
    documents = df.count()
    vocabulary = cut_lineage(vocabulary_of(df, documents))
    # The regression keeps its own blocks of rows, so the vectors are not kept besides.
    matrix = balanced_weights(encoded(df, vocabulary, structural, path), df)
    fitted = LogisticRegression(weightCol="weight", elasticNetParam=0.0, regParam=reg, maxIter=max_iter, standardization=False).fit(matrix)
    base = WORD_TERMS + CHAR_TERMS
    coef = fitted.coefficients.toArray()
    weights = df.sparkSession.createDataFrame(pd.DataFrame({"idx": np.arange(base), "weight": coef[:base]}))
    terms = cut_lineage(vocabulary.join(F.broadcast(weights), "idx").select("kind", "term", F.col("idx").cast("int").alias("idx"), "idf", "weight"))
    model = TextModel(terms, tuple(structural), tuple(float(v) for v in coef[base:]), float(fitted.intercept))
    seen = fitted.transform(matrix).select("label", F.get(vector_to_array("rawPrediction"), 1).alias("margin"))
    out = _calibrated(model, seen) if documents >= MIN_CALIBRATION_ROWS else model
    discard(df.sparkSession, path)
    return out


def margins(model: TextModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``margin``: a message's terms are looked up and summed where it lies; rows of repeated ids meet over a shuffle."""
    table = Lookup.of(model.terms, model.kinds)
    once, several = (None, df) if table is None else by_repetition(df)
    linear = sum((F.col(c).cast("double") * w for c, w in zip(model.structural, model.structural_weights)), F.lit(model.intercept))
    found = []
    if once is not None:
        @F.pandas_udf("double")
        def looked_up(*words: pd.Series) -> pd.Series:
            batch = pa.RecordBatch.from_arrays([pa.array(w, pa.string()) for w in words], list(model_kinds))
            return pd.Series(np.concatenate([np.zeros(0)] + [table.margin({k: part[k] for k in model_kinds}) for part in _slices(batch, model_kinds[0])]))

        model_kinds = [k for k in "wc" if k in model.kinds]
        found.append(once.withColumn("_m", F.when(F.col("id").isNotNull(), looked_up(*[_cut_words(text, k) for k in model_kinds]))))
    if several is not None:
        # Sums a message and kind, so that no term is shuffled.
        cells = weighted_terms(term_counts(several, text, model.kinds), model.terms.select("kind", "term", "idf", "weight"))
        x = cells.groupBy("id", "kind").agg((F.sum(F.col("x") * F.col("weight")) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("_k"))
        found.append(several.join(x.groupBy("id").agg(F.sum("_k").alias("_m")), "id", "left").select(*several.columns, "_m"))
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out.select(*df.columns, (F.coalesce("_m", F.lit(0.0)) + linear).alias("margin"))


def platt_fit(rows: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of ``label`` over ``margin``, by Newton's method.

    A round is one aggregate of six sums.  Steps are shortened so that no
    probability leaps from one end to the other; on separable rows the curve
    gets steeper until the sums no longer say anything.
    """
    a = b = 0.0
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("margin") * a + b)))
        m, gap, w = F.col("margin"), F.col("label") - p, p * (1 - p)
        s = rows.agg(F.sum(gap * m).alias("ga"), F.sum(gap).alias("gb"), F.sum(w * m * m).alias("haa"), F.sum(w * m).alias("hab"), F.sum(w).alias("hbb"),
                     F.sqrt(F.avg(m * m)).alias("spread")).first()
        det = s.haa * s.hbb - s.hab * s.hab
        if det <= 1e-12 * max(s.haa * s.hbb, 1e-300):
            # All margins alike: only the shift can be learned.
            if s.hbb < 1e-9 or abs(s.gb / s.hbb) < 1e-10:
                break
            da, db = 0.0, s.gb / s.hbb
        else:
            da, db = (s.hbb * s.ga - s.hab * s.gb) / det, (s.haa * s.gb - s.hab * s.ga) / det
        short = min(1.0, 4.0 / max(abs(da) * s.spread, abs(db), 1e-300))
        a, b = a + short * da, b + short * db
        if max(abs(da) * s.spread, abs(db)) < 1e-10:
            break
    return a, b


def calibrate(model: TextModel, df: DataFrame) -> TextModel:
    """Platt scaling: a logistic curve over the margins; with one class only the model stays as it is."""
    return _calibrated(model, margins(model, df))


def _calibrated(model: TextModel, rows: DataFrame) -> TextModel:
    m = rows.select(F.col("label").cast("double").alias("label"), "margin").where("label is not null").persist()
    if m.select("label").distinct().count() < 2:
        return model
    a, b = platt_fit(m)
    m.unpersist()
    return replace(model, platt_a=a, platt_b=b, calibrated=True)


def score_messages(model: TextModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pred`` and ``conf`` (probability of the predicted class); empty text gives (0, 0)."""
    scored = margins(model, df, text)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("margin") * model.platt_a + model.platt_b)))
    empty = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    out = scored.withColumn("p_threat", F.when(empty, 0.0).otherwise(p))
    pred = (~empty & (F.col("p_threat") >= THRESHOLD)).cast("int")
    return out.withColumns({"pred": pred, "conf": F.when(empty, 0.0).when(pred == 1, F.col("p_threat")).otherwise(1 - F.col("p_threat"))})


def top_terms(model: TextModel, df: DataFrame, k: int = 8, text: str = "text") -> DataFrame:
    """The ``k`` word terms that pull hardest per message, with weight and contribution."""
    table = Lookup.of(model.terms, "w")
    once, several = (None, df) if table is None else by_repetition(df)
    found = []
    if once is not None and "w" in table.kinds:
        names, _, _, weights = table.kinds["w"]
        place_of = np.argsort(sorted(range(len(names)), key=[t.encode() for t in names.to_pylist()].__getitem__))

        def leading(batches):
            for batch in batches:
                for part in _slices(batch, "words"):
                    row, place, x = table.cells(part["words"], "w")
                    c = x / np.sqrt(np.bincount(row, x * x, part.num_rows))[row] * weights[place]
                    order = np.lexsort((place_of[place], -np.abs(c), row))
                    row, place, c = row[order], place[order], c[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                    row, place, c, rank = (v[rank <= k] for v in (row, place, c, rank))
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(row)), names.take(pa.array(place)), pa.array(weights[place]), pa.array(c), pa.array(rank, pa.int32())], ["id", "feature", "weight", "contribution", "rank"])

        id_type = df.schema["id"].dataType.simpleString()
        found.append(once.select("id", _cut_words(text, "w").alias("words")).mapInArrow(leading, f"id {id_type}, feature string, weight double, contribution double, rank int").withColumn("weight", F.round("weight", 4)))
    if several is not None or not found:
        x = tfidf_rows(term_counts(df if several is None else several, text, "w"), model.terms)
        c = x.select("id", F.col("term").alias("feature"), F.round("weight", 4).alias("weight"), (F.col("x") * F.col("weight")).alias("contribution"))
        found.append(top_per_key(c, ["id"], [F.desc(F.abs("contribution")), F.asc("feature")], k))
    top = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return top.withColumn("contribution", F.round("contribution", 4))


def weight_deltas(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest weight changes between two term tables (term, weight)."""
    j = before.select("term", F.col("weight").alias("before")).join(after.select("term", F.col("weight").alias("after")), "term")
    d = j.withColumn("delta", F.col("after") - F.col("before")).filter(F.abs("delta") > 1e-12)
    top = d.orderBy(F.desc(F.abs("delta")), F.asc("term")).limit(k)
    return top.select(F.col("term").alias("feature"), *[F.round(c, 5).alias(c) for c in ("before", "after", "delta")])


def incremental_update(model: TextModel, graded: DataFrame, rate: float = 0.05) -> TextModel:
    """One gradient step from a small batch of human labels (id, text, label, structural columns).

    The changed term table is cut off from its history so that repeated steps
    do not grow the plan.
    """
    table = Lookup.of(model.terms, model.kinds)
    scored = margins(model, graded)
    gap = F.col("label") - F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    err = scored.select("id", gap.alias("gap"), "text", *model.structural)
    once, several = (None, graded) if table is None else by_repetition(graded)
    steps = []
    if once is not None:
        kinds = [k for k in "wc" if k in table.kinds]

        def pull(batches):
            sums = {k: np.zeros(len(table.kinds[k][0])) for k in kinds}
            for batch in batches:
                for part in _slices(batch, kinds[0]):
                    gaps = part["gap"].to_numpy(zero_copy_only=False)
                    for kind in kinds:
                        row, place, x = table.cells(part[kind], kind)
                        x = x / np.sqrt(np.bincount(row, x * x, part.num_rows))[row]
                        sums[kind] += np.bincount(place, x * gaps[row], len(sums[kind]))
            for kind in kinds:
                used = np.flatnonzero(sums[kind])
                yield pa.RecordBatch.from_arrays([pa.array(table.kinds[kind][1][used], pa.int32()), pa.array(sums[kind][used])], ["idx", "_d"])

        alone = margins(model, once).select(gap.alias("gap"), "id", "text").where("gap is not null and id is not null")
        if kinds:
            steps.append(alone.select("gap", *[_cut_words("text", k).alias(k) for k in kinds]).mapInArrow(pull, "idx int, _d double"))
    if several is not None:
        x = tfidf_rows(term_counts(several, kinds=model.kinds), model.terms.select("kind", "term", "idx", "idf")).select("id", F.col("idx").cast("int").alias("idx"), "x")
        steps.append(x.join(err.select("id", "gap"), "id").select("idx", (F.col("x") * F.col("gap")).alias("_d")))
    step = steps[0] if steps else graded.sparkSession.createDataFrame([], "idx int, _d double")
    for other in steps[1:]:
        step = step.unionByName(other)
    step = step.groupBy("idx").agg((F.sum("_d") * rate).alias("_d"))
    terms = model.terms.join(step, "idx", "left").withColumn("weight", F.col("weight") + F.coalesce("_d", F.lit(0.0))).drop("_d")
    sums = err.agg((F.sum("gap") * rate).alias("b"), *[(F.sum(F.col("gap") * F.col(c).cast("double")) * rate).alias(f"s{i}") for i, c in enumerate(model.structural)]).first()
    new = tuple(w + (sums[f"s{i}"] or 0.0) for i, w in enumerate(model.structural_weights))
    return replace(model, terms=cut_lineage(terms), structural_weights=new, intercept=model.intercept + (sums["b"] or 0.0))
