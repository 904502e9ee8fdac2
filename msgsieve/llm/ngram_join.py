"""Jaccard self-join of documents on word n-gram sets, and the groups it links.

1. Sets: documents with equal sets are one class; classes are compared, never
   copies.
2. Order: rare first.  Document frequencies come from a count sketch of fixed
   size over all documents (``SKETCH_BITS``); ties are ordered by the n-gram's
   hash.  Any fixed order gives the same links; the sketch only decides how
   many candidates there are.
3. Prefixes: a class sends its ``n - ceil(t n) + 1`` rarest n-grams.  Classes
   that share one are candidates, cut by length and position.
4. Verification: a suffix filter (sizes of hash ranges), then the exact
   overlap, once per pair.
5. Groups: first every class meets two hubs of each prefix n-gram it shares.
   Then every candidate pair whose components still differ is tried, so no
   link between groups is lost, and none inside a group is needed.  A list of
   near copies thus costs about its length, not its square.  Near copies that
   stay under the threshold would leave many pairs: for the classes of lists of
   ``CROWDED`` entries or more, a parity sketch of each set, which bounds the
   difference of two sets from below, drops almost all of these pairs before
   any text is fetched.

N-grams and sets are 64-bit hashes: among 10**9 classes, about 0.03 pairs of
different sets would be taken for equal.

Defined cases: words are runs of characters other than ASCII white space, A-Z
folded.  A text of fewer than ``size`` words has its whole sequence as one
n-gram.  Null, empty and blank texts have none and are alone.  Repeated rows
are rows of their own in one class.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, cut_lineage, scratch, tidy
from msgsieve.llm.components import components
from msgsieve.llm.hash_filter import HashFilter, build_filter
from msgsieve.llm.words import shingle_sets, text_chunks, word_hashes, word_spans

SKETCH_BITS = 20
SKETCH_PART = 4096
CROWDED = 32
FEW = 20_000  # pairs between components that are tried at once
LISTED = 100 * FEW  # entries of crowded lists that may pair, whose pairs are listed to be counted
TURNS = 3  # of nearest partners, before every pair that is left


def ngram_sets(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    for _, _, data, offs in text_chunks(batch, column):
        start, end, first = word_spans(data, offs)
        for runs in shingle_sets(word_hashes(data, start, end, fold=True), first, size):
            yield np.unique(runs)


def marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mark", F.xxhash64("doc_id", "text"))


def set_class(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def least_overlap(n: np.ndarray | int, percent: int):
    """ceil(n * percent / 100)"""
    return -(-n * percent // 100)


def overlap_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Upper bound of the overlap of two sorted sets: the suffix filter, by halves."""
    if not len(a) or not len(b):
        return 0
    if depth == 0:
        return min(len(a), len(b))
    middle = b[len(b) // 2]
    i = int(np.searchsorted(a, middle))
    j = len(b) // 2
    return overlap_bound(a[:i], b[:j], depth - 1) + overlap_bound(a[i:], b[j:], depth - 1)


def parity_bits(grams: np.ndarray, percent: int) -> np.ndarray:
    """Parities of hash cells as int64 words: two sets differ in at least as many n-grams as their parities differ in bits.

    A power of two of cells, about sixteen times the difference that a linked pair
    may have; halves folded onto each other give the parities of fewer cells.
    """
    allowed = 2 * len(grams) * (100 - percent) // (100 + percent)
    width = max(64, 1 << int(16 * allowed).bit_length())
    cells = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")


def _parities(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """cls, bits of every class in ``texts``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parity_bits(grams, percent) for grams in ngram_sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tolist() for b in bits], pa.list_(pa.int64()))], ["cls", "bits"])

    return cut_lineage(texts.select("cls", "text").mapInArrow(tidy(scan), "cls long, bits array<long>"))


def _difference(a: str, b: str) -> Column:
    """Parities in which two sets differ, null without them.  The longer array is folded onto the shorter one's length."""
    bits_a, bits_b = F.col(f"bits_{a}"), F.col(f"bits_{b}")

    def folded(long: Column, short: Column) -> Column:
        return F.when(F.size(long) == F.size(short), long).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(short)), lambda i: F.aggregate(
                F.sequence(F.lit(0), (F.size(long) / F.size(short)).cast("int") - 1), F.lit(0).cast("long"),
                lambda x, k: x.bitwiseXOR(F.element_at(long, i + k * F.size(short))))))

    def gap(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)

    return F.when(F.size(bits_a) >= F.size(bits_b), gap(folded(bits_a, bits_b), bits_b)).otherwise(gap(bits_a, folded(bits_b, bits_a)))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Parity filter: the sets do not differ in too many n-grams."""
    return F.coalesce(_difference(a, b) * (100 + percent) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (100 - percent), F.lit(True))


def _classes_and_sketch(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        names = ["doc_id", "mark", "n", "cls", "part", "counts"]
        for batch in batches:
            ids, sizes, classes = batch.column("doc_id"), [], []
            for grams in ngram_sets(batch, size):
                cls = set_class(grams) if len(grams) else None
                sizes.append(len(grams))
                classes.append(cls)
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    # The grams of a text differ, but two may share a counter.
                    np.add.at(counts, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([ids, batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        pieces = [counts[i:i + SKETCH_PART].astype("<u8").tobytes() for i in range(0, len(counts), SKETCH_PART)]
        k = len(pieces)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.array(range(k), pa.int32()), pa.array(pieces, pa.binary())], names)

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_PART, np.uint64)
        for piece in rows["counts"]:
            total += np.frombuffer(piece, "<u8")
        return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})

    spark = docs.sparkSession
    path = scratch(spark, "ngram-classes")
    docs.mapInArrow(tidy(scan), "doc_id long, mark long, n long, cls long, part int, counts binary").withColumn("task", F.pmod(F.spark_partition_id(), F.lit(1024))).write.parquet(path)
    found = spark.read.parquet(path)
    pieces = found.where("part is not null").select("part", "task", "counts")
    some = pieces.groupBy("part", "task").applyInPandas(add, "part int, counts binary")
    rows = some.groupBy("part").applyInPandas(add, "part int, counts binary").collect()  # 2 ** SKETCH_BITS counters
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    for row in rows:
        sketch[row["part"] * SKETCH_PART:(row["part"] + 1) * SKETCH_PART] = np.frombuffer(row["counts"], "<u8")
    return found.where("part is null").select("doc_id", "mark", "n", "cls"), sketch


def _prefixes(docs: DataFrame, size: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """gram, cls, n, pos: the rare-first prefix of every class with a possible partner of another set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            grams_out, cls_out, n_out, pos_out = [], [], [], []
            for grams in ngram_sets(batch, size):
                n = len(grams)
                # The closest other set has one n-gram more.
                if not n or n * 100 < percent * (n + 1):
                    continue
                cls = set_class(grams)
                if cls in seen:
                    continue
                seen.add(cls)
                p = n - least_overlap(n, percent) + 1
                weight = counts[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if p < n:
                    near = np.flatnonzero(weight <= np.partition(weight, p - 1)[p - 1])
                    order = near[np.lexsort((grams[near], weight[near]))][:p]
                else:
                    order = np.lexsort((grams, weight))[:p]
                grams_out.append(grams[order].view(np.int64))
                cls_out.append(np.full(len(order), cls, np.int64))
                n_out.append(np.full(len(order), n, np.int32))
                pos_out.append(np.arange(len(order), dtype=np.int32))
            if grams_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams_out, cls_out, n_out, pos_out)], ["gram", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(tidy(scan), "gram long, cls long, n int, pos int")


def _texts(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, text: a text of every class in ``wanted`` (cls).

    A bit set of the wanted ids keeps the other texts out of the shuffle.
    """
    speakers = cut_lineage(members.join(wanted, "cls").groupBy("cls").agg(F.min("mark").alias("mark")))
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(speakers, "mark").bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = HashFilter(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64))))

    some = docs.select("text", "mark").mapInArrow(tidy(keep), "text string, mark long")
    path = scratch(docs.sparkSession, "ngram-texts")
    some.join(speakers, "mark").select("cls", "text").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; a checkpoint) whose sets link."""
    texts = _texts(docs, members, pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
    full = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(ngram_sets(batch, size, "text_a"), ngram_sets(batch, size, "text_b")):
                # 100 * overlap >= percent * (len(x) + len(y) - overlap)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                keep.append(overlap_bound(x, y) >= need and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(full.select("a", "b", "text_a", "text_b").mapInArrow(tidy(test), "a long, b long"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Length and position filter for two entries of one list."""
    bound = F.least(F.col(f"n_{a}") - F.col(f"pos_{a}"), F.col(f"n_{b}") - F.col(f"pos_{b}"))
    small, large = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")
    return (small * 100 >= large * percent) & (bound * (100 + percent) >= (small + large) * percent)


def _between(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The entries of lists that hold several components, with comp, the largest one of the list (major) and the length of the list."""
    known = lists.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    major = known.groupBy("gram", "comp").count().groupBy("gram").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("major"), F.sum("count").alias("length"))
    return cut_lineage(known.join(major.where("comps > 1"), "gram"))


def _at_stake(rows: DataFrame) -> int:
    """Pairs between components that crowded lists hold, at most."""
    crowded = rows.where((F.col("length") >= CROWDED) & (F.col("comp") != F.col("major")))
    return crowded.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def grouped_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, mark, n, comp for every row; rows without words have no comp.  ``mark`` names a row by id and text."""
    docs = marked(as_columns(docs, doc_id="long", text="string"))
    members, sketch = _classes_and_sketch(docs, size)
    prefixes = _prefixes(docs, size, percent, sketch)
    shared = prefixes.groupBy("gram").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first <> last")
    lists = cut_lineage(prefixes.join(shared, "gram").dropDuplicates(["gram", "cls"]))
    side = lambda df, s, *more: df.select("gram", *more, *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", *(x for x in ("comp", "bits") if x in df.columns))])
    pair = F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")
    # Two hubs for each shared n-gram, then whatever pairs still lie between components.
    hubs = side(lists.where("cls = first or cls = last"), "b")
    tried = side(lists, "a").join(hubs, "gram").where(F.expr("cls_a <> cls_b") & _possible("a", "b", percent)).select(*pair).distinct()
    tried = cut_lineage(tried)
    links = _verified(tried, docs, members, size, percent)
    comps = components(links)
    rows = _between(lists, comps)
    crowded = rows.where(F.col("length") >= CROWDED).select("cls").distinct()
    bits = _parities(_texts(docs, members, crowded), size, percent)
    def apart(rows: DataFrame) -> DataFrame:
        """The pairs that still lie between components."""
        rows = rows.join(bits, "cls", "left")
        between = F.expr("comp_a <> comp_b and (comp_b = major or cls_a < cls_b)")
        pairs = side(rows.where("comp <> major"), "a").join(side(rows, "b", "major"), "gram").where(between & _possible("a", "b", percent) & _may_link("a", "b", percent)).select(*pair).distinct()
        return cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))

    # Near copies of which a part links would leave a share of all their pairs: the nearest partner of each first, as long as that helps.
    left, pairs = _at_stake(rows), None
    for _ in range(TURNS):
        pairs = apart(rows) if left <= LISTED else None
        if pairs is not None and pairs.count() <= FEW:
            break
        some = rows.where(F.col("length") >= CROWDED).join(bits, "cls", "left")
        near = side(some.where("comp <> major"), "a").join(side(some, "b"), "gram").where(F.expr("comp_a <> comp_b") & _possible("a", "b", percent) & _may_link("a", "b", percent))
        near = near.groupBy("cls_a").agg(F.min_by("cls_b", F.struct(_difference("a", "b"), "cls_b")).alias("cls_b"))
        pairs, nearest = None, near.select(*pair).distinct()
        nearest = cut_lineage(nearest.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(nearest)
        links = links.unionByName(_verified(nearest, docs, members, size, percent))
        comps = components(links)
        rows = _between(lists, comps)
        before, left = left, _at_stake(rows)
        if left * 4 > before * 3:
            break
    more = _verified(apart(rows) if pairs is None else pairs, docs, members, size, percent)
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    comps = comps.withColumnRenamed("node", "cls")
    return members.join(comps, "cls", "left").select("doc_id", "mark", "n", F.coalesce("comp", "cls").alias("comp"))


def ngram_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: groups linked by a Jaccard similarity of ``percent`` or more.

    ``component_id`` is the smallest doc_id that links reach from the row.
    """
    rows = grouped_rows(docs, size, percent)
    lowest = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("comp is not null").join(lowest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("comp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the one with the smallest id.

    Rows repeated with one id and text are one document.  Documents without
    words stay; of those without an id, one stays only if its group has no id.
    """
    rows = grouped_rows(docs, size, percent)
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("row")).select("row.mark")
    kept = first.unionByName(rows.where("comp is null").select("mark")).distinct().withColumnRenamed("mark", "_mark")
    named = docs.withColumn("_mark", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return named.join(kept, "_mark", "left_semi").dropDuplicates(["_mark"]).select(*docs.columns)
