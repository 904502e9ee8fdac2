"""Benchmark passages inside documents: SimHash windows, multi-index look-up, exact check.

For each item size (in words) the windows of that size of every document get a
64-bit SimHash of their word shingles.  Fingerprints are cut into
``radius + 1`` bit blocks; two within ``radius`` agree in one block at least,
so looking up every block finds all of them.  Each pair found is checked by
its exact weighted Jaccard similarity (shingles weigh their counts).

Windows that cannot reach the similarity are left out before they are hashed:
a window needs ``2 t m / (1 + t)`` of its m shingles among those of some item.

The benchmark is dealt into blocks of about ``block_bytes`` of text; each
block goes to the executors and meets every document.  Documents are never
shuffled.

Defined cases: words are runs of characters other than ASCII white space, A-Z
folded.  An item of fewer than ``size`` words has its whole sequence as one
shingle and its windows too.  Null, empty and blank items match nothing.
Items with equal texts are all reported.  A document that meets an item in
several places is reported once, with the most similar, then first, window.
Rows repeated with one doc_id are one document then.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, tidy
from msgsieve.llm.words import sequence_hashes, text_chunks, word_hashes, word_spans

BLOCK_BYTES = 4 << 20
RADIUS = 20
BITS = 64


def simhash(hashes: np.ndarray, runs: int, width: int) -> np.ndarray:
    """SimHash of the ``width`` hashes from each of the first ``runs`` places; each hash counts as often as it occurs."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[width:width + runs] - sums[:runs]
    return np.packbits(ones * 2 > width, axis=1).view(np.uint64).ravel()


def bit_blocks(prints: np.ndarray, radius: int) -> np.ndarray:
    """The value of each of ``radius + 1`` bit blocks of each fingerprint."""
    edges = np.linspace(0, BITS, radius + 2).astype(int)
    return np.stack([(prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:])], axis=1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, p = np.unique(a, return_counts=True)
    y, q = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(p[i], q[j]).sum())
    return both / (len(a) + len(b) - both)


class ItemIndex:
    """Items of one size: shingles, fingerprints and the multi-index over their bit blocks."""

    def __init__(self, words: int, size: int, similarity: float, radius: int):
        self.words, self.size, self.radius = words, min(size, words), radius
        self.width = words - self.size + 1
        self.need = int(np.ceil(2 * similarity * self.width / (1 + similarity) - 1e-9))
        self.items: list[int] = []
        self.shingles: list[np.ndarray] = []

    def close(self) -> ItemIndex:
        prints = np.concatenate([simhash(s, 1, self.width) for s in self.shingles])
        self.prints = prints
        self.known = np.unique(np.concatenate(self.shingles))
        self.tables = [defaultdict(list) for _ in range(self.radius + 1)]
        for item, values in enumerate(bit_blocks(prints, self.radius).tolist()):
            for table, value in zip(self.tables, values):
                table[value].append(item)
        return self

    def pairs(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius."""
        for window, values in enumerate(bit_blocks(prints, self.radius).tolist()):
            found = sorted({item for table, value in zip(self.tables, values) for item in table.get(value, ())})
            if found:
                far = np.bitwise_count(self.prints[found] ^ prints[window])
                yield from ((window, item) for item, d in zip(found, far.tolist()) if d <= self.radius)


def build_index(items: list[tuple[int, str]], size: int, similarity: float, radius: int) -> list[ItemIndex]:
    by_words: dict[int, ItemIndex] = {}
    for item_id, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, _ = word_spans(data, np.array([0, len(data)]))
        if len(start):
            words = word_hashes(data, start, end, fold=True)
            index = by_words.setdefault(len(words), ItemIndex(len(words), size, similarity, radius))
            index.items.append(item_id)
            index.shingles.append(sequence_hashes(words, index.size))
    return [by_words[n].close() for n in sorted(by_words)]


def find_items(words: np.ndarray, indexes: list[ItemIndex], similarity: float) -> dict[int, tuple[float, int]]:
    """item_id -> (similarity, first word) of its best window in a document."""
    best: dict[int, tuple[float, int]] = {}
    runs: dict[int, np.ndarray] = {}
    for index in indexes:
        if len(words) < index.words:
            continue
        if index.size not in runs:
            runs[index.size] = sequence_hashes(words, index.size)
        hashes = runs[index.size]
        member = np.concatenate(([0], np.cumsum(np.isin(hashes, index.known))))
        windows = len(words) - index.words + 1
        at = np.flatnonzero(member[index.width:index.width + windows] - member[:windows] >= index.need)
        if not len(at):
            continue
        lo, hi = int(at[0]), int(at[-1])
        prints = simhash(hashes[lo:hi + index.width], hi - lo + 1, index.width)[at - lo]
        for window, item in index.pairs(prints):
            first = int(at[window])
            got = weighted_jaccard(hashes[first:first + index.width], index.shingles[item])
            if got >= similarity and (got, -first) > (best.get(index.items[item], (0.0, 0))[0], -best.get(index.items[item], (0.0, 0))[1]):
                best[index.items[item]] = (got, first)
    return best


class Matcher:
    """Finds the items of one benchmark block in Arrow batches of texts."""

    def __init__(self, items: list[tuple[int, str]], size: int, similarity: float, radius: int):
        self.similarity, self.indexes = similarity, build_index(items, size, similarity, radius)
        sizes = {i.size for i in self.indexes}
        self.known = {k: np.unique(np.concatenate([i.known for i in self.indexes if i.size == k])) for k in sizes}
        self.least = {k: min(i.need for i in self.indexes if i.size == k) for k in sizes}
        self.seen = {k: np.zeros(1 << 20, bool) for k in sizes}
        for k in sizes:
            self.seen[k][(self.known[k] >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, batch: pa.RecordBatch) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
        """(row, its items) of the rows that hold some."""
        for at, _, data, offs in text_chunks(batch):
            start, end, first = word_spans(data, offs)
            words = word_hashes(data, start, end, fold=True)
            some = np.zeros(len(offs) - 1, bool)
            for k, known in self.known.items():
                hashes = sequence_hashes(words, k)
                maybe = np.flatnonzero(self.seen[k][(hashes >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[np.isin(hashes[maybe], known)]
                some |= np.bincount(np.searchsorted(first, maybe, side="right") - 1, minlength=len(some))[:len(some)] >= self.least[k]
            for doc in np.flatnonzero(some).tolist():
                hits = find_items(words[first[doc]:first[doc + 1]], self.indexes, self.similarity)
                if hits:
                    yield at + doc, hits


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_bytes`` of text."""
    items = as_columns(benchmark, item_id="long", text="string").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = int(total // block_bytes + 1)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).collect()]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = RADIUS,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word: every document that holds a passage like a benchmark item."""
    spark = docs.sparkSession
    docs = as_columns(docs, doc_id="long", text="string")
    schema = "doc_id long, item_id long, similarity double, first_word long"
    found = spark.createDataFrame([], schema)
    for items in _item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = Matcher(shared.value, size, similarity, radius)
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [(ids[row].as_py(), item, got, place) for row, hits in match(batch) for item, (got, place) in sorted(hits.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "first_word"])

        found = found.unionByName(docs.mapInArrow(tidy(scan), schema))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).alias("first_word"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = RADIUS,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns as they are."""
    for items in _item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = Matcher(shared.value, size, similarity, radius)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in match(batch)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(scan), docs.schema)
    return docs


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_ids, similarity: one row per document that holds a benchmark passage."""
    found = benchmark_matches(docs, benchmark, **options)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
