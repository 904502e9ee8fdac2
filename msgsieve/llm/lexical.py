"""Ranked lexical search: presence masks of the query's terms, evaluated best first.

1. One scan of the corpus keeps, per document, its number of terms and the
   counts of those terms that some item asks for (a bit set of bounded size
   lets few others through).  Document frequencies are counted over all of it.
2. Search: documents come in blocks.  Per item, the bitmap of each of its
   terms over the block is OR-ed into one bit lane, so every document has the
   mask of the terms it holds; documents of one mask are one group.  A mask's
   maximum is the sum of its terms' largest contributions in the block.  Masks
   are evaluated by descending maximum, and the search of a block ends once the
   maximum lies below the item's k-th score so far; an equal one still counts,
   as a smaller id wins a tie.
3. Each task sends its k best documents of each item; the best of these remain.

Items are searched ``ITEM_TERMS`` terms at a time, so what is broadcast has a
fixed bound; each such block of items reads the kept counts once more, not the
texts.  Terms are 64-bit hashes.

Defined cases: null, empty and term-free texts have no score and do not count
as documents; null items and items without terms give no rows.  Every row of
the benchmark is an item of its own, and every row of documents a document of
its own, also with a repeated id; among equal scores a null doc_id comes last.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, scratch
from msgsieve.llm.hash_filter import HashFilter, build_filter
from msgsieve.llm.words import PUNCTUATION, text_chunks, word_hashes, word_spans

ITEM_TERMS = 1 << 20
BLOCK = 2048
NO_ID = np.iinfo(np.int64).max


class Items(NamedTuple):
    """Items of one search: ``terms[first[i]:first[i + 1]]`` index the sorted ``vocabulary``."""
    vocabulary: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    documents: int
    length: int


def term_counts(batch: pa.RecordBatch, wanted: HashFilter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of terms, sorted distinct term hashes, their counts) of each text; only wanted ones are listed."""
    for _, _, data, offs in text_chunks(batch):
        start, end, first = word_spans(data, offs, PUNCTUATION)
        hashes = word_hashes(data, start, end, fold=True)
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if wanted is not None and len(hashes):
            hit = wanted(hashes)
            hashes, owner = hashes[hit], owner[hit]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.concatenate((at, [len(hashes)])))
        bounds = np.searchsorted(owner[at], np.arange(len(sizes) + 1))
        for n, a, b in zip(sizes.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            yield n, hashes[at[a:b]], counts[a:b]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def counted_terms(rows: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """key, n, terms, counts of every row with a term; ``wanted`` are the bits of a filter."""
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if shared is None else HashFilter(shared.value)
        for batch in batches:
            found = list(term_counts(batch, keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), _lists([h.view(np.int64) for _, h, _ in found], pa.int64()),
                                              _lists([c for _, _, c in found], pa.int64())], [key, "n", "terms", "counts"]).filter(pa.array([n > 0 for n, _, _ in found], pa.bool_()))

    return as_columns(rows, **{key: "long", "text": "string"}).mapInArrow(scan, f"{key} long, n long, terms array<long>, counts array<long>")


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def _masks(items: Items, i: int, bounds: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms of the item that occur in the block, presence lanes: one uint64 column for 64 terms)."""
    terms = items.terms[items.first[i]:items.first[i + 1]]
    terms = terms[bounds[terms] < bounds[terms + 1]]
    lanes = np.zeros((size, max(1, -(-len(terms) // 64))), np.uint64)
    for j, t in enumerate(terms.tolist()):
        lanes[docs[bounds[t]:bounds[t + 1]], j // 64] |= np.uint64(1 << (j % 64))
    return terms, lanes


class Best:
    """The k best (score, id) of one item, best first."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document must reach; only scores above 0 count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.concatenate((self.scores, scores[good])), np.concatenate((self.ids, ids[good]))
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_block(items: Items, best: list[Best], ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> None:
    """Offer the documents of one block to every item."""
    known = np.searchsorted(items.vocabulary, terms)
    known[known == len(items.vocabulary)] = 0
    real = items.vocabulary[known] == terms
    known, counts, owner = known[real], counts[real], owner[real]
    if not len(known):
        return
    order = np.argsort(known, kind="stable")
    known, counts, docs = known[order], counts[order], owner[order]
    # Python integers: 90 * n * documents may pass 64 bits.
    norm = np.array([10 + 90 * n * items.documents // items.length for n in sizes.tolist()], np.int64)
    share = 1_000_000_000 * counts // (1000 * counts + 8 * norm[docs]) * items.weights[known]
    bounds = np.searchsorted(known, np.arange(len(items.vocabulary) + 1))
    most = np.zeros(len(items.vocabulary), np.int64)
    held = np.flatnonzero(bounds[:-1] < bounds[1:])
    most[held] = np.maximum.reduceat(share, bounds[held])
    reach = np.add.reduceat(np.append(most[items.terms], 0), items.first[:-1]) if len(items.terms) else np.zeros(0, np.int64)
    for i in np.flatnonzero(reach >= [b.least for b in best]).tolist():
        own, lanes = _masks(items, i, bounds, docs, len(ids))
        masks, group = np.unique(lanes, axis=0, return_inverse=True) if lanes.shape[1] > 1 else np.unique(lanes[:, 0], return_inverse=True)
        masks, group = masks.reshape(len(masks), -1), group.reshape(-1)
        bits = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little", count=len(own))
        maximum = bits @ most[own]
        ranked = np.argsort(-maximum, kind="stable")
        place = np.empty(len(ranked), np.int64)
        place[ranked] = np.arange(len(ranked))
        turn = place[group]
        by_turn = np.argsort(turn, kind="stable")
        first = np.searchsorted(turn[by_turn], np.arange(len(ranked) + 1))
        done, step = 0, 8
        while done < len(ranked) and maximum[ranked[done]] >= best[i].least:
            # Every mask of this turn could still reach the k-th score.
            last = min(done + step, len(ranked))
            last = done + int(np.searchsorted(-maximum[ranked[done:last]], -best[i].least, side="right"))
            chosen = np.sort(by_turn[first[done]:first[last]])
            scores = np.zeros(len(chosen), np.int64)
            for t in own.tolist():
                a, b = bounds[t], bounds[t + 1]
                where = np.searchsorted(docs[a:b], chosen)
                where[where == b - a] = 0
                scores += np.where(docs[a:b][where] == chosen, share[a:b][where], 0)
            best[i].add(scores, ids[chosen])
            done, step = last, step * 4


def _best_of_tasks(postings: DataFrame, items: Items, k: int) -> DataFrame:
    """item, score, doc_id: the k best documents of every task for every item."""
    shared = postings.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(k) for _ in range(len(items.first) - 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids = piece.column(0).fill_null(NO_ID).to_numpy()
                terms, counts = piece.column(2), piece.column(3)
                owner = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy(zero_copy_only=False))
                search_block(items, best, ids, piece.column(1).to_numpy(), terms.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy(), owner)
        found = [(np.full(len(b.ids), i), b.scores, b.ids) for i, b in enumerate(best) if len(b.ids)]
        if found:
            item, scores, ids = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(scores), pa.array(ids, mask=ids == NO_ID)], ["item", "score", "doc_id"])

    return postings.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, score long, doc_id long")


def _pack(rows: list, frequencies: dict[int, int], documents: int, length: int) -> Items:
    terms = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(terms))
    weights = np.array([term_weight(documents, frequencies.get(t, 0)) for t in vocabulary.view(np.int64).tolist()], np.int64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    return Items(vocabulary, weights, first, np.searchsorted(vocabulary, np.concatenate(terms)), documents, length)


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item; ``item_terms`` bounds what is broadcast at once."""
    spark = docs.sparkSession
    path, items_path = scratch(spark, "lexical-counts"), scratch(spark, "lexical-items")
    counted_terms(benchmark, "item_id").select("item_id", "terms", F.size("terms").alias("width"), F.monotonically_increasing_id().alias("row")).write.parquet(items_path)
    items = spark.read.parquet(items_path)
    asked = items.select(F.explode("terms").alias("term")).distinct()
    counted_terms(docs, "doc_id", build_filter(asked, "term").bits).write.parquet(path)
    postings = spark.read.parquet(path)
    documents, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    total, widest = items.agg(F.sum("width"), F.max("width")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not documents or not total:
        return empty
    frequencies = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    freq_path = scratch(spark, "lexical-frequencies")
    frequencies.join(asked, "term", "left_semi").write.parquet(freq_path)
    frequencies = spark.read.parquet(freq_path)
    blocks, found = -(-total // item_terms), None
    numbered = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    for block in range(blocks):
        here = numbered.where(F.col("block") == block)
        rows = here.orderBy("row").collect()  # about ``item_terms`` terms
        if not rows:
            continue
        known = frequencies.join(here.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        packed = _pack(rows, {r["term"]: r["df"] for r in known.collect()}, documents, length)
        names = spark.createDataFrame([(i, r["row"], r["item_id"]) for i, r in enumerate(rows)], "item int, row long, item_id long")
        some = _best_of_tasks(postings, packed, k).join(names, "item")
        found = some if found is None else found.unionByName(some)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
