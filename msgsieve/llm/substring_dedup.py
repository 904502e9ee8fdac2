"""Repeated word windows, found level by level: only windows repeated at one length are extended to twice that length.

Level 1 looks at windows of half the final length.  Of those it counts the
local minima by hash: every final window holds one of them at the same place
in all its copies, so a final window can repeat only if its local minimum
does.  Level 2 extends those to the final length and marks each window whose
sequence starts earlier elsewhere.  The levels end there: a longer repeat
covers no word that its final windows leave.  ``longest_repeats`` goes on
doubling until no candidates survive.

* Level-1 counts are aggregated with a map-side combine.  The repeated ones
  become a bit set of bounded size (``hash_filter``); what it lets through by
  chance is dropped by level 2's exact grouping.
* Windows repeated inside one block of texts are settled there; a block sends
  each distinct window once, however often it occurs.
* Texts that may lose words are shuffled once, to meet the positions; the
  others are not.

Windows are compared by 64-bit hashes: among 10**9 distinct candidate windows
about 0.03 pairs would be taken for equal.

Defined cases: words are runs of characters other than ASCII white space,
compared as they are.  Null, empty and short texts have no windows and keep
all their words.  Rows without an id come before all others.  Rows that repeat
an id are one document: none of its rows is earlier than another, and all
lose the same word positions.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, scratch
from msgsieve.llm.hash_filter import HashFilter, build_filter, pieces_of, split_by
from msgsieve.llm.words import sequence_hashes, text_chunks, word_hashes, word_spans

NO_ID = -(1 << 63)
BLOCK = 1 << 20
TOP = np.uint64(2 ** 64 - 1)


def rolling(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:len(out) - step], out[step:])
        done += step
    return out


def local_minima(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hashes of each run of ``width``; ``starts`` marks the runs that count."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = rolling(hashes, width, np.minimum)
    low = np.where(starts[:len(low)], low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    high = rolling(np.concatenate((pad, low, pad)), width, np.maximum)
    return np.flatnonzero((high == hashes) & (high > 0))


def window_starts(first: np.ndarray, words: int, length: int) -> np.ndarray:
    """Whether a window of ``length`` words that starts at each word stays in its text."""
    ok = np.zeros(words, bool)
    mark = np.zeros(words + 1, np.int32)
    last = first[1:] - length + 1
    full = last > first[:-1]
    np.add.at(mark, first[:-1][full], 1)
    np.add.at(mark, last[full], -1)
    ok[:] = np.cumsum(mark[:-1]) > 0
    return ok


def _halves(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of the level-1 windows, starts of the final windows, level-1 windows in a final one)."""
    return sequence_hashes(words, length // 2), window_starts(first, len(words), length), length - length // 2 + 1


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def repeated_windows(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, pos: every window of ``length`` words (even) whose sequence also starts earlier."""
    spark = docs.sparkSession

    def level_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in text_chunks(batch):
                start, end, first = word_spans(data, offs)
                halves, starts, inside = _halves(word_hashes(data, start, end, fold=False), first, length)
                own, count = np.unique(halves[local_minima(halves, starts, inside)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(count.astype(np.int32))], ["h", "n"])

    path = scratch(spark, "half-windows")
    counted = docs.select("text").mapInArrow(level_1, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    counted.where("n > 1").select("h").write.parquet(path)
    shared = spark.sparkContext.broadcast(build_filter(spark.read.parquet(path), "h").bits)

    def level_2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = HashFilter(shared.value)
        for batch in batches:
            ids = _ids(batch)
            for at, stop, data, offs in text_chunks(batch, limit=BLOCK):
                begin, end, first = word_spans(data, offs)
                words = word_hashes(data, begin, end, fold=False)
                halves, starts, inside = _halves(words, first, length)
                if not starts.any():
                    continue
                where = np.flatnonzero(starts[:len(halves) - inside + 1])
                where = where[repeated(rolling(halves, inside, np.minimum)[where])]
                if not len(where):
                    continue
                h = sequence_hashes(words, length)[where]
                owner = np.searchsorted(first, where, side="right") - 1
                doc, pos = ids[at:stop][owner], where - first[owner]
                order = np.lexsort((pos, doc, h))
                h, doc, pos = h[order], doc[order], pos[order]
                head = np.concatenate(([True], h[1:] != h[:-1]))
                lead = np.flatnonzero(head)[np.cumsum(head) - 1]
                later = (doc != doc[lead]) | (pos != pos[lead])
                keep = head | later
                back = np.lexsort((pos[keep], doc[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep][back]), pa.array(pos[keep][back].astype(np.int32)), pa.array(h[keep][back].view(np.int64), mask=later[keep][back])], ["doc_id", "pos", "h"])

    path = scratch(spark, "windows")
    docs.mapInArrow(level_2, "doc_id long, pos int, h long").write.parquet(path)
    found = spark.read.parquet(path)
    place = F.rank().over(Window.partitionBy("h").orderBy("doc_id", "pos"))
    later = found.where("h is not null").withColumn("place", place).where("place > 1").select("doc_id", "pos")
    return found.where("h is null").select("doc_id", "pos").unionByName(later)


def longest_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, pos, length: windows that occur more than once, at the longest of the doubled lengths at which they do.

    A window of twice a length is looked at only where both its halves repeat;
    the levels end when none is left.  Every level is written to the shared
    folder.
    """
    spark = docs.sparkSession
    docs = as_columns(docs, doc_id="long", text="string")
    held, levels = None, []
    while True:
        met = docs.withColumn("starts", F.lit(None).cast("array<int>")) if held is None else docs.join(held.groupBy("doc_id").agg(F.collect_list("pos").alias("starts")), "doc_id")

        def extend(batches: Iterator[pa.RecordBatch], size=length, first_level=held is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    data = np.frombuffer((batch.column("text")[i].as_py() or "").encode(), np.uint8)
                    start, end, _ = word_spans(data, np.array([0, len(data)]))
                    h = sequence_hashes(word_hashes(data, start, end, fold=False), size)
                    at = np.arange(len(h))
                    if not first_level:
                        known = np.unique(batch.column("starts")[i].values.to_numpy(zero_copy_only=False))
                        at = known[np.isin(known + size // 2, known)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(h[at].view(np.int64))], ["doc_id", "pos", "h"])

        windows = met.select("doc_id", "text", "starts").mapInArrow(extend, "doc_id long, pos int, h long")
        again = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        path = scratch(spark, f"repeats-{length}")
        windows.join(again, "h").select("doc_id", "pos").write.parquet(path)
        held = spark.read.parquet(path)
        if held.isEmpty():
            break
        levels.append(held.withColumn("length", F.lit(length)))
        length *= 2
    found = spark.createDataFrame([], "doc_id long, pos int, length int")
    for level in levels:
        found = found.unionByName(level)
    return found.groupBy("doc_id", "pos").agg(F.max("length").alias("length"))


def drop_repeated_words(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256: each text without the words of windows that also start earlier.

    ``kept`` is the kept words joined by one space.
    """
    docs = as_columns(docs, doc_id="long", text="string")
    docs = docs.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))))
    path = scratch(docs.sparkSession, "cuts")
    repeated_windows(docs.drop("key"), length).groupBy(F.xxhash64("doc_id").alias("key")).agg(F.collect_list("pos").alias("cuts")).write.parquet(path)
    cuts = docs.sparkSession.read.parquet(path)

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = piece.column("cuts") if "cuts" in piece.schema.names else [None] * piece.num_rows
        out = []
        for text, cuts in zip(piece.column("text").to_pylist(), found):
            words = (text or "").encode().split()
            cover = np.zeros(len(words) + 1, np.int32)
            if cuts is not None and cuts.is_valid:
                at = cuts.values.to_numpy(zero_copy_only=False)
                at = at[at < len(words)]
                np.add.at(cover, at, 1)
                np.add.at(cover, np.minimum(at + length, len(words)), -1)
            keep = np.cumsum(cover[:-1]) == 0
            kept = b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()])
            out.append((len(words), int(len(words) - keep.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                                          ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(cut, pieces_of(batch))

    # Only texts that may lose words are shuffled.
    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    some, others = split_by(docs, cuts, "key", cut, schema)
    return some.join(cuts, "key", "left").select("doc_id", "text", "cuts").mapInArrow(cut_all, schema).unionByName(others)
