"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Index.  Documents come in batches.  Each batch gets a suffix array: of every
window of ``length`` bytes it holds the suffix that starts at the window's
local minimum (by hash of ``SEED`` bytes), sorted by its first 8 bytes, then
that hash.  Two equal windows hold the same suffix at the same place.  A new
batch is merge-scanned against every level that exists; suffixes that agree
in their first ``SEED`` bytes are reported.  Two levels of equal size merge
into one of twice the size before the next batch comes, so the number of
levels grows with the logarithm of the number of batches.

Long matches.  A window can repeat only if its local minimum was reported.
Runs of such windows that share a minimum travel with their bytes to the task
of that minimum, which compares all windows.  Minima that occur in very many
places send single windows instead, counted by an aggregate with map-side
combine.  Runs that repeat within a task, and such single windows within a
block of texts, are settled there and sent once.  Reported minima are a bit set of bounded size; what it
lets through by chance fails the comparison.

Windows are compared by 64-bit hashes within the task of their minimum: a
wrong match has a chance below 10**-9 in a million windows.

Defined cases: texts are UTF-8 bytes, null is empty; texts shorter than
``length`` lose nothing.  A removed run may cut a character, so ``kept`` is
binary.  Rows that repeat are documents of their own and match each other.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, discard, scratch
from msgsieve.llm.hash_filter import HashFilter, build_filter, pieces_of, split_by
from msgsieve.llm.substring_dedup import local_minima, rolling, window_starts
from msgsieve.llm.words import byte_sums, run_hashes, text_chunks

SEED = 64
BLOCK = 1 << 19
HELD_BYTES = 8 << 20
HOT_LEAST, HOT_MOST_KEYS = 30_000, 1_000_000  # so many runs of one minimum are about 17 MB of text and 40 MB of hashes


def _minima(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(running sums, hash of the seed at each byte, places of the local minima, windows that stay in a text)."""
    sums = byte_sums(data)
    seeds = run_hashes(sums, np.arange(max(0, len(data) - SEED + 1)), SEED)
    starts = window_starts(offs, len(data), length)
    return sums, seeds, local_minima(seeds, starts, length - SEED + 1), starts


def _with_row(docs: DataFrame) -> DataFrame:
    """``row`` names a row by its id and text."""
    docs = as_columns(docs, doc_id="long", text="string")
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def suffixes(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """batch, head, seed, row, pos: the suffixes that the arrays hold."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.column("row").to_numpy(zero_copy_only=False)
            for at, _, data, offs in text_chunks(part, limit=BLOCK):
                _, seeds, places, _ = _minima(data, offs, length)
                if len(places):
                    head = np.zeros(len(places), np.uint64)
                    for i in range(8):
                        head = head << np.uint64(8) | data[places + i].astype(np.uint64)
                    owner = np.searchsorted(offs, places, side="right") - 1
                    row = rows[at + owner]
                    yield pa.RecordBatch.from_arrays([pa.array((row % batches).astype(np.int32)), pa.array((head ^ np.uint64(1 << 63)).view(np.int64)), pa.array(seeds[places].view(np.int64)),
                                                      pa.array(row), pa.array((places - offs[owner]).astype(np.int32))], ["batch", "head", "seed", "row", "pos"])

    return _with_row(docs).select("row", "text").mapInArrow(scan, "batch int, head long, seed long, row long, pos int")


class SuffixLevels:
    """The index family: levels of sorted suffixes in the shared folder, smallest last."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []
        self.matches: list[str] = []

    def _keep(self, rows: DataFrame, name: str) -> str:
        path = scratch(self.spark, name)
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def _array(self, rows: DataFrame) -> str:
        return self._keep(rows.select("head", "seed", "row", "pos").repartition("head", "seed", "row").sortWithinPartitions("head", "seed", "row", "pos"), "suffix-level")

    def add(self, batch: DataFrame) -> None:
        """Index a batch; record the seeds that it shares with itself or with a level.

        Levels of equal size merge when the next batch comes, so the last one costs no merge.
        """
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._array(self.spark.read.parquet(a, b))))
            discard(self.spark, a, b)
        fresh = self._array(batch)
        keys = self.spark.read.parquet(fresh).groupBy("head", "seed").agg(F.count(F.lit(1)).alias("n"))
        found = keys.where("n > 1").select("seed")
        for _, path in self.levels:
            level = self.spark.read.parquet(path).select("head", "seed").distinct()
            found = found.unionByName(keys.join(level, ["head", "seed"]).select("seed"))
        self.matches.append(self._keep(found.distinct(), "suffix-matches"))
        self.levels.append((1, fresh))

    def repeated(self) -> DataFrame:
        """seed: every seed that occurs in two places or more."""
        return self.spark.read.parquet(*self.matches).distinct()

    def frequent(self) -> list[int]:
        """Seeds in very many places; at most ``HOT_MOST_KEYS`` of them."""
        all_rows = self.spark.read.parquet(*[path for _, path in self.levels])
        limit = max(HOT_LEAST, all_rows.count() // HOT_MOST_KEYS)
        return [r[0] for r in all_rows.groupBy("seed").count().where(F.col("count") > limit).select("seed").collect()]


def build_levels(docs: DataFrame, length: int, batches: int) -> SuffixLevels:
    spark = docs.sparkSession
    path = scratch(spark, "suffixes")
    suffixes(docs, length, batches).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    rows = spark.read.schema("head long, seed long, row long, pos int, batch int").parquet(path)
    family = SuffixLevels(spark)
    for batch in range(batches):
        family.add(rows.where(F.col("batch") == batch))
    discard(spark, path)  # the levels hold all suffixes
    return family


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last entries of runs of consecutive ``at`` with one owner."""
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1


def _repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value occurs more than once, the first place of each value)."""
    _, first, back, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return count[back] > 1, first


RECORD = "kind int, row long, low int, high int, hash long, twice boolean, bytes binary"
NAMES = ["kind", "row", "low", "high", "hash", "twice", "bytes"]
SETTLED, RUN, WINDOW = 0, 1, 2


def _record(kind: int, row, low, high, hashes, twice, held) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(row), pa.array(np.asarray(low, np.int32)), pa.array(np.asarray(high, np.int32)),
                                       pa.nulls(n, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)), pa.nulls(n, pa.bool_()) if twice is None else pa.array(twice),
                                       pa.nulls(n, pa.binary()) if held is None else pa.array(held, pa.binary())], names=NAMES)


def _scan(repeated: HashFilter, hot: np.ndarray, length: int):
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, int] | None] = {}  # a run's hash -> its first place in this task, until that is settled
        for part in parts:
            rows = part.column("row").to_numpy(zero_copy_only=False)
            for first_row, _, data, offs in text_chunks(part, limit=BLOCK):
                sums, seeds, places, starts = _minima(data, offs, length)
                if not len(places):
                    continue
                low = rolling(seeds, length - SEED + 1, np.minimum)
                at = np.flatnonzero(starts[:len(low)])
                at = at[repeated(low[at])]
                if not len(at):
                    continue
                # The leftmost minimum of each window.
                values, rank = np.unique(seeds[places], return_inverse=True)
                table = np.sort(rank * np.int64(len(data)) + places)
                owner = table[np.searchsorted(table, np.searchsorted(values, low[at]) * np.int64(len(data)) + at)] % len(data)
                begin, stop = _runs(owner, at)
                text = np.searchsorted(offs, at[begin], side="right") - 1
                row, base, seed = rows[first_row + text], offs[text], low[at[begin]]
                a, b = at[begin], at[stop]
                warm = np.isin(seed.view(np.int64), hot)
                cold = np.flatnonzero(~warm)
                if len(cold):
                    send, done = [], []
                    for i, h in zip(cold.tolist(), run_hashes(sums, a[cold], b[cold] - a[cold] + length).tolist()):
                        place = (int(row[i]), int(a[i] - base[i]), int(b[i] - base[i]))
                        if h not in seen:
                            seen[h] = place
                            send.append(i)
                        else:
                            done.append(place)
                            if seen[h]:
                                done.append(seen[h])
                                seen[h] = None
                    if done:
                        yield _record(SETTLED, *map(np.array, zip(*done)), None, None, None)
                    if send:
                        yield _record(RUN, row[send], a[send] - base[send], b[send] - base[send], seed[send], None, [data[x:y + length].tobytes() for x, y in zip(a[send].tolist(), b[send].tolist())])
                if warm.any():
                    pick = np.repeat(warm, stop - begin + 1)
                    which = np.repeat(np.arange(len(begin)), stop - begin + 1)[pick]
                    place = at[pick]
                    hashes = run_hashes(sums, place, length)
                    twice, lead = _repeats(hashes)
                    pos = place - base[which]
                    if twice.any():
                        x, y = _runs(which[twice], place[twice])
                        yield _record(SETTLED, row[which[twice][x]], pos[twice][x], pos[twice][y], None, None, None)
                    yield _record(WINDOW, row[which[lead]], pos[lead], pos[lead], hashes[lead], twice[lead], None)

    return scan


def _compare(length: int):
    """Windows that repeat among runs of bytes, all runs of one minimum together."""
    def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, run, place in the run) of every window, hashed block by block."""
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]).astype(np.int64)
        found, at = [], 0
        while at < len(column):
            end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:at + 4096]), BLOCK, side="right")))
            offs = np.concatenate(([0], np.cumsum(lengths[at:end])))
            data = np.frombuffer(b"".join(column.slice(at, end - at).to_pylist()), np.uint8)
            start = np.flatnonzero(window_starts(offs, len(data), length))
            run = np.searchsorted(offs, start, side="right") - 1
            found.append((run_hashes(byte_sums(data), start, length), (run + at).astype(np.int32), (start - offs[run]).astype(np.int32)))
            at = end
        return tuple(map(np.concatenate, zip(*found)))

    def settle(held: pa.Table) -> pa.RecordBatch:
        held = held.combine_chunks()
        hashes, run, place = windows(held.column("bytes").chunk(0))
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        again = np.zeros(len(hashes), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if not again.any():
            return _record(SETTLED, np.zeros(0, np.int64), [], [], None, None, None)
        x, y = _runs(run[again], place[again])
        which = run[again][x]
        low = held.column("low").to_numpy()[which]
        return _record(SETTLED, held.column("row").to_numpy()[which], low + place[again][x], low + place[again][y], None, None, None)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                piece = part.slice(at, 2000)
                held.append(piece)
                size += piece.nbytes
                if size > HELD_BYTES:
                    table = pa.Table.from_batches(held)
                    keys = table.column("hash").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))  # the last minimum may go on
                    if cut:
                        yield settle(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        size = sum(x.nbytes for x in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return compare


def repeated_runs(docs: DataFrame, length: int = 400, batches: int = 4) -> DataFrame:
    """row, low, high: ranges of starts of windows of ``length`` bytes that also start elsewhere."""
    spark = docs.sparkSession
    family = build_levels(docs, length, batches)
    bits = spark.sparkContext.broadcast(build_filter(family.repeated(), "seed").bits)
    hot = spark.sparkContext.broadcast(np.array(family.frequent(), np.int64))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(HashFilter(bits.value), hot.value, length)(parts)

    path = scratch(spark, "suffix-runs")
    _with_row(docs).select("row", "text").mapInArrow(scan, RECORD).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    settled = found.where(F.col("kind") == SETTLED).select("row", "low", "high")
    runs = found.where(F.col("kind") == RUN).select("hash", "row", "low", "bytes").repartition("hash").sortWithinPartitions("hash").mapInArrow(_compare(length), RECORD).select("row", "low", "high")
    windows = found.where(F.col("kind") == WINDOW)
    shared = windows.groupBy("hash").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("hash")
    single = windows.join(shared, "hash").select("row", "low", "high")
    return settled.unionByName(runs).unionByName(single)


def drop_repeated_bytes(docs: DataFrame, length: int = 400, batches: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256: each text without the bytes of strings that also start elsewhere."""
    path = scratch(docs.sparkSession, "byte-cuts")
    repeated_runs(docs, length, batches).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("cuts")).write.parquet(path)
    cuts = docs.sparkSession.read.parquet(path)

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = piece.column("cuts") if "cuts" in piece.schema.names else [None] * piece.num_rows
        out = []
        for text, cuts in zip(piece.column("text").to_pylist(), found):
            kept = data = (text or "").encode()
            removed = spans = 0
            if cuts is not None and cuts.is_valid:
                low = cuts.values.field("low").to_numpy(zero_copy_only=False)
                high = cuts.values.field("high").to_numpy(zero_copy_only=False)
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, low, 1)
                np.add.at(cover, high + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    def cut_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from map(cut, pieces_of(part))

    # Only texts that may lose bytes are shuffled.
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    some, others = split_by(_with_row(docs), cuts, "row", cut, schema)
    return some.join(cuts, "row", "left").select("doc_id", "text", "cuts").mapInArrow(cut_all, schema).unionByName(others)
