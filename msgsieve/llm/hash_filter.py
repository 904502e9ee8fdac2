"""A bit set of bounded size over 64-bit hashes, built on the executors.

It holds every hash it was given and some others; what it lets through is
checked exactly afterwards, so its size decides only how much that is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_EACH = 64
MAX_BYTES = 64 << 20
PART = 1 << 14


class HashFilter:
    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8 - 1).bit_length())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def build_filter(hashes: DataFrame, column: str, max_bytes: int = MAX_BYTES) -> HashFilter:
    """The filter over a long column: 64 bits a row, ``max_bytes`` at most (the driver and each executor hold as much)."""
    rows = max(1, hashes.count())
    size = min(max_bytes, 1 << max(14, (rows * BITS_EACH // 8 - 1).bit_length()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = HashFilter(np.zeros(size, np.uint8))
        for batch in batches:
            at = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> out.shift).astype(np.int64)
            np.bitwise_or.at(out.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = [(i // PART, out.bits[i:i + PART]) for i in range(0, size, PART)]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["part", "bits"])

    def join(key, found: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.uint8)
        for piece in found["bits"]:
            total[:len(piece)] |= np.frombuffer(piece, np.uint8)
        return pd.DataFrame({"part": [key[0]], "bits": [total.tobytes()]})

    pieces = hashes.select(column).mapInArrow(scan, "part int, bits binary").withColumn("task", F.pmod(F.spark_partition_id(), F.lit(1024)))
    some = pieces.groupBy("part", "task").applyInPandas(join, "part int, bits binary")
    bits = np.zeros(size, np.uint8)
    for row in some.groupBy("part").applyInPandas(join, "part int, bits binary").collect():  # size bytes
        at = row["part"] * PART
        bits[at:at + PART] = np.frombuffer(row["bits"], np.uint8)[:size - at]
    return HashFilter(bits)


def split_by(docs: DataFrame, hashes: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be among ``hashes``, ``work`` applied to the others), both hashes of ``column`` as long.

    The others are filtered and worked on in one Python worker.
    """
    bits = docs.sparkSession.sparkContext.broadcast(build_filter(hashes, column).bits)

    def hit(batch: pa.RecordBatch) -> np.ndarray:
        return HashFilter(bits.value)(batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).view(np.uint64))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hit(batch)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                yield work(piece.filter(pa.array(~hit(piece))))

    return docs.mapInArrow(some, docs.schema), docs.mapInArrow(others, schema)


def pieces_of(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that Python objects of few rows exist at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
