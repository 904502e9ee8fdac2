"""Token ids in directly addressable codes.

File format.  A store is a Parquet folder of shards in document order; a shard
row holds whole documents:

* part, shard: order; n_tokens; doc_ids, doc_tokens: the documents and their lengths
* codes: the ids.  Level by level, little-endian: ids are split into chunks of
  8 bits.  Level 0 has the low chunk of every id; its bitmap marks ids with
  more chunks, which follow in level 1, and so on.  A rank directory holds the
  number of marks before every 512th id.  An id is found with one rank look-up
  per level and no decoding of neighbours (``token_at``).

Layout of codes: number of levels (uint32), then per level its length
(uint64), directory (uint64 each), bitmap padded to bytes, chunks.

Texts are encoded by the tokenizers library.  Its splitter cuts a text into
pieces that are encoded on their own, so each distinct piece is encoded once
per Python worker while it stays in a bounded cache.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, tidy

STEP = 512
SHARD_TOKENS = 1 << 18
CACHED_PIECES = 400_000
# The normaliser and splitter whose cuts are made here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# Characters of blocks that every Unicode version cuts and lower-cases alike, and what lower case makes of them.
SAFE = re.compile("[\x00-\u012f\u0131-\u024f\u0300-\u036f\u1e00-\u1eff\u2010-\u2027\u2030-\u205e]*")
LETTERS, NUMBERS, BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af\u1e00-\u1eff\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANK}{LETTERS}{NUMBERS}]+")
SHARD = "part int, shard long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, codes binary"
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_codes(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & np.uint32(0xFF)).astype(np.uint8)
        counts = np.concatenate(([0], np.cumsum(more, dtype=np.uint64)))[::STEP].astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + counts.tobytes() + np.packbits(more, bitorder="little").tobytes() + chunks.tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return struct.pack("<I", len(levels)) + b"".join(levels)


def open_codes(codes: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(directory, bitmap, chunks) of each level, as views of the bytes."""
    (count,), at, levels = struct.unpack_from("<I", codes), 4, []
    for _ in range(count):
        (n,) = struct.unpack_from("<Q", codes, at)
        directory = np.frombuffer(codes, "<u8", n // STEP + 1, at + 8)
        at += 8 + directory.nbytes
        bitmap = np.frombuffer(codes, np.uint8, (n + 7) // 8, at)
        at += bitmap.nbytes
        levels.append((directory, bitmap, np.frombuffer(codes, np.uint8, n, at)))
        at += n
    return levels


def token_at(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], index: int) -> int:
    """One id by its index, without decoding others."""
    value = 0
    for depth, (directory, bitmap, chunks) in enumerate(levels):
        value |= int(chunks[index]) << (8 * depth)
        byte, bit = index >> 3, index & 7
        if not bitmap[byte] >> bit & 1:
            return value
        block = index // STEP
        before = POPCOUNT[bitmap[block * STEP // 8:byte]].sum() + POPCOUNT[bitmap[byte] & ((1 << bit) - 1)]
        index = int(directory[block]) + int(before)
    raise ValueError("the last level marks no id")


def unpack_codes(codes: bytes) -> np.ndarray:
    """All ids of a shard."""
    levels = open_codes(codes)
    ids = np.zeros(0, np.uint32)
    for _, bitmap, chunks in reversed(levels):
        up = chunks.astype(np.uint32)
        if len(ids):
            up[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= ids << np.uint32(8)
        ids = up
    return ids


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` entries, at least doubled when it grows."""
    return values if size <= len(values) else np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)))


class PieceIds(dict):
    """piece -> number of its row in (values, first); every piece is encoded once while it is remembered.

    Texts of ``SAFE`` characters are cut into pieces here, by the tokenizer's
    own pattern.  New pieces are encoded many in one call and told apart by the
    ids that end a piece.  Other texts, and tokenizers of another form, are
    encoded whole by the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        suffix, vocabulary = form["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.special = [x["content"] for x in form["added_tokens"]]
        self.cuts = bool(suffix) and form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == SPLITTER
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.new: list[str] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.values, self.first, self.held = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 1

    def __missing__(self, piece: str) -> int:
        self[piece] = row = len(self)
        self.new.append(piece)
        return row

    def learn(self) -> None:
        for at in range(0, len(self.new), 4000):
            some = self.new[at:at + 4000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                coded = [x.ids for x in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                ids, ends = np.fromiter(chain.from_iterable(coded), np.uint32), np.cumsum([len(x) for x in coded])
            start = int(self.first[self.held - 1])
            self.values, self.first = _room(self.values, start + len(ids)), _room(self.first, self.held + len(some))
            self.values[start:start + len(ids)] = ids
            self.first[self.held:self.held + len(some)] = start + ends
            self.held += len(some)
        self.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > CACHED_PIECES:
            self.forget()
        rows: list[np.ndarray | None] = []
        for text in texts:
            text = unicodedata.normalize("NFC", text)
            if self.cuts and SAFE.fullmatch(text) and not any(x in text for x in self.special):
                rows.append(np.array(list(map(self.__getitem__, PIECES.findall(text.lower()))), np.int64))
            else:
                rows.append(None)
        self.learn()
        out = []
        for text, own in zip(texts, rows):
            if own is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            begin = self.first[own]
            sizes = self.first[own + 1] - begin
            ends = np.cumsum(sizes)
            out.append(self.values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)])
        return out


@lru_cache(1)
def piece_ids(path: str) -> PieceIds:
    """One cache for all tasks of a Python worker."""
    return PieceIds(path)


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2) -> None:
    """Write the ids of ``docs`` (doc_id, text), in ascending order of doc_id, each followed by ``end_id``.

    A null text is empty; rows without an id come first; rows that repeat an
    id are ordered by a hash of the text.  Other columns are ignored.
    """
    rows = as_columns(docs, doc_id="long", text="string")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, held, sizes, ids, number, part = piece_ids(tokenizer_path), [], [], [], 0, 0

        def out():
            flat = np.concatenate(ids)
            return pd.DataFrame({"part": [part], "shard": [number], "n_tokens": [len(flat)], "doc_ids": [held], "doc_tokens": [sizes], "codes": [pack_codes(flat)]})

        for batch in batches:
            for at in range(0, len(batch), 64):
                piece = batch.iloc[at:at + 64]
                part = int(piece["part"].iloc[0])
                for doc, own in zip(piece["doc_id"].astype(object), pieces.encode(list(piece["text"]))):
                    held.append(None if pd.isna(doc) else int(doc))
                    sizes.append(len(own) + 1)
                    ids += [own, np.array([end_id], np.uint32)]
                if sum(sizes) >= SHARD_TOKENS:
                    yield out()
                    held, sizes, ids, number = [], [], [], number + 1
        if held:
            yield out()

    rows.select("part", "doc_id", "text").mapInPandas(tidy(shards), SHARD).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a store, decoded from its files.

    ``start`` counts the ids of all documents before it.  The table of shard
    lengths that is joined holds one row per written partition and shard.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = shards.select("part", "shard", "n_tokens")
    parts = lengths.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    starts = lengths.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("ahead") + F.col("inside")).alias("start"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = unpack_codes(row.codes).astype("<u4")
                ends = np.cumsum(np.asarray(row.doc_tokens, np.int64))
                starts = np.concatenate(([0], ends[:-1]))
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame({"part": row.part, "shard": row.shard, "doc_id": pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], "Int64"), "inside": starts,
                                    "n_tokens": ends - starts, "ids_crc32": sums})

    docs = shards.select("part", "shard", "doc_ids", "doc_tokens", "codes").mapInPandas(
        tidy(documents), "part int, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
