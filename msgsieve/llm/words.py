"""Words and word hashes of Arrow text batches, vectorised over whole batches.

A word is a run of bytes other than space and \\t-\\r.  The hash of a word is a
polynomial over random 64-bit codes of its bytes, finished by a mixer; hashes
of word sequences are built from word hashes.  All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2 ** 64))
SEQ = np.uint64(0xD1342543DE82EF95)
UNSEQ = np.uint64(pow(int(SEQ), -1, 2 ** 64))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PUNCTUATION = np.ones(256, bool)  # ASCII other than letters and digits
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about ``limit`` bytes; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(offs, np.int64 if col.type == pa.large_string() else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and the index of each text's first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inner = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    begin = inner.copy()
    begin[1:] &= ~inner[:-1] | cut[1:-1]
    stop = inner.copy()
    stop[:-1] &= ~inner[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    codes = CODES[FOLD][data] if fold else CODES[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(data)), out=sums[1:])
    return mix64((sums[end] - sums[start]) * powers(UNBASE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, over text borders too; the caller drops those."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(SEQ, len(words)), out=sums[1:])
    return mix64((sums[size:] - sums[:n]) * powers(UNSEQ, n) + np.uint64(size))


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Hashes of the word runs of each text, in order, with repeats.

    A text of fewer words has its whole sequence as one; without words none.
    """
    runs = sequence_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield runs[a:b - size + 1]
        elif b > a:
            yield sequence_hashes(words[a:b], b - a)
        else:
            yield words[:0]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any run of bytes is taken."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of the byte runs that begin at ``start``."""
    raw = (sums[start + length] - sums[start]) * powers(UNBASE, len(sums))[start]
    return mix64(raw + np.asarray(length, np.int64).astype(np.uint64))
