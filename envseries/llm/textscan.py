"""Vectorised scan of Arrow string columns: words, their hashes and shingles, over whole texts.

Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; UTF-8 makes byte-wise
splitting exact.  Work goes through slices of about half a MB, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_POSITIONS = 32
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(
    0, 2**64, size=_POSITIONS * 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null counts as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


class Words:
    """Word spans of one slice: ``starts``, ``ends`` (byte positions), ``doc`` (row in the slice), ``first`` (first
    word of each row, length rows + 1)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.low = LOWER[raw]
        inside = ~SPACE[raw] if inside is None else inside
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.low, self.starts, self.ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (none of them empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = (ends - starts).astype(np.int32)
    cum = np.zeros(len(lens), np.int32)
    np.cumsum(lens[:-1], out=cum[1:])
    total = int(cum[-1]) + int(lens[-1])
    pos = np.arange(total, dtype=np.int32)
    byte = data[pos + np.repeat(starts.astype(np.int32) - cum, lens)]
    pos -= np.repeat(cum, lens)
    h = _TABLE[((pos & (_POSITIONS - 1)) << 8) | byte]
    if int(lens.max()) > _POSITIONS:
        h *= ((pos >> 4) | 1).astype(np.uint64)  # an odd factor for each further stretch of positions
    return mix64(np.add.reduceat(h, cum) + lens.astype(np.uint64) * _STEP)


def ngram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (ignores row bounds; callers drop what crosses them)."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(word) - n + 1, np.uint64)
    for j in range(n):
        out = mix64(out * _STEP + word[j:len(word) - n + 1 + j] + np.uint64(j + 1))
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(values)
    keep = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-word shingle hashes; fewer words make one shingle, no words none."""
    word = words.hashes()
    grams = ngram_hashes(word, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield distinct(grams[a:b - n + 1])
        elif b > a:
            yield ngram_hashes(word[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
