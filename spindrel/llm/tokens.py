"""Words and word n-grams of whole Arrow batches, as numpy arrays.

A word is a run of letters, digits and non-ASCII bytes, in lower case. Every
hash is a function of the bytes alone, so that any process, on any machine and
in any retry, gives the same one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = np.zeros(256, dtype=bool)
WORD[128:] = True
for _range in ("09", "AZ", "az"):
    WORD[ord(_range[0]) : ord(_range[1]) + 1] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PIECE = 1 << 18
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64, for exponents below n."""
    up, down = _tables.get(base, (np.ones(1, np.uint64),) * 2)
    if len(up) < n:
        n = max(n, _PIECE + 4096)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 4 * _PIECE:
            _tables[base] = up, down
    return up, down


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * _BASE + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of values[start:end] for ascending starts; pieces keep the tables small."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(starts, lo + _PIECE)))
        hi = int(ends[a:b].max())
        up, down = _powers(base, hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[lo:hi].astype(np.uint64) * up[: hi - lo], out=total[1:])
        out[a:b] = (total[ends[a:b] - lo] - total[starts[a:b] - lo]) * down[starts[a:b] - lo]
        a = b
    return out


class Words:
    """The words of a column of texts: start, end (byte offsets in data), hash, doc (row),
    and first, where the words of row r are first[r]:first[r+1]."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())
        n = len(low)
        _, offsets, data = low.buffers()
        self.offsets = np.frombuffer(offsets, np.int64, n + 1, low.offset * 8) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        is_word = WORD[self.data]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        opens, closes = is_word.copy(), is_word.copy()
        opens[1:] &= ~is_word[:-1]
        opens[cut] = is_word[cut]
        closes[:-1] &= ~is_word[1:]
        closes[cut - 1] = is_word[cut - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        inside = (self.start >= self.offsets[0]) & (self.start < self.offsets[-1])
        self.start, self.end = self.start[inside], self.end[inside]
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = mix(spans_hash(self.data, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words inside one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return at, mix(spans_hash(self.hash, at, at + n, 0xD6E8FEB86659FD93), seed + n)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about `most` bytes of text, so that scratch arrays stay small."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        before = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats np.unique's hash table on large arrays."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
