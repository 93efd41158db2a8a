"""Words and their hashes, whole Arrow batches at a time (numpy on the raw UTF-8 bytes).

All word patterns used here are made of single bytes below 0x80, so working on
bytes is exact: every byte of a non-ASCII character counts as part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: ``[^\x20\x09-\x0D]+`` and, once A-Z is lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_CLASSES = {"space": _SPACE, "alnum": _ALNUM}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LENGTH = _rng.integers(0, 2**64, 1, dtype=np.uint64)[0] | np.uint64(1)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_STEP = 1 << 20
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """B**i and B**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            both = []
            for base in (_BASE, inverse):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.up, self.down = both
        return self.up, self.down


_POWERS = _Powers()


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One chunk, nulls as empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls (no copy)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and at[-1] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    text = strings(batch.column(col))
    at = raw(text)[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words of a string array: ``start``/``end`` (byte places), ``first`` (word offsets by row)."""

    def __init__(self, col: pa.Array, words: str = "space", lower: bool = False) -> None:
        data, at = raw(strings(col))
        self.data, self.at = (LOWER[data] if lower else data), at
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(at), np.int64)
            return
        inside = WORD_CLASSES[words][self.data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
        edge[at] = True
        self.start = np.flatnonzero(inside & edge[:-1])
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.start, at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.start), np.uint64)
        cuts = [0]
        while cuts[-1] < len(out):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.start, self.start[cuts[-1]] + _STEP))))
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, e = self.start[a:b], self.end[a:b]
            base = s[0]
            part = self.data[base : e[-1]]
            up, down = _POWERS.get(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            out[a:b] = mix((total[e - base] - total[s - base]) * down[s - base] + (e - s).astype(np.uint64) * _LENGTH)
        return out

    def grams(self, word_hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``k`` consecutive words of one row, and their offsets by row."""
        n = len(word_hashes)
        counts = np.maximum(self.counts - (k - 1), 0)
        first = np.concatenate(([0], np.cumsum(counts)))
        if n < k or not first[-1]:
            return np.zeros(0, np.uint64), first
        keep = np.ones(n, bool)
        lo, hi = self.first[:-1], self.first[1:]
        for j in range(1, k):
            drop = hi - j
            keep[drop[drop >= lo]] = False
        return mix(runs(word_hashes, k)[keep[: n - k + 1]] + np.uint64(k)), first

    def whole(self, word_hashes: np.ndarray, row: int) -> int:
        """A hash of all words of a row (for rows shorter than a gram)."""
        w = word_hashes[self.first[row] : self.first[row + 1]]
        return int(mix(runs(w, len(w)) + np.uint64(len(w)))[0])


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A polynomial of every ``k`` consecutive hashes, modulo 2**64; the cost does not depend on ``k``."""
    out = np.empty(len(hashes) - k + 1, np.uint64)
    for a in range(0, len(out), _STEP):
        h = hashes[a : a + _STEP + k - 1]
        n = len(h)
        up, down = _POWERS.get(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        out[a : a + _STEP] = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
    return out
