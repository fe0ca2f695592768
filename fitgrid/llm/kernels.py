"""Vectorised word and hash kernels over Arrow string columns.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]``. All hashes are 64 bits,
the same on every machine and in every process. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call takes (a longer text is a call of its own).
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_K = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES) + 1
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) in runs of about ``size`` bytes."""
    off, data = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows, for kernels that make Python objects of them."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class Words:
    """Words of a run of texts: ``starts``/``ends`` in bytes, ``off`` the words before each text, ``hash``."""

    def __init__(self, off: np.ndarray, data: np.ndarray, lower: bool = False, hashes: bool = True):
        if lower:
            data = LOWER[data]
        self.data = data
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = off[:-1][off[:-1] < off[1:]]
        first[edge] |= inside[edge]
        edge = off[1:][off[:-1] < off[1:]] - 1
        last[edge] |= inside[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.starts, off)
        self.n = np.diff(self.off)
        if hashes:
            if len(self.starts):
                value = data.astype(np.uint64)
                value += np.uint64(1)
                value *= inside
                value *= _power("up", _P, len(data))
                got = np.add.reduceat(value, self.starts) * _power("down", _P_INV, len(data))[self.starts]
                self.hash = mix(got ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(48)))
            else:
                self.hash = np.zeros(0, np.uint64)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjoining windows, from theirs."""
    return mix(left * _K + right)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, level, width = None, 0, h, 1
    while True:
        if k & width:
            out = level if out is None else joined(out[: len(h) - have - width + 1], level[have : len(h) - width + 1])
            have += width
            if have == k:
                return mix(out ^ np.uint64(k))
        level = joined(level[: len(level) - width], level[width:])
        width *= 2


def shingle_sets(col: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word windows; of all its words where it has fewer."""
    for i, j, off, data in chunks(col):
        w = Words(off, data, lower)
        every = windows(w.hash, k)
        for d in range(j - i):
            a, b = w.off[d], w.off[d + 1]
            if b - a >= k:
                yield np.unique(every[a : b - k + 1])
            elif b > a:
                yield windows(w.hash[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
