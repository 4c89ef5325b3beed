"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on *concatenated* UTF-8 bytes of many documents at once: a
document is a slice ``data[offsets[i]:offsets[i + 1]]``.  No value ever crosses a
document boundary.  Hashes are 64-bit, seeded by fixed constants, and equal for
equal bytes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words for `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows by doubling and is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words with good avalanche."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive 64-bit symbols (len(symbols) - n + 1 of them, or none)."""
    if len(symbols) < n:
        return np.zeros(0, dtype=U64)
    total = np.zeros(len(symbols) + 1, dtype=U64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=total[1:])
    runs = total[n:] - total[:-n]
    runs *= powers(INVERSE, len(runs))
    return mix(runs)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenates arange(s, s + n) for each pair."""
    length = length.astype(np.int64)
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(start.astype(np.int64) - (ends - length), length)


class Words:
    """Words of a batch: first byte, past-the-last byte, hash; words of document i are bounds[i]:bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        n = len(data)
        solid = np.zeros(n + 1, dtype=bool)
        np.logical_not(SPACE[data], out=solid[:n])
        first = np.zeros(n, dtype=bool)
        if n:
            first[0] = solid[0]
            first[1:] = solid[1:n] & ~solid[: n - 1]
            cuts = offsets[:-1][offsets[:-1] < n]
            first[cuts] |= solid[cuts]
        last = np.zeros(n, dtype=bool)
        if n:
            last[:] = solid[:n] & ~solid[1:]
            cuts = offsets[1:][offsets[1:] > 0] - 1
            last[cuts] |= solid[cuts]
        self.start = np.flatnonzero(first)
        self.stop = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        if hashed:
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum(_BYTE[data] * powers(BASE, n), out=total[1:])
            run = total[self.stop] - total[self.start]
            run *= powers(INVERSE, n + 1)[self.start]
            run += (self.stop - self.start).astype(U64) * U64(0xD6E8FEB86659FD93)
            self.hash = mix(run)


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n symbols stays inside its document."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    return ragged(bounds[:-1], counts)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for each i with a full window."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches with a `text` column into slices of about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        low, base = 0, 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(low, high - low)
            base, low = int(ends[high - 1]), high


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column without copying where it is possible; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.string(), pa.utf8()):
        column = column.cast(pa.large_string())
    elif column.type == pa.binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true flags, cut at document bounds, as starts and stops."""
    n = len(flags)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds[:-1][bounds[:-1] <= n]] = True
    before = np.concatenate(([False], flags[:-1]))
    after = np.concatenate((flags[1:], [False]))
    return np.flatnonzero(flags & (~before | cut[:n])), np.flatnonzero(flags & (~after | cut[1:])) + 1


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks each of n places that lies in start .. start + length - 1 of any start."""
    steps = np.zeros(n + 1, dtype=np.int32)
    steps += np.bincount(starts, minlength=n + 1).astype(np.int32)
    steps -= np.bincount(np.minimum(starts + length, n), minlength=n + 1).astype(np.int32)
    return np.cumsum(steps)[:n] > 0
