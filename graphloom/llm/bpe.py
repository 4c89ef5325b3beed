"""Byte-level BPE encoding and decoding by a rank file.

Lookup has two tiers.  A minimal perfect hash (hash and displace, one slot per vocabulary entry) resolves every pre-token
that is in the vocabulary as a whole.  The others are merged with a heap of candidate pairs over a doubly linked list of
their bytes: the pair of least rank merges first, the leftmost of equal rank before the others.

Whole blocks of documents are split into pre-tokens at once, by character class; each distinct pre-token of a block is
resolved once, and a bounded memo in each worker (emptied when full) remembers those of earlier blocks.  Pre-tokens are
told apart by 64-bit hashes of their bytes, so every block is decoded again and compared with its input; should they
differ, the block is encoded anew by its pre-tokens' full bytes.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import shared
from .kernels import BASE, INVERSE, blocks, byte_symbols, flat_text, mix, powers, ragged

#: Characters with Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MEMO = 1_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point by general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[0xD800:0xE000] = OTHER
    out[WHITE] = SPACE
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of many documents, by the rule of

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    Runs of one class are pre-tokens; one blank before a run that isn't white space belongs to it; of white space before
    such a run, all but the last character is a pre-token, and so is that last one if it isn't a blank.  A run that is a
    lone apostrophe, without a blank before it, takes the ending behind it out of the letters that follow.
    """
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, dtype=np.int64)
    lead = (data & 0xC0) != 0x80
    byte_at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    kind = _classes()[points]
    new_doc = np.zeros(n + 1, dtype=bool)
    new_doc[np.searchsorted(byte_at, offsets)] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= new_doc[:n]
    start = change.copy()
    solid = kind != SPACE
    # The last character of white space that a run follows, within the document.
    last_white = np.zeros(n, dtype=bool)
    last_white[:-1] = ~solid[:-1] & solid[1:] & ~new_doc[1:n]
    start |= last_white
    blank = last_white & (points == 32)
    start[1:] &= ~(blank[:-1])
    # Contractions.
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[(mark + 1 < n)]
    mark = mark[change[mark + 1] & (kind[mark + 1] == LETTER) & ~new_doc[mark + 1]]
    if len(mark):
        a = points[mark + 1]
        b = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
        b[(mark + 2 < n) & new_doc[np.minimum(mark + 2, n)]] = 0
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, k in ((one, 1), (two, 2)):
            at = mark[which]
            start[at + 1] = False
            rest = at + 1 + k
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~new_doc[rest]]] = True
    return byte_at[start]


class PerfectHash:
    """Minimal perfect hash of a fixed list of byte strings: n strings take n slots, and a lookup touches one of them.

    Buckets of several keys search a displacement, the largest first; a bucket of one key names its slot outright.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.n_buckets = max(1, (n + 1) // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        self.shift = [0] * self.n_buckets
        self.slots: list[int] = [-1] * n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        for b in order:
            members = buckets[b]
            if len(members) < 2:
                break
            d = 0
            while True:
                places = {self._place(hashes[i], d) for i in members}
                if len(places) == len(members) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for i in members:
                self.slots[self._place(hashes[i], d)] = i
        free = (p for p in range(n) if self.slots[p] < 0)
        for b in order:
            if len(buckets[b]) == 1:
                p = next(free)
                self.shift[b], self.slots[p] = -1 - p, buckets[b][0]
        self.keys = keys

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        return (((h >> 20) + d * ((h >> 40) | 1)) ^ (d * 0x9E3779B1)) % self.n

    def get(self, key: bytes) -> int:
        """The key's index in the list, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        i = self.slots[self._place(h, self.shift[h % self.n_buckets])]
        return i if self.keys[i] == key else -1


def merge_bytes(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """BPE ids of one pre-token: a heap of candidate pairs over linked bytes.

    An entry packs (rank, place of the left part, place after the right part) into one integer, so that the least rank
    comes first and the leftmost of equal ones; it is stale if either part has since grown or gone.
    """
    n, get = len(piece), rank.get
    wide = n.bit_length()
    low, twice = (1 << wide) - 1, 2 * wide
    end = list(range(1, n + 1))  # the part at i is piece[i:end[i]]; 0: gone
    before = list(range(-1, n))
    heap = [(r << twice) | (i << wide) | (i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, stop = (top >> wide) & low, top & low
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (r << twice) | (i << wide) | end[stop])
        h = before[i]
        if h >= 0 and (r := get(piece[h:stop])) is not None:
            heappush(heap, (r << twice) | (h << wide) | stop)
    ids, i = [], 0
    while i < n:
        ids.append(rank[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encodes and decodes by the ranks of a .tiktoken file's bytes; ranks need not be dense."""

    def __init__(self, rank_file: bytes):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.tokens = [base64.b64decode(t) for t, _ in pairs]
        self.ids = [int(r) for _, r in pairs]
        self.table = PerfectHash(self.tokens)
        self.rank = dict(zip(self.tokens, self.ids, strict=True))
        by_id = sorted(zip(self.ids, self.tokens, strict=True))
        top = by_id[-1][0] + 1 if by_id else 0
        self.length = np.zeros(top, dtype=np.int64)
        self.length[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        self.memo: dict[int, tuple[int, ...]] = {}

    def resolve(self, piece: bytes) -> tuple[int, ...]:
        i = self.table.get(piece)
        return (self.ids[i],) if i >= 0 else tuple(merge_bytes(piece, self.rank))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.first[ids], self.length[ids])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents in a row, and where each document's begin."""
        start = pretokens(data, offsets)
        stop = np.append(start[1:], len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_symbols(data) * powers(BASE, len(data)), out=total[1:])
        run = (total[stop] - total[start]) * powers(INVERSE, len(data) + 1)[start]
        keys, where, which = np.unique(mix(run + (stop - start).astype(np.uint64)), return_index=True, return_inverse=True)
        raw, memo, found = data.tobytes(), self.memo, []
        for key, w in zip(keys.tolist(), where.tolist()):
            ids = memo.get(key)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[key] = self.resolve(raw[start[w] : stop[w]])
            found.append(ids)
        flat, counts = self._spread(found, which)
        if not np.array_equal(self.decode(flat), data):  # two pre-tokens with one hash
            flat, counts = self._spread([self.resolve(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())], np.arange(len(start)))
        ends = np.concatenate(([0], np.cumsum(counts)))
        return flat, ends[np.searchsorted(start, offsets)]

    @staticmethod
    def _spread(found: list[tuple[int, ...]], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        firsts = np.cumsum(sizes) - sizes
        return flat[ragged(firsts[which], sizes[which])], sizes[which]


@lru_cache(maxsize=4)
def _codec(rank_file: bytes) -> Codec:
    return Codec(rank_file)


def encoded(rank_file: bytes):
    """A function of record batches (doc_id, text) that yields doc_id, ids and the bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_file)
        for block in blocks(batches, 1 << 20):
            ids, ends = codec.encode(*flat_text(block.column("text")))
            back, lengths = codec.decode(ids), np.concatenate(([0], np.cumsum(codec.length[ids])))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            decoded = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(lengths[ends].astype(np.int32)), pa.py_buffer(back)])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    return run


SCHEMA = "doc_id bigint, ids array<int>, decoded binary"


def encode(docs: DataFrame, rank_path: str, *, then=None, schema: str = SCHEMA) -> DataFrame:
    """doc_id, ids and decoded bytes for each row of docs, or what `then` makes of such record batches.

    The rank file is read once, on the driver; its size is that of a vocabulary, whatever the input.  Null text counts as
    empty; empty text has no ids and decodes to no bytes.  Repeated rows give repeated rows; special tokens are ordinary
    text; other columns are ignored; an empty table gives none.
    """
    with open(rank_path, "rb") as f:
        rank_file = f.read()
    step = encoded(rank_file)
    return shared.documents(docs).mapInArrow(lambda batches: then(step(batches)) if then else step(batches), schema)
