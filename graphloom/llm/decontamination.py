"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of folded words.  A window of a document, as long as a benchmark item, is embedded by the random walk
of Chakraborty, Goldenberg and Koucky: at each of 3 n steps the symbol under the pointer is put out, and a random bit of
(step, symbol) says whether the pointer moves, so that sequences at a small edit distance agree in many places.  Each of
TABLES hash tables of a walk samples SAMPLED of its places; an item whose key a window has in any table is verified by the
exact edit distance between it and the best-fitting run of words around its windows.  Longer items have more edits within
the tolerance, and one early edit can lead a walk astray for long, so the number of independent walks grows with an item's
length (`n_walks`); README has the recall that was measured at the tolerance, to which RECALL is the target.

Which windows are embedded is told by a lossless count.  An item of n words has m = n - q + 1 runs of q words (its grams).
Each edit touches q of them at most, so any run of words within e edits of the item keeps m - q e of the grams, at n + e -
q places from first to last at most; other windows cannot hold the item.  Pairs of words (q = 2) serve where that bound is
positive, single words otherwise.  Of any q e + 1 grams of an item at least one is kept, so only documents with one of the
item's rarest q e + 1 are looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .kernels import U64, blocks, flat_text, gram_hashes, mix, ragged
from .statistics import folded_words

#: Share of the runs at the tolerance that a walk's tables should bring to verification; tables of a walk, places of each.
RECALL, TABLES, SAMPLED = 0.99, 32, 2
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in several passes.
BROADCAST = 16 << 20
#: Meetings of a block's grams with items that are held at once, but for a single document.
MEETINGS = 4 << 20


def _last_row(item: np.ndarray, text: np.ndarray, anchored: bool) -> np.ndarray:
    """Least edit distances between item and the runs of words that end behind each word of text, begun anywhere or at its start."""
    steps = np.arange(len(text) + 1)
    row = steps.copy() if anchored else np.zeros_like(steps)
    for i, word in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        new = np.concatenate(([i], best))
        row = np.minimum.accumulate(new - steps) + steps  # insertions run on from the left
    return row


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between item and any run of words in text, and where the first such run to end begins."""
    row = _last_row(item, text, False)
    end = int(row.argmin())
    return int(row[end]), end - int(_last_row(item[::-1], text[:end][::-1], True).argmin())


def n_walks(n: int) -> int:
    """Independent walks for items of n words."""
    return 3 + n // 25


def walks(symbols: np.ndarray, starts: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """CGK walks (seed, window, step) of windows of n symbols, or as many as there are; behind its end a walk puts out zeros."""
    out = np.zeros((len(seeds), len(starts), 3 * n), dtype=U64)
    at = np.zeros((len(seeds), len(starts)), dtype=np.int64)
    most = np.minimum(n, len(symbols) - starts)
    salt = mix(seeds.astype(U64) + U64(1))[:, None]
    for step in range(3 * n):
        s = np.where(at < most, symbols[np.minimum(starts + at, len(symbols) - 1)], U64(0))
        out[:, :, step] = s
        at += (mix(s + salt + U64(step * 0x9E3779B97F4A7C15 % 2**64)) & U64(1)).astype(np.int64)
    return out


def table_keys(found: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """A key for each walk, window and table."""
    keys = np.zeros((*found.shape[:2], TABLES), dtype=U64) + np.arange(TABLES, dtype=U64)
    for k, seed in enumerate(seeds.tolist()):
        for places in np.random.default_rng((n, seed)).integers(0, 2 * n, (SAMPLED, TABLES)):
            keys[k] = mix(keys[k] * U64(0x9E3779B97F4A7C15) + found[k][:, places])
    return keys


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Postings:
    """Items by the hashes of their grams."""

    def __init__(self, grams: list[np.ndarray], owners: list[int]):
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=U64)
        owner = np.repeat(np.array(owners, dtype=np.int64), [len(g) for g in grams])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.known, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        return np.flatnonzero(_within(grams, self.known))

    def sizes(self, grams: np.ndarray) -> np.ndarray:
        """Owners of each gram, all of them known."""
        return self.count[np.searchsorted(self.known, grams)]

    def owners(self, grams: np.ndarray) -> np.ndarray:
        return self.owner[ragged(self.first[np.searchsorted(self.known, grams)], self.sizes(grams))]


class Index:
    """Benchmark items by their grams."""

    def __init__(self, items: list[tuple[int, str]], tolerance: float):
        self.symbols, self.ids = [], []
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            words, _ = folded_words(data, np.array([0, len(data)]))
            if len(words.hash):
                self.ids.append(item_id)
                self.symbols.append(words.hash)
        self.n = np.array([len(x) for x in self.symbols], dtype=np.int64)
        self.allowed = np.array([int(len(x) * tolerance) for x in self.symbols], dtype=np.int64)
        size = np.where(self.n - 1 - 2 * self.allowed > 0, 2, 1)
        self.need = self.n - size + 1 - size * self.allowed
        self.keys: dict[tuple[int, int], np.ndarray] = {}
        self.grams: dict[int, tuple[Postings, Postings]] = {}
        for q in sorted(set(size.tolist())):
            members = np.flatnonzero(size == q).tolist()
            every = [gram_hashes(self.symbols[i], q) for i in members]
            own = [np.unique(g) for g in every]
            often = Counter(np.concatenate(own).tolist())
            rare = [np.unique(np.array(sorted(g.tolist(), key=lambda x: (often[x], x))[: q * self.allowed[i] + 1], dtype=U64)) for i, g in zip(members, every)]
            self.grams[q] = Postings(own, members), Postings(rare, members)

    def meets(self, i: int, text: np.ndarray) -> bool:
        """Whether a window of text, as long as item i, has the item's key in a table of one of the walks."""
        n = int(self.n[i])
        starts = np.arange(max(1, len(text) - max(1, n - int(self.allowed[i])) + 1))
        low, high = 0, 1
        while low < n_walks(n):  # most that meet do so in one of the first walks
            seeds = np.arange(low, min(high, n_walks(n)))
            if (i, low) not in self.keys:
                self.keys[i, low] = table_keys(walks(self.symbols[i], np.zeros(1, dtype=np.int64), n, seeds), n, seeds)
            for some in np.array_split(starts, -(-len(starts) * 3 * n * len(seeds) // MEETINGS)):
                if (table_keys(walks(text, some, n, seeds), n, seeds) == self.keys[i, low]).any():
                    return True
            low, high = high, 2 * high + 1
        return False

    def candidates(self, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, first and past-the-last word of the texts whose windows are embedded; they hold every run within the tolerance."""
        for q, (every, rare) in self.grams.items():
            grams = gram_hashes(symbols, q)
            doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(grams)]
            grams_end = bounds[1:][doc_of] - q + 1
            inside = np.flatnonzero(np.arange(len(grams)) < grams_end)
            at = inside[rare.hits(grams[inside])]
            seeds = [np.zeros(0, dtype=np.int64)]
            for some in _dealt(at, doc_of, rare.sizes(grams[at])):
                seeds.append(np.unique(np.repeat(doc_of[some], rare.sizes(grams[some])) * len(self.ids) + rare.owners(grams[some])))
            met = np.concatenate(seeds)  # ascending, as documents are never dealt apart
            seeded = np.zeros(len(bounds), dtype=bool)
            seeded[met // max(1, len(self.ids))] = True
            inside = inside[seeded[doc_of[inside]]]
            at = inside[every.hits(grams[inside])]
            for some in _dealt(at, doc_of, every.sizes(grams[at])):
                sizes = every.sizes(grams[some])
                key = np.repeat(doc_of[some], sizes) * len(self.ids) + every.owners(grams[some])
                keep = np.flatnonzero(_within(key, met))
                key, place = key[keep], np.repeat(some, sizes)[keep]
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order]
                item = key % len(self.ids)
                j = np.arange(len(key))
                last = j + self.need[item] - 1
                j = j[last < len(key)]
                last = last[j]
                reach = (self.n + self.allowed)[item[j]]
                near = (key[last] == key[j]) & (place[last] - place[j] <= reach - q)
                j, last, reach = j[near], last[near], reach[near]
                doc = key[j] // len(self.ids)
                low = np.maximum(place[last] + q - reach, bounds[doc])
                high = np.minimum(place[j] + reach, bounds[doc + 1])
                new = np.ones(len(j), dtype=bool)
                new[1:] = (key[j][1:] != key[j][:-1]) | (low[1:] > high[:-1])
                first = np.flatnonzero(new)
                final = np.append(first[1:], len(j))[: len(first)] - 1
                yield from zip(doc[first].tolist(), item[j[first]].tolist(), low[first].tolist(), high[final].tolist())


def _dealt(at: np.ndarray, doc_of: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts places into parts of about MEETINGS meetings, no document in two."""
    ends, low = np.cumsum(sizes), 0
    while low < len(at):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEETINGS, side="right"))
        if high < len(at):
            begin = int(np.searchsorted(doc_of[at], doc_of[at[high]]))
            high = begin if begin > low else int(np.searchsorted(doc_of[at], doc_of[at[low]], side="right"))
        yield at[low:high]
        low = high


def _leaks(items: list[tuple[int, str]], tolerance: float):
    made: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Index(items, tolerance))
        index = made[0]
        for block in blocks(batches, 2 << 20):
            words, _ = folded_words(*flat_text(block.column("text")))
            ids, found = block.column("doc_id").to_pylist(), {}
            for d, i, low, high in index.candidates(words.hash, words.bounds):
                if not index.meets(i, words.hash[low:high]):
                    continue
                k, start = best_run(index.symbols[i], words.hash[low:high])
                if k <= index.allowed[i]:
                    found[d, i] = min(found.get((d, i), (k, low + start)), (k, low + start))
            rows = [(ids[d], index.ids[i], start - int(words.bounds[d]), len(index.symbols[i]), k) for (d, i), (k, start) in found.items()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], ["doc_id", "item_id", "start_word", "n_words", "distance"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *, tolerance: float = 0.2) -> DataFrame:
    """doc_id, item_id, start_word, n_words (of the item), distance: items found in documents.

    An item is in a document if some run of its folded words (lower case, letters and digits) is within tolerance *
    n_words word edits of the item's; every row is such an item, and of those at the tolerance RECALL are found.  Null or empty items and texts have no words and never meet.  A row of docs gives
    one row for each item found, with the least distance and the first word of a run that has it.  Other columns are
    ignored.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("the tolerance is a share of an item's words, below 1")
    docs = shared.documents(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-int(total) // BROADCAST))
    out = None
    for k in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        rows = [(r["item_id"], r["text"]) for r in some.collect()]  # BROADCAST bytes or so
        found = docs.mapInArrow(_leaks(rows, tolerance), "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance bigint")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item was found, with all their columns."""
    lost = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_lost"), "left_anti")
