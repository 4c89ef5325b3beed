"""Repeated byte strings by suffix arrays.

Only windows of `window` bytes whose anchor occurs in two documents can repeat (see `anchors`).  The windows of one anchor
in one place make a context of fewer than twice `window` bytes.  Contexts are dealt by anchor.  Equal contexts, compared
byte by byte, travel as one that knows its smallest document; in any other document all of its windows are repeats.  Of an
anchor's different contexts, the windows whose 64-bit hash occurs in another are cut out (others cannot repeat), and equal
strings of them are taken once.  These strings go into one text per task, whose suffix array (grouping under Lyndon
prefixes, see `suffix_array`) brings equal windows together; each takes the smallest document among them.  In that text a
single symbol stands for the anchor, whose bytes all of them share.  Only the arrays make windows equal; a collision of
hashes costs work, never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import anchors, shared
from .anchors import Units, by_bucket, gathered, pack, unpack
from .kernels import U64, blocks, byte_symbols, cover, flat_text, gram_hashes, mix, ragged, spans
from .suffix_array import shared_prefixes, suffix_array

GRAM = 24
#: Symbols in one suffix array, about; parts that a larger anchor's windows are dealt to, for each such number.
TEXT, DEAL = 250_000, 4
#: Contexts that a task takes out of what it is sent at a time (about 280 bytes each), and windows that it settles at a time (about 270), about.
CONTEXTS, WINDOWS = 300_000, 400_000
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def _finished(ids, units: Units, removed: np.ndarray, keep_bytes: bool) -> pa.RecordBatch:
    bounds = units.bounds
    gone = np.concatenate(([0], np.cumsum(removed)))
    first, _ = spans(removed, bounds)
    kept = units.data[~removed]
    cuts = (bounds - gone[bounds]).tolist()
    raw = memoryview(kept)
    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(bounds)),
            pa.array(gone[bounds[1:]] - gone[bounds[:-1]]),
            pa.array(np.diff(np.searchsorted(first, bounds)).astype(np.int64)),
            pa.array([bytes(p) for p in parts] if keep_bytes else [None] * len(parts), type=pa.binary()),
            pa.array([hashlib.sha256(p).hexdigest() for p in parts], type=pa.string()),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
    )


def _looked_up(window: int, keep_bytes: bool):
    """Documents without a candidate window are finished; of the others, text and candidate starts are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, anchors.BYTE_BLOCK):
            text = block.column("text")
            units = Units("bytes", *flat_text(text))
            starts, doc = anchors.candidate_windows(units, window, GRAM, block.column("found"))
            has = np.zeros(block.num_rows, dtype=bool)
            has[doc] = True
            done = _finished(block.column("doc_id"), units, np.zeros(len(units.data), dtype=bool), keep_bytes)
            windows = [None] * block.num_rows
            for d, a, b in anchors._runs(doc):
                at = starts[a:b]
                cut = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
                windows[d] = pack(at[cut] - units.bounds[d], np.diff(np.append(cut, len(at))))
            late = pa.array(np.arange(len(has)), mask=~has)
            yield pa.RecordBatch.from_arrays(
                [*done.columns, text.take(late), pa.array(windows, type=pa.binary())],
                [*done.schema.names, "text", "windows"],
            )

    return run


def _context_rows(window: int, n_parts: int):
    """Contexts dealt by anchor; a context that a block has in several documents goes on for the smallest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2 * anchors.BYTE_BLOCK):
            units = Units("bytes", *flat_text(block.column("text")))
            ids = block.column("doc_id").to_numpy()
            at = [unpack(x) for x in block.column("windows").to_pylist()]
            starts = np.concatenate([ragged(s + b, n) for (s, n), b in zip(at, units.bounds)])
            key, place, start, count = anchors.contexts(units, starts, window, GRAM)
            doc = ids[np.searchsorted(units.bounds, start, side="right") - 1]
            local = start - units.bounds[np.searchsorted(units.bounds, start, side="right") - 1]
            order = np.lexsort((doc, key, anchors._deal(key, n_parts)))
            key, place, start, count, doc, local = (c[order] for c in (key, place, start, count, doc, local))
            raw = units.data.tobytes()
            least: dict[tuple[int, bytes], int] = {}
            send = np.zeros(len(key), dtype=bool)
            text = []
            for i, (p, s, n, d) in enumerate(zip(place.tolist(), start.tolist(), count.tolist(), doc.tolist())):
                context = raw[s : s + n + window - 1]
                if least.setdefault((p - s, context), d) == d:
                    send[i] = True
                    text.append(context)
            part, data, content, settled = [], [], [], []
            go = np.flatnonzero(send)
            for q, a, b in anchors._runs(anchors._deal(key[go], n_parts)):
                some = go[a:b]
                part.append(q)
                data.append(pack(key[some], doc[some], local[some], count[some], (place - start)[some]))
                content.append(zstandard.ZstdCompressor(level=1).compress(b"".join(text[a:b])))
                settled.append(False)
            rest = np.flatnonzero(~send)
            if len(rest):
                part.append(int(key[0] >> U64(17)) % n_parts)
                data.append(pack(doc[rest], local[rest], count[rest]))
                content.append(None)
                settled.append(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, type=pa.int32()), pa.array(data, type=pa.binary()), pa.array(content, type=pa.binary()), pa.array(settled)],
                ["part", "data", "content", "settled"],
            )

    return run


def _runs_of(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of true flags of one owner."""
    on = np.flatnonzero(hit)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(on) != 1) | (owner[on[1:]] != owner[on[:-1]])))) if len(on) else on
    return on[cut], np.diff(np.append(cut, len(on)))


class _Windows:
    """Windows of different contexts of some anchors, in a row: context, number in it, hash, smallest document so far."""

    def __init__(self, key, left, count, doc, content: list[bytes], window: int):
        self.key, self.left, self.content, self.window = key, left, content, window
        self.first = np.cumsum(count) - count
        self.owner = np.repeat(np.arange(len(key)), count)
        self.at = np.arange(len(self.owner)) - self.first[self.owner]
        self.least = doc[self.owner]
        flat = np.frombuffer(b"".join(content), dtype=np.uint8)
        size = count + window - 1
        self.hash = gram_hashes(byte_symbols(flat), window)[ragged(np.cumsum(size) - size, count)]

    def strings(self, part: np.ndarray) -> tuple[dict, list]:
        """Runs of windows with one part number >= 0 as different strings (key, part, anchor's place, bytes), and the runs of each."""
        known: dict[tuple, int] = {}
        places: list[list[tuple[int, int]]] = []
        first, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(part):
            change = np.concatenate(([True], (part[1:] != part[:-1]) | (self.owner[1:] != self.owner[:-1])))
            first, n = _runs_of(part >= 0, np.cumsum(change))
        own = self.owner[first]
        for f, k, o, a, q, key, left in zip(
            first.tolist(), n.tolist(), own.tolist(), self.at[first].tolist(), part[first].tolist(), self.key[own].tolist(), self.left[own].tolist()
        ):
            i = known.setdefault((key, q, left - a, self.content[o][a : a + k + self.window - 1]), len(places))
            if i == len(places):
                places.append([])
            places[i].append((f, k))
        return known, places

    def settle(self) -> np.ndarray:
        """The smallest document of each window, by suffix arrays over the windows whose hash occurs again."""
        _, group, size = np.unique(self.hash, return_inverse=True, return_counts=True)
        part = np.where(size[group] > 1, 0, -1)
        known, places = self.strings(part)
        total = Counter()
        for key, _, _, text in known:
            total[key] += len(text) - GRAM + 2
        large = {k: -(-n // TEXT) for k, n in total.items() if n > TEXT}
        if large:
            # Equal windows have equal hashes, so those of a large anchor are dealt by theirs, and each part has its own array.
            for k, n_parts in large.items():
                mine = (self.key[self.owner] == k) & (part >= 0)
                part[mine] = (mix(self.hash[mine]) % U64(n_parts * DEAL)).astype(np.int64)
            known, places = self.strings(part)
        order = sorted(range(len(places)), key=list(known).__getitem__) if len(large) else range(len(places))
        strings = list(known)
        batch, symbols, before = [], 0, None
        for i in order:
            if symbols > TEXT and strings[i][:2] != before:
                self._array([strings[j] for j in batch], [places[j] for j in batch])
                batch, symbols = [], 0
            batch.append(i)
            symbols += len(strings[i][3]) - GRAM + 2
            before = strings[i][:2]
        if batch:
            self._array([strings[j] for j in batch], [places[j] for j in batch])
        return self.least

    def _array(self, strings: list[tuple], places: list[list[tuple[int, int]]]) -> None:
        """Brings equal windows of the strings together by their suffix array; one symbol stands for an anchor and its part."""
        depth = self.window - GRAM + 1
        size = np.array([len(t) - GRAM + 2 for *_, t in strings])
        begin = np.cumsum(size) - size
        symbols = np.full(int(size.sum()), -1, dtype=np.int64)
        anchor: dict[tuple[int, int], int] = {}
        count = np.array([len(t) - self.window + 1 for *_, t in strings])
        first = np.cumsum(count) - count
        best = np.empty(int(count.sum()), dtype=np.int64)
        for (key, q, n, text), at, f, c, runs in zip(strings, begin.tolist(), first.tolist(), count.tolist(), places):
            raw = np.frombuffer(text, dtype=np.uint8)
            symbols[at : at + n] = raw[:n]
            symbols[at + n] = 256 + anchor.setdefault((key, q), len(anchor))
            symbols[at + n + 1 : at + len(raw) - GRAM + 1] = raw[n + GRAM :]
            best[f : f + c] = np.min([self.least[a : a + c] for a, _ in runs], axis=0)
        target = np.full(len(symbols), -1, dtype=np.int64)
        target[ragged(begin, count)] = np.arange(len(best))
        order = suffix_array(symbols)
        order = order[target[order] >= 0]
        where, group = target[order], shared_prefixes(symbols, order, depth)
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        best[where] = np.repeat(np.minimum.reduceat(best[where], cut), np.diff(np.append(cut, len(where))))
        for f, c, runs in zip(first.tolist(), count.tolist(), places):
            for a, _ in runs:
                self.least[a : a + c] = best[f : f + c]


def _pieces(keys: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Places of rows ordered by key, in pieces of about WINDOWS windows: whole anchors, and one at least."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    piece = (np.cumsum(count) - count)[first] // WINDOWS
    return np.split(np.arange(len(keys)), first[1:][piece[1:] != piece[:-1]])


def _settled(key, doc, start, count, left, members, content: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows (document, first, number) that a smaller document has too, of whole anchors' contexts; members: the content of each."""
    least = np.full(len(content), np.iinfo(np.int64).max)
    np.minimum.at(least, members, doc)
    full = doc > least[members]
    yield doc[full], start[full], count[full]
    # One row for each class, those of an anchor together; only anchors with several matter.
    row = np.zeros(len(content), dtype=np.int64)
    row[members] = np.arange(len(members))
    by_key = np.argsort(key[row], kind="stable")
    keys = key[row][by_key]
    same = np.concatenate(([False], keys[1:] == keys[:-1]))
    several = by_key[same | np.append(same[1:], False)]
    if not len(several):
        return
    for piece in _pieces(key[row[several]], count[row[several]]):
        some = several[piece]
        r = row[some]
        best = _Windows(key[r], left[r], count[r], least[some], [content[i] for i in some.tolist()], window).settle()
        first = np.full(len(content), -1, dtype=np.int64)
        first[some] = np.cumsum(count[r]) - count[r]
        mine = np.flatnonzero(~full & (first[members] >= 0))
        owner = np.repeat(np.arange(len(mine)), count[mine])
        hit = best[ragged(first[members[mine]], count[mine])] < doc[mine][owner]
        at, n = _runs_of(hit, owner)
        yield doc[mine][owner[at]], ragged(start[mine], count[mine])[at], n


def _repeats(window: int, n_buckets: int):
    """What a task is sent stays compressed; the contexts of some of its anchors are taken out at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, total = [], 0
        for batch in batches:
            for data, text, settled in zip(batch.column("data").to_pylist(), batch.column("content").to_pylist(), batch.column("settled").to_pylist()):
                some = unpack(data)
                if settled:
                    yield by_bucket(n_buckets, *some)
                else:
                    sent.append((data, text))
                    total += some.shape[1]
        turns, found = -(-total // CONTEXTS), []
        for turn in range(turns):
            rows, members, classes, content = [], [], {}, []
            for data, text in sent:
                some, raw = unpack(data), zstandard.ZstdDecompressor().decompress(text)
                key, _, _, count, left = some
                end = np.cumsum(count + window - 1)
                mine = np.flatnonzero(mix(key.view(U64)) % U64(turns) == turn)
                for e, n, k in zip(end[mine].tolist(), count[mine].tolist(), left[mine].tolist()):
                    c = raw[e - n - window + 1 : e]
                    i = classes.setdefault((k, c), len(content))
                    if i == len(content):
                        content.append(c)
                    members.append(i)
                rows.append(some[:, mine])
            if members:
                found += _settled(*np.concatenate(rows, axis=1), np.array(members), content, window)
        done = [np.concatenate(c) for c in zip(*found)]
        if done and len(done[0]):
            yield by_bucket(n_buckets, *done)

    return run


def _cut(window: int, keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, anchors.BYTE_BLOCK):
            units = Units("bytes", *flat_text(block.column("text")))
            starts = [np.zeros(0, dtype=np.int64)]
            for i in range(block.num_rows):
                first, n = gathered(block.column("found"), i, 2)
                starts.append(ragged(first + units.bounds[i], n))
            yield _finished(block.column("doc_id"), units, cover(np.concatenate(starts), window, len(units.data)), keep_bytes)

    return run


def byte_dedup(docs: DataFrame, *, window: int = 50, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (null unless keep_bytes), kept_sha256 for each row of docs.

    A byte of the UTF-8 text is removed if a string of `window` bytes that covers it also starts in a document with a
    smaller doc_id.  Repeats within a document count for nothing.  Null text counts as empty; shorter texts stay whole.
    doc_id names a document: rows that repeat one must repeat its text, and each of them is returned with the same answer.
    Other columns are ignored; an empty table gives no rows; texts may be of any length.
    """
    docs = shared.documents(docs)
    n = shared.parts(docs.sparkSession)
    again = anchors.repeated_anchors(docs, "bytes", window, GRAM, across=True)
    first = shared.written(
        anchors.with_rows(docs, again).mapInArrow(_looked_up(window, keep_bytes), OUT + ", text string, windows binary"), "bytes-looked-up"
    )
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    late = first.where("windows IS NOT NULL").select("doc_id", "text", "windows")
    repeats = (
        late.mapInArrow(_context_rows(window, 4 * n), "part int, data binary, content binary, settled boolean")
        .repartition(n, "part")
        .mapInArrow(_repeats(window, n), anchors.PACKED)
    )
    cut = anchors.with_rows(late.select("doc_id", "text"), repeats).mapInArrow(_cut(window, keep_bytes), OUT)
    return first.where("windows IS NULL").select(*names).unionByName(cut)
