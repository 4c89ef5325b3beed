"""Repeated word sequences by relative Lempel-Ziv parsing.

The reference is the corpus itself.  Only windows whose anchor occurs twice (see `anchors`) can repeat; those around one
anchor make a context of fewer than twice `window` words.  Contexts are dealt by anchor; all that meet in one task are a
reference block, whose words are numbered (equal numbers are equal words, no hashes) and indexed: from each anchor
outwards, to the left and to the right, a rank tells contexts with the same words so far apart from others.  A context is
then parsed against its block: from the first start that no factor covers, a place elsewhere with the same `window` words
is looked up by the two ranks, and the match is extended greedily, word by word, to its end.  Where a factor ends, the
next start is looked up anew, so windows across a boundary of factors are checked as well.  A context that another place
repeats as a whole is one factor; blocks of documents settle such copies among themselves and send one on.  The words
under factors, all at least `window` long, are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import anchors, shared
from .anchors import Units, by_bucket, gathered, pack, unpack
from .kernels import U64, blocks, flat_text, ragged

GRAM = 12
OUT = "doc_id bigint, n_words bigint, n_removed bigint, factors array<struct<start:bigint,n_words:bigint,source_doc:bigint,source_start:bigint>>, kept_text string, kept_sha256 string"
_FACTOR = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())])


def merged(start: np.ndarray, n: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray) -> list[dict]:
    """Factors of one document in order; those that meet and whose sources run on alike are one."""
    out: list[dict] = []
    for a, k, d, b in sorted(zip(start.tolist(), n.tolist(), source_doc.tolist(), source_start.tolist())):
        last = out[-1] if out else None
        if last and a <= last["start"] + last["n_words"] and d == last["source_doc"] and b - a == last["source_start"] - last["start"]:
            last["n_words"] = max(last["n_words"], a + k - last["start"])
        else:
            out.append({"start": a, "n_words": k, "source_doc": d, "source_start": b})
    return out


def _kept(units: Units, removed: np.ndarray, keep_text: bool) -> tuple[list, list]:
    """Kept words of each document joined by one space, or nothing; and the digest of that text."""
    words = units.words
    keep = np.flatnonzero(~removed)
    length = words.stop[keep] - words.start[keep]
    # Each word with a blank behind it: a copy of the byte after the word, overwritten.
    place = ragged(words.start[keep], length + 1)
    text = units.data[np.minimum(place, len(units.data) - 1)] if len(place) else np.zeros(0, dtype=np.uint8)
    ends = np.concatenate(([0], np.cumsum(length + 1)))
    text[ends[1:] - 1] = 32
    cuts = ends[np.searchsorted(keep, units.bounds)].tolist()
    raw = memoryview(text)
    parts = [raw[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]
    return [str(p, "utf-8") for p in parts] if keep_text else [None] * len(parts), [hashlib.sha256(p).hexdigest() for p in parts]


def _finished(ids, units: Units, removed: np.ndarray, factors: list, keep_text: bool) -> pa.RecordBatch:
    gone = np.concatenate(([0], np.cumsum(removed)))
    text, digest = _kept(units, removed, keep_text)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(units.bounds).astype(np.int64)),
            pa.array(gone[units.bounds[1:]] - gone[units.bounds[:-1]]),
            pa.array(factors, type=pa.list_(_FACTOR)),
            pa.array(text, type=pa.string()),
            pa.array(digest, type=pa.string()),
        ],
        ["doc_id", "n_words", "n_removed", "factors", "kept_text", "kept_sha256"],
    )


def _looked_up(window: int, keep_text: bool):
    """Documents without a candidate window are finished; of the others, text and candidate starts are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, anchors.BLOCK):
            text = block.column("text")
            units = Units("words", *flat_text(text))
            starts, doc = anchors.candidate_windows(units, window, GRAM, block.column("found"))
            has = np.zeros(block.num_rows, dtype=bool)
            has[doc] = True
            done = _finished(block.column("doc_id"), units, np.zeros(len(units.symbols), dtype=bool), [[]] * block.num_rows, keep_text)
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


def _joined(units: Units) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block's words with one blank behind each; first and past-the-last byte of each word there."""
    words = units.words
    length = words.stop - words.start
    text = units.data[np.minimum(ragged(words.start, length + 1), len(units.data) - 1)] if len(length) else np.zeros(0, dtype=np.uint8)
    ends = np.cumsum(length + 1)
    text[ends - 1] = 32
    return text.tobytes(), ends - length - 1, ends - 1


def _context_rows(window: int, n_parts: int):
    """Contexts dealt by anchor; of those that a block has several times, one goes on and the others are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, anchors.BLOCK):
            units = Units("words", *flat_text(block.column("text")))
            ids = block.column("doc_id").to_numpy()
            at = [unpack(x) for x in block.column("windows").to_pylist()]
            starts = np.concatenate([ragged(s + b, n) for (s, n), b in zip(at, units.bounds)])
            key, place, start, count = anchors.contexts(units, starts, window, GRAM)
            which = np.searchsorted(units.bounds, start, side="right") - 1
            doc, local = ids[which], start - units.bounds[which]
            order = np.lexsort((start, doc, key, anchors._deal(key, n_parts)))
            key, place, start, count, doc, local = (c[order] for c in (key, place, start, count, doc, local))
            raw, first, stop = _joined(units)
            seen: dict[tuple[int, bytes], int] = {}
            source = np.full(len(key), -1, dtype=np.int64)
            send, text = [], []
            for i, (left, a, b) in enumerate(zip((place - start).tolist(), first[start].tolist(), stop[start + count + window - 2].tolist())):
                context = raw[a:b]
                j = seen.setdefault((left, context), i)
                if j == i:
                    send.append(i)
                    text.append(context)
                else:
                    source[i] = j
                    if source[j] < 0:
                        source[j] = i
            go = np.array(send, dtype=np.int64)
            part, data, content, settled = [], [], [], []
            for q, a, b in anchors._runs(anchors._deal(key[go], n_parts)):
                some = go[a:b]
                part.append(q)
                data.append(pack(key[some], doc[some], local[some], count[some], (place - start)[some], source[some] >= 0))
                content.append(zstandard.ZstdCompressor(level=1).compress(b"\n".join(text[a:b])))
                settled.append(False)
            own = np.flatnonzero(source >= 0)
            if len(own):
                part.append(int(key[0] >> U64(17)) % n_parts)
                data.append(pack(doc[own], local[own], count[own] + window - 1, doc[source[own]], local[source[own]]))
                content.append(None)
                settled.append(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, type=pa.int32()), pa.array(data, type=pa.binary()), pa.array(content, type=pa.binary()), pa.array(settled)],
                ["part", "data", "content", "settled"],
            )

    return run


class ReferenceBlock:
    """Different contexts around some anchors, side by side as numbered words, with ranks from the anchor outwards."""

    def __init__(self, left: np.ndarray, count: np.ndarray, content: list[bytes], window: int):
        self.left, self.count, self.window = left, count, window
        number: dict[bytes, int] = {}
        words = [c.split(b" ") for c in content]
        self.n = np.array([len(w) for w in words], dtype=np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.words = np.fromiter((number.setdefault(w, len(number)) for c in words for w in c), dtype=np.int64, count=int(self.n.sum()))
        depth = window - GRAM
        rank = np.zeros(len(content), dtype=np.int64)
        for k in range(GRAM):
            rank = self._refined(rank, left + k)
        self.right_rank, self.left_rank = [rank], [rank]
        for k in range(depth):
            self.right_rank.append(self._refined(self.right_rank[-1], left + GRAM + k))
            self.left_rank.append(self._refined(self.left_rank[-1], left - 1 - k))

    def _refined(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks by one more word; -1 where the context has no such word."""
        there = (rank >= 0) & (place >= 0) & (place < self.n)
        out = np.full(len(rank), -1, dtype=np.int64)
        out[there] = np.unique((rank[there] << 32) | self.words[self.begin[there] + place[there]], return_inverse=True)[1]
        return out

    def factors(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context, start, length, source context, source start of the factors of all contexts but those settled as a whole."""
        covered = np.where(whole, self.count, 0)
        found = [[np.zeros(0, dtype=np.int64)] * 5]
        for before in range(self.window - GRAM, -1, -1):
            start = self.left - before
            there = np.flatnonzero((start >= 0) & (start < self.count))
            if not len(there):
                continue
            rank = (self.left_rank[before][there] << 32) | self.right_rank[self.window - GRAM - before][there]
            _, lead, group, size = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
            hit = np.flatnonzero((size[group] > 1) & (start[there] >= covered[there]))
            if not len(hit):
                continue
            # Another place with the same words: the group's first, or for that one the group's last.
            last = np.zeros(len(lead), dtype=np.int64)
            last[group] = np.arange(len(there))
            source = np.where(lead[group[hit]] == hit, last[group[hit]], lead[group[hit]])
            x, y = there[hit], there[source]
            length = self.window + self._runs_on(x, start[x] + self.window, y, start[y] + self.window)
            covered[x] = start[x] + length - self.window + 1
            found.append([x, start[x], length, y, start[y]])
        return tuple(np.concatenate(c) for c in zip(*found))

    def _runs_on(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, source_at: np.ndarray) -> np.ndarray:
        """Equal words of contexts x and y from the given places on."""
        steps = np.arange(self.window)
        a, b = at[:, None] + steps, source_at[:, None] + steps
        inside = (a < self.n[x][:, None]) & (b < self.n[y][:, None])
        top = len(self.words) - 1
        same = inside & (self.words[np.minimum(self.begin[x][:, None] + a, top)] == self.words[np.minimum(self.begin[y][:, None] + b, top)])
        return np.cumprod(same, axis=1).sum(axis=1)


def _factored(window: int, n_buckets: int):
    """Parses all contexts of a reference block against it: document, start, length, source document and start of factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, members, classes, content = [], [], {}, []
        for batch in batches:
            for data, text, settled in zip(batch.column("data").to_pylist(), batch.column("content").to_pylist(), batch.column("settled").to_pylist()):
                some = unpack(data)
                if settled:
                    yield by_bucket(n_buckets, *some)
                    continue
                for c, left in zip(zstandard.ZstdDecompressor().decompress(text).split(b"\n"), some[4].tolist()):
                    k = classes.setdefault((left, c), len(content))
                    if k == len(content):
                        content.append(c)
                    members.append(k)
                rows.append(some)
        if not rows:
            return
        del classes
        key, doc, start, count, left, settled = np.concatenate(rows, axis=1)
        members = np.array(members)
        size = np.bincount(members)
        head, tail = np.zeros(len(content), dtype=np.int64), np.zeros(len(content), dtype=np.int64)
        head[members[::-1]] = np.arange(len(members))[::-1]
        tail[members] = np.arange(len(members))
        copies = np.flatnonzero((size[members] > 1) & (settled == 0))
        source = np.where(head[members[copies]] == copies, tail[members[copies]], head[members[copies]])
        if len(copies):
            yield by_bucket(n_buckets, doc[copies], start[copies], count[copies] + window - 1, doc[source], start[source])
        whole = size > 1
        whole[members[settled == 1]] = True
        by_key = np.argsort(key[head], kind="stable")
        keys = key[head][by_key]
        same = np.concatenate(([False], keys[1:] == keys[:-1]))
        several = by_key[same | np.append(same[1:], False)]
        if len(several):
            at = head[several]
            block = ReferenceBlock(left[at], count[at], [content[i] for i in several.tolist()], window)
            x, s, n, y, t = block.factors(whole[several])
            if len(x):
                yield by_bucket(n_buckets, doc[at[x]], start[at[x]] + s, n, doc[at[y]], start[at[y]] + t)

    return run


def _parsed(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, anchors.BLOCK):
            units = Units("words", *flat_text(block.column("text")))
            steps, factors = np.zeros(len(units.symbols) + 1, dtype=np.int64), []
            for i in range(block.num_rows):
                at, n, source_doc, source_start = gathered(block.column("found"), i, 4)
                factors.append(merged(at, n, source_doc, source_start) if keep_text else [])
                np.add.at(steps, at + units.bounds[i], 1)
                np.add.at(steps, at + n + units.bounds[i], -1)
            yield _finished(block.column("doc_id"), units, np.cumsum(steps)[:-1] > 0, factors, keep_text)

    return run


def substring_dedup(docs: DataFrame, *, window: int = 50, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, factors (empty unless keep_text), kept_text (null unless keep_text), kept_sha256 for each row of docs.

    A word is removed if a run of `window` words that covers it also starts anywhere else, the same document included.
    Null text counts as empty; a document with fewer words keeps them all; copies of a document lose all words, in every
    copy, and so do rows that repeat a doc_id, each of which is returned.  Other columns are ignored; an empty table gives
    no rows; texts may be of any length.
    """
    docs = shared.documents(docs)
    n = shared.parts(docs.sparkSession)
    again = anchors.repeated_anchors(docs, "words", window, GRAM, across=False)
    first = shared.written(
        anchors.with_rows(docs, again).mapInArrow(_looked_up(window, keep_text), OUT + ", text string, windows binary"), "rlz-looked-up"
    )
    names = ["doc_id", "n_words", "n_removed", "factors", "kept_text", "kept_sha256"]
    late = first.where("windows IS NOT NULL").select("doc_id", "text", "windows")
    factors = (
        late.mapInArrow(_context_rows(window, 2 * n), "part int, data binary, content binary, settled boolean")
        .repartition(n, "part")
        .mapInArrow(_factored(window, n), anchors.PACKED)
    )
    parsed = anchors.with_rows(late.select("doc_id", "text"), factors).mapInArrow(_parsed(keep_text), OUT)
    return first.where("windows IS NULL").select(*names).unionByName(parsed)
