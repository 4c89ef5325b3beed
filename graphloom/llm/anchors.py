"""Finding text that repeats anywhere in a table, without sending all of it anywhere.

Every window of `window` consecutive units (words or bytes) has an anchor: its gram of least hash (a minimizer).  Equal
windows have equal anchors, so a window can repeat only if its anchor does.  Anchors are a few hundredths of all places.
They are dealt by hash as packed, compressed arrays, one row for each block of documents and range of hashes; what
repeats within a block is settled there and sent on once, so a passage that fills a third of the table costs one entry
per block, not one per document.  Hashes are cut to 48 bits on the way: a false repeat costs work later, never a wrong
result, because later steps compare full hashes or bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .kernels import U64, Words, blocks, byte_symbols, flat_text, gram_hashes, mix, ragged, sliding_min

#: Bytes of text in a block.  Arrays are of units, so where these are bytes a block is smaller: a worker's memory is about 120 bytes a unit.
BLOCK, BYTE_BLOCK = 4 << 20, 1 << 20
#: Packed rows on their way back to documents.
PACKED = "bucket int, data binary"
_HIDE = U64(0xFFFF)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, as planes of bytes, compressed."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c.astype(np.int64, copy=False).view(np.uint8).reshape(n, 8).T).tobytes() for c in map(_wide, columns))
    return n.to_bytes(4, "little") + len(columns).to_bytes(1, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _wide(c: np.ndarray) -> np.ndarray:
    return c.view(np.int64) if c.dtype == U64 else c.astype(np.int64)


def unpack(data: bytes) -> np.ndarray:
    """The arrays again, one to a row."""
    n, k = int.from_bytes(data[:4], "little"), data[4]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=8 * n * k), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(k, n)


class Units:
    """Units of a block of documents: hashes, and where each document's begin."""

    def __init__(self, kind: str, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        if kind == "words":
            self.words = Words(data, offsets)
            self.symbols, self.bounds = self.words.hash, self.words.bounds
        else:
            self.symbols, self.bounds = byte_symbols(data), offsets

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of full windows, and the number of each one's document in the block."""
        counts = np.maximum(np.diff(self.bounds) - window + 1, 0)
        return ragged(self.bounds[:-1], counts), np.repeat(np.arange(len(counts)), counts)

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, their documents, the hash of each one's anchor; and all places of anchors with their grams' hashes."""
        starts, doc = self.windows(window)
        grams = gram_hashes(self.symbols, gram) & ~_HIDE
        if not len(starts):
            return starts, doc, np.zeros(0, dtype=U64), starts, grams
        width = window - gram + 1
        least = sliding_min(grams, width)
        chosen = np.zeros(len(grams) + width - 1, dtype=U64)
        chosen[width - 1 + starts] = least[starts]
        # The greatest minimum of the windows that hold a gram is that gram's hash if it is one window's anchor.
        most = ~sliding_min(~chosen, width)
        places = np.flatnonzero((most == grams) & (most > 0))
        return starts, doc, least[starts], places, grams


def _deal(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """A part for each key.  Anchors are minima, which crowd near zero, so they are mixed first."""
    return ((mix(keys) >> U64(40)) * U64(n_parts) >> U64(24)).astype(np.int64)


def _anchor_rows(kind: str, window: int, gram: int, n_parts: int, across: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BYTE_BLOCK if kind == "bytes" else BLOCK):
            units = Units(kind, *flat_text(block.column("text")))
            _, _, _, places, grams = units.anchors(window, gram)
            if not len(places):
                continue
            ids = block.column("doc_id").to_numpy()
            doc = ids[np.searchsorted(units.bounds, places, side="right") - 1]
            keys = grams[places]
            order = np.lexsort((doc, keys, _deal(keys, n_parts)))
            keys, doc = keys[order], doc[order]
            first = np.ones(len(keys), dtype=bool)
            first[1:] = keys[1:] != keys[:-1]
            fresh = first.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            group = np.cumsum(first) - 1
            several = np.bincount(group[fresh] if across else group) > 1
            known = several[group] & fresh
            once = first  # one entry for each key of the block; document -1 where the block has settled it
            yield _rows(keys[once], np.where(several, -1, doc[once]), keys[known], doc[known], n_parts)

    return run


def _rows(keys, doc, known_keys, known_doc, n_parts) -> pa.RecordBatch:
    part, data, settled = [], [], []
    at = _deal(keys, n_parts)
    for p, a, b in _runs(at):
        part.append(p)
        data.append(pack(keys[a:b], doc[a:b]))
        settled.append(False)
    if len(known_keys):
        part.append(int(known_keys[0] >> U64(17)) % n_parts)
        data.append(pack(known_keys, known_doc))
        settled.append(True)
    return pa.RecordBatch.from_arrays([pa.array(part, type=pa.int32()), pa.array(data, type=pa.binary()), pa.array(settled)], ["part", "data", "settled"])


def _runs(values: np.ndarray):
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, dtype=np.int64)
    return zip(values[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(values)).tolist())


def by_document(doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each document, its columns packed."""
    order = np.argsort(doc, kind="stable")
    doc, columns = doc[order], [c[order] for c in columns]
    ids, packed = [], []
    for d, a, b in _runs(doc):
        ids.append(d)
        packed.append(pack(*[c[a:b] for c in columns]))
    return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(packed, type=pa.binary())], ["doc_id", "data"])


def by_bucket(n_buckets: int, doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of documents, ids and columns packed: few rows, however many documents they are for."""
    bucket = (mix(doc.astype(np.int64).view(U64)) % U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in (doc, *columns)]
    found = [(k, pack(*[c[a:b] for c in columns])) for k, a, b in _runs(bucket)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], type=pa.int32()), pa.array([x for _, x in found], type=pa.binary())], ["bucket", "data"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of some buckets as one row for each document."""
    rows = [unpack(x) for batch in batches for x in batch.column("data").to_pylist()]
    if rows:
        doc, *columns = np.concatenate(rows, axis=1)
        yield by_document(doc, *columns)


def _repeated(n_buckets: int):
    return lambda batches: _repeated_rows(batches, n_buckets)


def _repeated_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the entries of a range of hashes, those that two blocks share; and what blocks have settled themselves."""
    keys, doc = [], []
    for batch in batches:
        for data, settled in zip(batch.column("data").to_pylist(), batch.column("settled").to_pylist()):
            k, d = unpack(data)
            if settled:
                yield by_bucket(n_buckets, d, k)
            else:
                keys.append(k.view(U64))
                doc.append(d)
    if keys:
        keys, doc = np.concatenate(keys), np.concatenate(doc)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        same = np.zeros(len(keys), dtype=bool)
        same[1:] = keys[1:] == keys[:-1]
        hit = same.copy()
        hit[:-1] |= same[1:]
        hit &= doc >= 0
        if hit.any():
            yield by_bucket(n_buckets, doc[hit], keys[hit])


def repeated_anchors(docs: DataFrame, kind: str, window: int, gram: int, *, across: bool) -> DataFrame:
    """bucket and packed pairs of document and hash of an anchor that occurs again: in another document, or (not `across`) anywhere else."""
    n = shared.parts(docs.sparkSession)
    rows = docs.mapInArrow(_anchor_rows(kind, window, gram, 2 * n, across), "part int, data binary, settled boolean")
    return rows.repartition(n, "part").mapInArrow(_repeated(n), PACKED)


def with_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the packed rows of `found` for each, as an array (null: none)."""
    n = shared.parts(docs.sparkSession)
    grouped = found.repartition(n, "bucket").mapInArrow(_together, "doc_id bigint, data binary").select("doc_id", F.array("data").alias("found"))
    return docs.join(grouped.hint("shuffle_hash"), "doc_id", "left")


def gathered(column: pa.Array, i: int, k: int) -> np.ndarray:
    """The packed rows of document i in one piece."""
    rows = column[i].as_py()
    return np.concatenate([unpack(x) for x in rows], axis=1) if rows else np.zeros((k, 0), dtype=np.int64)


def candidate_windows(units: Units, window: int, gram: int, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the block's windows whose anchor occurs again, and their documents."""
    starts, doc, least, _, _ = units.anchors(window, gram)
    keep = np.zeros(len(starts), dtype=bool)
    has = np.flatnonzero(np.asarray(found.is_valid()))
    low, high = np.searchsorted(doc, has), np.searchsorted(doc, has, side="right")
    for i, a, b in zip(has.tolist(), low.tolist(), high.tolist()):
        if a < b:
            keep[a:b] = np.isin(least[a:b], gathered(found, i, 1)[0].view(U64))
    return starts[keep], doc[keep]


def contexts(units: Units, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Candidate windows by the place of their anchor: its hash and place, the first window's start, the number of windows."""
    all_starts, _, least, places, grams = units.anchors(window, gram)
    least = least[np.searchsorted(all_starts, starts)]
    k = np.searchsorted(places, starts)
    wrong = grams[places[k]] != least
    while wrong.any():
        k[wrong] += 1
        wrong = grams[places[k]] != least
    place = places[k]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(starts) else np.zeros(0, dtype=bool)
    cut = np.flatnonzero(new)
    return least[cut], place[cut], starts[cut], np.diff(np.append(cut, len(starts)))
