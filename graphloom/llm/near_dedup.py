"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document is its set of distinct word shingles. Documents with equal sets form a class first, so that copies never meet
as pairs. Each class gets a signature of SYMBOLS minima of b = 16 bits. Two signatures that differ in at most `radius`
symbols must, split into radius // 2 + 1 chunks, agree in one chunk but for at most 1 symbol (pigeonhole); so each chunk
is indexed once for each symbol left out, and every pair within the radius shares an index key.

Pairs within a key are never written out. Keys with the same least class make one group. A group of up to BLOCK shingles
is settled in one task: its members are compared with the one nearest to the group's majority, their leader L, on full
sets. With c = |x & L|, two members x and y in different components whose common shingles all lie in L have |x & y| <=
min(c_x, c_y). As a link needs |x & y| >= percent / 100 * max(|x|, |y|), either that bound allows a link, which sizes
tell, or x and y share at least percent / 100 * |x| - c_x shingles outside L, so that the first |x| - c_x - that + 1 of
x's, in any fixed order, hold one of the first of y's. Only such pairs are compared. A larger group is dealt over many
tasks and compared with such a leader; pairs of the first kind go on as groups of two, and members with such a shingle
in common as a group of theirs. These groups are settled in the same way until none is left. So every link between
members of a key is found, none is false, and the radius follows the threshold, so that a link at the threshold itself
is missed with a probability of MISS at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import connected_components
from .kernels import LOWER, U64, Words, blocks, flat_text, gram_hashes, mix, ragged

SYMBOLS, MISS = 32, 1e-4
#: Shingles of a group that one task settles.
BLOCK = 1 << 20
#: A signature is packed four symbols to a column.
PACKED = [f"s{i}" for i in range(SYMBOLS // 4)]
_seeds = np.random.default_rng(85).integers(1, 2**63, SYMBOLS, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def missed(radius: int, percent: int) -> float:
    """P[Binomial(SYMBOLS, 1 - percent / 100) > radius]: the share of links at the threshold that lie beyond the radius."""
    p = 1 - percent / 100
    return sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(radius + 1, SYMBOLS + 1))


def radius_of(percent: int) -> int:
    return next(r for r in range(SYMBOLS + 1) if missed(r, percent) <= MISS)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of lower-cased documents, sorted within each; and where each document's begin.

    A document with fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    words = Words(LOWER[data], offsets)
    n = np.diff(words.bounds)
    grams = gram_hashes(words.hash, k)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    found = grams[ragged(words.bounds[:-1], np.maximum(n - k + 1, 0))]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([hash_sequence(words.hash[words.bounds[i] : words.bounds[i + 1]]) for i in short], dtype=U64)
        doc, found = np.concatenate((doc, short)), np.concatenate((found, whole))
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    doc, found = doc[first], found[first]
    return found, np.searchsorted(doc, np.arange(len(n) + 1))


def hash_sequence(symbols: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, told apart from that of any longer run."""
    return mix(gram_hashes(symbols, len(symbols)) + U64(len(symbols)))[0]


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 20):
            found, bounds = shingles(*flat_text(block.column("text")), k)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            at = bounds[:-1][some]
            signature = np.zeros((len(n), SYMBOLS), dtype=np.uint16)
            set_hash = np.zeros((len(n), 2), dtype=U64)
            if len(some):
                for j, seed in enumerate(_seeds):
                    signature[some, j] = (np.minimum.reduceat(mix(found * seed), at) >> U64(7)).astype(np.uint16)
                set_hash[some, 0] = np.add.reduceat(mix(found), at)
                set_hash[some, 1] = np.add.reduceat(mix(found ^ U64(0xA5A5A5A5A5A5A5A5)), at)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    _fixed(set_hash),
                    *[pa.array(x) for x in np.ascontiguousarray(signature).view(np.int64).T],
                ],
                ["doc_id", "n_shingles", "set_hash", *PACKED],
            )

    return run


def _fixed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _symbols(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in PACKED], axis=1).view(np.uint16).reshape(-1, SYMBOLS)


def _keys(radius: int):
    """Index keys of signatures: for each chunk, the chunk without each one of its symbols."""
    chunks = np.array_split(np.arange(SYMBOLS), radius // 2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = _symbols(batch).astype(U64)
            keys = []
            for c, chunk in enumerate(chunks):
                for out in chunk:
                    key = np.full(len(symbols), (c << 8) + int(out), dtype=U64)
                    for j in chunk:
                        if j != out:
                            key = mix(key * U64(0x9E3779B97F4A7C15) + symbols[:, j])
                    keys.append(key)
            flat = np.stack(keys, axis=1).reshape(-1).view(np.int64)
            owner = pa.array(np.repeat(np.arange(len(symbols)), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("class_id").take(owner), batch.column("n_shingles").take(owner)], ["key", "class_id", "n_shingles"])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 20):
            found, bounds = shingles(*flat_text(block.column("text")), k)
            offsets = (bounds * 8).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(offsets), pa.py_buffer(found)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), packed], ["class_id", "shingles"])

    return run


class _Members:
    """Sets of a group's members side by side, by the numbers of their shingles among all of the group's."""

    def __init__(self, rows: list[bytes]):
        sets = [np.frombuffer(x, dtype=U64) for x in rows]
        self.n = np.array([len(x) for x in sets], dtype=np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.known, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.known), dtype=np.int32)

    def own(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i] + self.n[i]]

    def common(self, i: int, others: np.ndarray | None = None) -> np.ndarray:
        """Sizes of the intersections of member i with others, or with every member."""
        self.mark[self.own(i)] = 1
        if others is None:
            out = np.add.reduceat(self.mark[self.flat], self.first)
        else:
            n = self.n[others]
            out = np.add.reduceat(self.mark[self.flat[ragged(self.first[others], n)]], np.cumsum(n) - n)
        self.mark[self.own(i)] = 0
        return out

    def nearest(self) -> tuple[int, int]:
        """The member that differs least from the set of the shingles which most members have, and by how many more it agrees."""
        most = 2 * np.bincount(self.flat, minlength=len(self.known)) > len(self.n)
        score = np.add.reduceat(np.where(most, 1, -1)[self.flat], self.first)
        best = int(score.argmax())
        return best, int(score[best])

    def outside(self, leader: int, c: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Member and number of the shingles outside the leader's set by which a member may meet another, in order of members."""
        self.mark[self.own(leader)] = 1
        owner = np.repeat(np.arange(len(self.n)), self.n)
        out = np.flatnonzero(self.mark[self.flat] == 0)
        self.mark[self.own(leader)] = 0
        owner, number = owner[out], self.flat[out]
        rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(self.n)))[owner]
        some = self.n - c - np.maximum(1, -(-percent * self.n // 100) - c) + 1
        keep = rank < some[owner]
        return owner[keep], number[keep]


def settle(rows: list[bytes], components: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between members, by place, that join all components which any link joins; members of one component are joined already."""
    if len(rows) == 1:
        return []
    if len(rows) == 2:
        x, y = (np.frombuffer(r, dtype=U64) for r in rows)
        both = np.intersect1d(x, y, assume_unique=True).size
        return [(0, 1)] if 100 * both >= percent * (len(x) + len(y) - both) else []
    members, label, links = _Members(rows), np.unique(components, return_inverse=True)[1], []
    n = members.n

    def join(i: int, others: np.ndarray, both: np.ndarray) -> None:
        for j in others[100 * both >= percent * (n[others] + n[i] - both)].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]

    leader, _ = members.nearest()
    c = members.common(leader)
    join(leader, np.arange(len(rows)), c)
    if (label == label[leader]).all():
        return links
    owner, number = members.outside(leader, c, percent)
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    order = np.argsort(number, kind="stable")
    listed, begin = owner[order], np.searchsorted(number[order], np.arange(len(members.known) + 1))
    most = (100 + percent) * c // percent - n
    for i in np.flatnonzero(label != label[leader]).tolist():
        if label[i] == label[leader]:
            continue
        mine = number[first[i] : first[i + 1]]
        near = (n <= most[i]) & (n[i] <= most)  # their common shingles may all be the leader's
        near[listed[ragged(begin[mine], begin[mine + 1] - begin[mine])]] = True
        others = np.flatnonzero(near & (label != label[i]) & (100 * n >= percent * n[i]) & (100 * n[i] >= percent * n))
        if len(others):
            join(i, others, members.common(i, others))
    return links


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by runs of equal keys."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components with all links to their least members."""
    up = {x: x for link in links for x in link}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(root(x), x) for x in up if root(x) != x]


def _settled(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, ["g"]):
            found = settle([r["shingles"] for r in rows], [r["component"] for r in rows], percent)
            if found:
                stars = _stars([(rows[i]["class_id"], rows[j]["class_id"]) for i, j in found])
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in stars]), pa.array([b for _, b in stars])], ["a", "b"])

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a group: its member nearest to the majority of the part."""
    for (g, _), rows in _grouped(batches, ["g", "salt"]):
        best, score = _Members([r["shingles"] for r in rows]).nearest()
        yield pa.RecordBatch.from_pydict({"g": [g], "leader": [rows[best]["class_id"]], "score": [score]})


def _star(percent: int):
    """Members compared with the leader's set, which comes first in each part of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leader, own = None, -1, np.zeros(0, dtype=U64)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                mine = np.frombuffer(row["shingles"], dtype=U64)
                if row["leads"]:
                    part, leader, own = (row["g"], row["salt"]), row["class_id"], mine
                    continue
                assert part == (row["g"], row["salt"])
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                inside = own[place] == mine
                n, c = len(mine), int(inside.sum())
                link = 100 * c >= percent * (n + len(own) - c)
                outside = mine[~inside]
                some = outside[: len(outside) - max(1, -(-percent * n // 100) - c) + 1]
                out.append((row["g"], leader, row["class_id"], n, c, link, some.view(np.int64).tolist()))
            if out:
                g, lead, ids, n, c, link, some = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, type=pa.int64()) for x in (g, lead, ids, n, c)), pa.array(link, type=pa.bool_()), pa.array(some, type=pa.list_(pa.int64()))],
                    ["g", "leader", "class_id", "n", "c", "link", "outside"],
                )

    return run


STAR = "g bigint, leader bigint, class_id bigint, n bigint, c bigint, link boolean, outside array<bigint>"


def _compared(big: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of large groups (g, class_id, component, total) against their group's leader."""
    n = shared.parts(big.sparkSession)
    parts = F.ceil(F.col("total") / BLOCK)
    dealt = big.select("g", "class_id", parts.alias("parts"), F.pmod(F.xxhash64("class_id"), parts).alias("salt")).join(sets, "class_id")
    dealt = shared.written(dealt, "near-dealt")
    columns = ["g", "salt", "class_id", "shingles"]
    best = dealt.select(*columns).repartition(n, "g", "salt").sortWithinPartitions("g", "salt").mapInArrow(_leaders, "g bigint, leader bigint, score bigint")
    best = best.groupBy("g").agg(F.max_by("leader", F.struct("score", "leader")).alias("leader"))
    lead = dealt.join(best, (dealt["g"] == best["g"]) & (dealt["class_id"] == best["leader"])).select(
        dealt["g"], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "class_id", "shingles", F.lit(True).alias("leads")
    )
    rows = lead.unionByName(dealt.select(*columns, F.lit(False).alias("leads"))).repartition(n, "g", "salt")
    return shared.written(rows.sortWithinPartitions("g", "salt", F.desc("leads")).mapInArrow(_star(percent), STAR), "near-star")


def _left_over(star: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Groups (g, class_id, n_shingles, component) of the members of large groups that may still have a link to another component."""
    at = _labelled(star.where("class_id != leader"), labels)
    lead = _labelled(star.where("class_id = leader").select("g", "class_id"), labels).select("g", F.col("component").alias("of_leader"))
    at = at.join(lead, "g").withColumn("apart", F.col("component") != F.col("of_leader"))
    at = at.join(at.where("apart").select("g").distinct().hint("merge"), "g", "left_semi")
    least, most = F.ceil(F.col("n") * percent / 100), F.floor((100 + percent) * F.col("c") / percent) - F.col("n")
    x = at.where(F.col("apart") & (least <= most)).select("g", "class_id", "component", "n", "c", F.explode(F.sequence(least, most)).alias("size"))
    x, y = x.alias("x"), at.alias("y")
    pairs = x.join(
        y, F.expr(f"x.g = y.g AND x.size = y.n AND x.component != y.component AND {100 + percent} * least(x.c, y.c) >= {percent} * (x.n + y.n)")
    ).select(F.array(*(F.struct(*(F.col(f"{t}.{c}").alias(c) for c in ("class_id", "n", "component"))) for t in "xy")).alias("both"))
    ids = F.array_sort(F.col("both.class_id"))
    pairs = pairs.select(F.xxhash64(F.lit("pair"), ids[0], ids[1]).alias("g"), F.explode("both").alias("m")).select("g", "m.*").distinct()
    shared_outside = at.select(F.explode("outside").alias("z"), "g", "class_id", "n", "component").select(F.xxhash64("g", "z").alias("g"), "class_id", "n", "component")
    return pairs.unionByName(shared_outside).withColumnRenamed("n", "n_shingles")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("class_id"))
    named = labels.select(F.col("id").alias("class_id"), F.col("component").alias("found"))
    return rows.join(named.hint("merge"), "class_id", "left").withColumn("component", F.coalesce("found", "class_id")).drop("found")


def _components(groups: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """id, component of every class with a link, by links between members of a group (g, class_id, n_shingles); None without links."""
    n = shared.parts(docs.sparkSession)
    need = groups.select(F.col("class_id").alias("doc_id")).distinct()
    texts = docs.join(need.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = shared.written(texts.mapInArrow(_set_rows(k), "class_id bigint, shingles binary"), "near-sets")
    links, labels = None, None
    groups = groups.withColumn("component", F.col("class_id"))
    for level in range(1000):
        large = groups.groupBy("g").agg(F.sum("n_shingles").alias("total"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        large = shared.written(large.where(F.col("total") > BLOCK).where("lo < hi").select("g", "total"), "near-large")
        some = not large.isEmpty()
        small = groups.join(large.hint("merge"), "g", "left_anti") if some else groups
        found = small.join(sets, "class_id").select("g", "class_id", "component", "shingles")
        found = found.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_settled(percent), "a bigint, b bigint")
        if some:
            star = _compared(groups.join(large.hint("merge"), "g"), sets, percent)
            found = found.unionByName(star.where("link AND class_id != leader").select(F.col("leader").alias("a"), F.col("class_id").alias("b")))
        found = shared.written(found, "near-links")
        links = found if links is None else links.unionByName(found)
        if not links.isEmpty():
            labels = connected_components(links)
        if not some:
            return labels
        groups = shared.written(_left_over(star, labels, percent), "near-groups")
    raise RuntimeError("groups of near copies were not settled")


def near_groups(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs, by links of 100 * |a & b| >= percent * |a | b|.

    Null or empty texts have no shingles and no links.  doc_id names a document: rows that repeat one must repeat its
    text, and each of them is returned.  Of a component the smallest doc_id stays.  Other columns are ignored.
    """
    docs = shared.documents(docs)
    signed = shared.written(
        docs.mapInArrow(_signed(shingle_words), "doc_id bigint, n_shingles bigint, set_hash binary, " + ", ".join(f"{c} bigint" for c in PACKED)), "near-signed"
    )
    some = signed.where("n_shingles > 0")
    classes = shared.written(
        some.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), *[F.first(c).alias(c) for c in PACKED]),
        "near-classes",
    )
    keys = classes.select("class_id", "n_shingles", *PACKED).mapInArrow(_keys(radius_of(percent)), "key bigint, class_id bigint, n_shingles bigint")
    # A group is named by the least class of its keys, so that classes which meet in many keys meet in few groups.
    crowds = keys.groupBy("key").agg(F.min("class_id").alias("g"), F.max("class_id").alias("last")).where("g < last").select("key", "g")
    groups = shared.written(keys.join(crowds.hint("merge"), "key").select("g", "class_id", "n_shingles").distinct(), "near-groups")
    labels = _components(groups, docs, shingle_words, percent)
    members = signed.select("doc_id", "n_shingles", "set_hash").join(classes.select("set_hash", "class_id").hint("merge"), "set_hash", "left")
    if labels is not None:
        members = members.join(labels.select(F.col("id").alias("class_id"), "component").hint("merge"), "class_id", "left")
    else:
        members = members.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "class_id", "doc_id")
    return members.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns."""
    lost = near_groups(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_lost"), "left_anti")
