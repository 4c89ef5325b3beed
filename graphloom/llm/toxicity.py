"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained with numpy from confirmed toxic texts (P) and texts
without regard to any label (U).  The risk that it minimises is prior * R(P, +) + max(0, R(U, -) - prior * R(P, -)): the
unlabelled risk, corrected by the class prior for the positives hidden among them, and kept non-negative; where a batch's
correction is negative, its gradient is reversed.  The prior is the share of toxic rows among the labelled ones that may
be learnt from.  Training uses a bounded sample (POSITIVE and UNLABELLED documents at most, the least by a hash of their
id); scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .kernels import BASE, INVERSE, U64, blocks, byte_symbols, flat_text, mix, powers, ragged
from .statistics import folded_words

#: Documents that are learnt from, at most; buckets; places in a text's set of features that one sample row may take.
POSITIVE, UNLABELLED, BUCKETS, PREFIXES = 4000, 12000, 1 << 18, (4, 5)
EPOCHS, RATE, DECAY, DOUBT = 30, 0.5, 1e-5, 2.5
ALIKE = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document's words and of the first bytes of longer ones; and where each document's begin."""
    words, low = folded_words(data, offsets)
    n = len(offsets) - 1
    if not len(words.start):
        return np.zeros(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    doc = np.repeat(np.arange(n), np.diff(words.bounds))
    total = np.zeros(len(low) + 1, dtype=U64)
    np.cumsum(byte_symbols(low) * powers(BASE, len(low)), out=total[1:])
    inverse = powers(INVERSE, len(low) + 1)
    keys, docs = [words.hash], [doc]
    for k in PREFIXES:
        some = words.stop - words.start > k
        at = words.start[some]
        keys.append(mix((total[at + k] - total[at]) * inverse[at] + U64(k << 20)))
        docs.append(doc[some])
    packed = np.unique((np.concatenate(docs).astype(U64) << U64(32)) | (np.concatenate(keys) >> U64(40)) % U64(BUCKETS))
    return (packed & U64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(packed >> U64(32), np.arange(n + 1).astype(U64))


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


class Classifier:
    """score = 1 / (1 + exp(-(bias + sum of the weights of a document's features)))."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS, dtype=np.float32)
        self.bias = 0.0

    def margin(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sum(self.weights[buckets].astype(float), bounds) + self.bias

    def score(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(buckets, bounds), -30, 30)))


def distinct(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Documents without copies and near copies, so that these don't count as evidence.

    Of documents whose features agree in the three that hash least, one is dropped if its features and those of one kept
    are alike to ALIKE at least (Jaccard similarity); others stay.
    """
    groups: dict[bytes, list[np.ndarray]] = {}
    for d in docs:
        groups.setdefault(np.sort(mix(d.astype(U64)))[:3].tobytes(), []).append(d)
    kept, mark = [], np.zeros(BUCKETS, dtype=np.int64)
    for group in groups.values():
        if not len(group[0]):
            kept.append(group[0])
            continue
        size = np.array([len(d) for d in group])
        flat, first, stays = np.concatenate(group), np.cumsum(size) - size, np.ones(len(group), dtype=bool)
        for i, d in enumerate(group):
            if stays[i]:
                kept.append(d)
                mark[d] = 1
                both = np.add.reduceat(mark[flat], first)
                mark[d] = 0
                stays &= both < ALIKE * (len(d) + size - both)
    return kept


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """Minimises the non-negative positive-unlabelled risk of the logistic loss by adaptive stochastic gradients."""
    model = Classifier()
    model.bias = float(np.log(max(prior, 1e-4) / (1 - min(prior, 0.99))))
    if not positive or not unlabelled:
        return model
    positive, unlabelled = distinct(positive), distinct(unlabelled)
    # Positives make up `prior` of the unlabelled texts, so a sure sign is up to 1 / prior times likelier among positives.
    # Features that fall short of half of that, or of chance by less than DOUBT deviations, stay at zero.
    count = lambda docs: np.bincount(np.concatenate(docs), minlength=BUCKETS)
    p, u = count(positive), count(unlabelled)
    expected = len(positive) * (u + 1) / (len(unlabelled) + 1)
    useful = (p > max(1.5, 0.5 / prior) * expected) & (p - expected > DOUBT * np.sqrt(expected + 1))
    positive, unlabelled = ([x[useful[x]] for x in docs] for docs in (positive, unlabelled))
    rng, seen = np.random.default_rng(5), np.full(BUCKETS, 1e-8)
    n_batches = max(4, len(unlabelled) // 512)
    for _ in range(EPOCHS):
        for some_p, some_u in zip(np.array_split(rng.permutation(len(positive)), n_batches), np.array_split(rng.permutation(len(unlabelled)), n_batches)):
            if not len(some_p) or not len(some_u):
                continue
            docs = [positive[i] for i in some_p] + [unlabelled[i] for i in some_u]
            bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
            buckets = np.concatenate(docs)
            s = model.score(buckets, bounds)
            k = len(some_p)
            # d loss(z, +) / dz = s - 1 and d loss(z, -) / dz = s.
            negative = -np.log1p(-np.clip(s, 0, 1 - 1e-9))
            correction = negative[k:].mean() - prior * negative[:k].mean()
            slope = np.zeros(len(s))
            if correction >= 0:
                slope[:k] = prior * (s[:k] - 1) / k - prior * s[:k] / k
                slope[k:] = s[k:] / len(some_u)
            else:
                slope[:k] = prior * s[:k] / k
                slope[k:] = -s[k:] / len(some_u)
            step = np.bincount(buckets, weights=np.repeat(slope, np.diff(bounds)), minlength=BUCKETS) + DECAY * model.weights
            seen += step**2
            model.weights -= (RATE * step / np.sqrt(seen)).astype(np.float32)
            model.bias -= RATE * 0.1 * slope.sum()
    margin = lambda docs: model.margin(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    model.bias -= _cut(margin(positive), margin(unlabelled), prior)
    return model


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin that divides best by the same corrected risk for errors counted as 0 or 1; midway between two texts'."""
    steps = np.unique(np.concatenate((positive, unlabelled)))
    cuts = np.append((steps[1:] + steps[:-1]) / 2, steps[-1] + 1)
    missed = np.searchsorted(np.sort(positive), cuts) / len(positive)
    flagged = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
    return float(cuts[len(risk) - 1 - np.argmin(risk[::-1])])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 2 << 20):
        buckets, bounds = features(*flat_text(block.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(buckets.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([block.column("kind"), lists], ["kind", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int]) -> Classifier:
    """Trains on the driver from the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y IS NOT NULL")
    known = known.where(~shared.in_fold(*fold))
    share = known.agg(F.avg("y").alias("p"), F.sum("y").alias("n")).first()
    prior = min(max(share["p"] or 0.0, 1e-3), 0.5)
    order = F.xxhash64("doc_id")
    # Of exact copies one is drawn from, so that large groups leave room for other texts.
    texts = docs.where(~shared.in_fold(*fold)).select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    one = lambda df: df.groupBy("hash", "size").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    positive = one(texts.join(known.where("y = 1").select("doc_id").distinct(), "doc_id")).orderBy(order).limit(POSITIVE).select("doc_id", F.lit(1).alias("kind"))
    unlabelled = one(texts).orderBy(order).limit(UNLABELLED).select("doc_id", F.lit(0).alias("kind"))
    sample = docs.join(F.broadcast(positive.unionByName(unlabelled)), "doc_id").select("kind", "text")
    table = sample.mapInArrow(_featured, "kind int, x array<int>").toArrow()  # POSITIVE + UNLABELLED rows at most
    kind, x = table.column("kind").to_numpy(), [np.asarray(v, dtype=np.int64) for v in table.column("x").to_pylist()]
    return train([v for k, v in zip(kind, x) if k], [v for k, v in zip(kind, x) if not k], prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Positives are rows of `labels` with 1 whose crc32(doc_id as text) mod fold[0] is not fold[1]; labels of the others
    are never read.  Null labels are left out; null text counts as empty; empty text gets the score of no evidence.
    Other columns are ignored.  Without positives all scores are that of no evidence.
    """
    docs = shared.documents(docs)
    model = fit(docs, labels, label, fold)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2 << 20):
            score = model.score(*features(*flat_text(block.column("text"))))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = docs.mapInArrow(scored, "doc_id bigint, score double")
    return out.select("doc_id", shared.in_fold(*fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


__all__ = ["Classifier", "features", "ragged", "toxicity_scores", "train"]
