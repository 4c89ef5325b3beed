"""Quality scores: random Fourier features, ridge regression by normal equations, isotonic calibration.

Statistics of each text (`statistics`) are standardised and mapped to cos(W x + b), with Gaussian W, whose inner products
approximate a Gaussian kernel.  Each partition sums its part of the normal equations, Spark adds these sums cell by cell,
and only the finished D x D system (a size that doesn't depend on the input) reaches the driver.  Raw scores are then
calibrated: labelled rows are counted in bins of equal width and pooled until the share of good ones never falls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .kernels import blocks, flat_text
from .statistics import NAMES, statistics

FEATURES, WIDTH, RIDGE, BINS = 192, 3.0, 1e-3, 512


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of features, with the constant last
    edges: np.ndarray  # raw scores
    shares: np.ndarray  # of good documents at these

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features((x - self.centre) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.shares)


def features(x: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(4)
    w = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(np.clip(x, -8, 8) @ w + shift) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    data = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return data.reshape(batch.num_rows, len(NAMES))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 2 << 20):
        x = statistics(*flat_text(block.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of each row's text."""
    return shared.documents(docs).mapInArrow(_measured, "doc_id bigint, x array<double>")


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value by weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            p = pools[-1]
            p[0] = (p[0] * p[1] + v * w) / (p[1] + w) if p[1] + w else (p[0] + v) / 2
            p[1] += w
            p[2] += n
    return np.concatenate([np.full(n, v) for v, _, n in pools]) if pools else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """A model from rows (x, y) with y 0 or 1; without rows, or with one kind only, every score is that kind's share."""
    n = len(NAMES)
    sums = labelled.select(F.posexplode("x").alias("i", "v"), "y").groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = {r["i"]: (r["m"], r["s"]) for r in sums.collect()}  # one row for each statistic
    centre = np.array([moments.get(i, (0, 1))[0] for i in range(n)])
    spread = np.array([max(moments.get(i, (0, 1))[1], 1e-6) for i in range(n)])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = features((_matrix(batch) - centre) / spread)
                total += z.T @ np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False).astype(float)[:, None]])
        row, column = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array((row * total.shape[1] + column).ravel()), pa.array(total.ravel())], ["cell", "v"])

    added = labelled.mapInArrow(cells, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    system = np.zeros((FEATURES + 1) * (FEATURES + 2))
    system[added["cell"].to_numpy()] = added["v"].to_numpy()
    system = system.reshape(FEATURES + 1, FEATURES + 2)
    rows = max(system[-1, -2], 1.0)
    weights = np.linalg.solve(system[:, :-1] / rows + RIDGE * np.eye(FEATURES + 1), system[:, -1] / rows)
    model = Model(centre, spread, weights, np.array([0.0]), np.array([0.5]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, every = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                at = np.clip(((model.raw(_matrix(batch)) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                every += np.bincount(at, minlength=BINS)
                good += np.bincount(at, weights=batch.column("y").to_numpy(zero_copy_only=False).astype(float), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(good), pa.array(every)], ["bin", "good", "n"])

    counts = labelled.mapInArrow(binned, "bin bigint, good double, n double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    counts = counts.where("n > 0").orderBy("bin").toPandas()  # BINS rows at most
    if len(counts):
        weight = counts["n"].to_numpy()
        model.shares = isotonic(counts["good"].to_numpy() / weight, weight)
        model.edges = (counts["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, label: str = "quality", fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Labels are learnt from rows of `labels` (doc_id, 0 or 1) whose crc32(doc_id as text) mod fold[0] is not fold[1];
    null labels are left out, and of several labels of a document each counts.  Null text counts as empty, and empty
    text is scored like any other.  Other columns are ignored.  Without any label the score is 0.5.
    """
    rows = shared.written(measured(docs), "quality-measured")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    labelled = shared.written(rows.join(known.where(~shared.in_fold(*fold)), "doc_id").select("x", "y"), "quality-labelled")
    model = fit(labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id bigint, score double")
    return out.select("doc_id", shared.in_fold(*fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    lost = quality_scores(docs, labels, **options).where("predicted = 0").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_lost"), "left_anti")
