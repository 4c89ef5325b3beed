"""Jaccard, Sorensen, overlap and cosine similarity of neighbourhoods; first, second and <name>_coeff."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from . import wedges

NAMES = ("jaccard", "sorensen", "overlap", "cosine")


def _score(name: str, weighted: bool) -> Column:
    both, a, b = F.col("both"), F.col("wa"), F.col("wb")
    if name == "jaccard":
        down = a + b - both
    elif name == "sorensen":
        both, down = 2 * both, a + b
    elif name == "overlap":
        down = F.least(a, b)
    elif weighted:  # norms over the intersection only
        return F.when(F.col("n") > 0, F.col("dot") / (F.sqrt("na") * F.sqrt("nb"))).otherwise(F.lit(float("nan")))
    else:
        return F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    return F.when(down > 0, both / down).otherwise(0.0)


def _whole(name: str, weighted: bool):
    """The sums that a score needs, and _score over arrays, for pairs with a common neighbour (so n > 0)."""
    both = "both" if weighted else "n"
    if name == "cosine":
        if weighted:
            return ("n", "dot", "na", "nb"), lambda wa, wb, n, dot, na, nb: dot / (np.sqrt(na) * np.sqrt(nb))
        return ("n",), lambda wa, wb, n: np.ones(len(n))

    def score(wa, wb, **sums):
        up = sums[both].astype(np.float64)
        down = {"jaccard": lambda: wa + wb - up, "sorensen": lambda: wa + wb, "overlap": lambda: np.minimum(wa, wb)}[name]()
        return np.where(down > 0, (2 * up if name == "sorensen" else up) / down, 0.0)

    return (("n", "both") if weighted else ("n",)), score


def _shared(hits: DataFrame) -> DataFrame:
    """Sums over common neighbours, from rows first, second, x, y (the two weights)."""
    return hits.groupBy("first", "second").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.least("x", "y")).alias("both"), F.sum(F.col("x") * F.col("y")).alias("dot"),
        F.sum(F.col("x") ** 2).alias("na"), F.sum(F.col("y") ** 2).alias("nb"),
    )


def _scored(g: Graph, pairs: DataFrame, found: DataFrame, e: DataFrame, name: str, weighted: bool) -> DataFrame:
    total = e.groupBy("src").agg(F.sum("weight").alias("w"))
    out = pairs.join(found, ["first", "second"], "left").join(total.toDF("first", "wa"), "first", "left").join(total.toDF("second", "wb"), "second", "left")
    out = out.na.fill(0, ["n"]).na.fill(0.0, ["both", "dot", "na", "nb", "wa", "wb"])
    return out.select("first", "second", _score(name, weighted).alias(f"{name}_coeff"))


def _edges(g: Graph, use_weight: bool) -> DataFrame:
    if g.directed:
        raise ValueError("similarity needs an undirected graph")
    if g.has_edge_mask():
        raise ValueError("similarity does not take an edge mask")
    e = g.weighted_edges if use_weight else g.active.withColumn("weight", F.lit(1.0))
    if use_weight and g.multi:
        raise ValueError("weighted similarity needs a graph without parallel edges")
    return e.select("src", "dst", "weight")


def similarity(g: Graph, name: str, pairs: DataFrame | None = None, *, use_weight: bool = False) -> DataFrame:
    """Scores of pairs(first, second); without pairs those of all two-hop neighbours, (v, v) included."""
    e = _edges(g, use_weight)
    if pairs is None:
        return wedges.all_scores(e, f"{name}_coeff", *_whole(name, use_weight))
    asked = pairs.select(F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second")).distinct()
    hits = asked.join(e.toDF("first", "nbr", "x"), "first").join(e.toDF("second", "nbr", "y"), ["second", "nbr"])
    return _scored(g, asked, _shared(hits), e, name, use_weight)


def all_pairs(g: Graph, name: str, vertices: DataFrame | None = None, *, use_weight: bool = False, topk: int | None = None) -> DataFrame:
    """Scores of all pairs with a common neighbour, in both orders and never (v, v); topk keeps the best by score, first, second."""
    e = _edges(g, use_weight)
    out = wedges.all_scores(e, f"{name}_coeff", *_whole(name, use_weight), firsts=vertices, loops=False, topk=topk)
    return out if topk is None else out.orderBy(F.desc(f"{name}_coeff"), "first", "second").limit(topk)


def jaccard(g: Graph, pairs: DataFrame | None = None, **options) -> DataFrame:
    return similarity(g, "jaccard", pairs, **options)


def sorensen(g: Graph, pairs: DataFrame | None = None, **options) -> DataFrame:
    return similarity(g, "sorensen", pairs, **options)


def overlap(g: Graph, pairs: DataFrame | None = None, **options) -> DataFrame:
    return similarity(g, "overlap", pairs, **options)


def cosine(g: Graph, pairs: DataFrame | None = None, **options) -> DataFrame:
    return similarity(g, "cosine", pairs, **options)


jaccard_coefficient, sorensen_coefficient, overlap_coefficient, cosine_coefficient = jaccard, sorensen, overlap, cosine
