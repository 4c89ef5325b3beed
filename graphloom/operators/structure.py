"""Degrees, weight sums, neighbourhoods and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prims
from ..sources.graph import Graph
from . import hops


def degrees(g: Graph, vertices: DataFrame | None = None) -> DataFrame:
    """vertex, in_degree, out_degree, degree (their sum, so twice the neighbours of an undirected graph), zeros included."""
    ends = g.active.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("o")))).alias("e"))
    found = ends.groupBy("e.vertex").agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))
    who = g.vertices.select("vertex") if vertices is None else vertices.select("vertex")
    out = who.join(found, "vertex", "left").na.fill(0, ["in_degree", "out_degree"])
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_centrality(g: Graph, normalized: bool = True) -> DataFrame:
    n = g.number_of_vertices()
    by = max(1, n - 1) if normalized else 1
    return degrees(g).select("vertex", (F.col("degree") / by).alias("degree_centrality"))


def weight_sums(g: Graph, side: str = "out", reducer=F.sum) -> DataFrame:
    """vertex, value: weights of outgoing or incoming edges added (or reduced otherwise, as with F.max)."""
    key = "src" if side == "out" else "dst"
    found = g.weighted_edges.groupBy(F.col(key).alias("vertex")).agg(reducer("weight").alias("value"))
    return prims.on_vertices(g.vertices.select("vertex"), found)


def total_edge_weight(g: Graph) -> DataFrame:
    return g.weighted_edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))


def count_multi_edges(edges: DataFrame) -> DataFrame:
    """Edges beyond the first of each (src, dst)."""
    return edges.groupBy("src", "dst").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_multi_edges"))


def count_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").agg(F.count(F.lit(1)).alias("n_self_loops"))


def two_hop_neighbors(g: Graph, start: DataFrame | None = None) -> DataFrame:
    """first, second: distinct ends of two-edge paths, both orders and (v, v) included."""
    e = prims_pairs(g)
    a = e if start is None else e.join(start.select(F.col("vertex").alias("src")), "src", "left_semi")
    return a.toDF("first", "mid").join(e.toDF("mid", "second"), "mid").select("first", "second").distinct()


def prims_pairs(g: Graph) -> DataFrame:
    return g.active.select("src", "dst").distinct()


def k_hop_nbrs(g: Graph, start: DataFrame, k: int) -> DataFrame:
    """start, vertex: reached by exactly k expansions of the frontier."""
    if not k:
        return start.select(F.col("vertex").alias("start"), "vertex").distinct()
    return hops.reached(prims_pairs(g), start, k)


def select_random_vertices(g: Graph, n: int, seed: int = 42) -> DataFrame:
    """n vertices without replacement, the same for a seed whatever the partitioning."""
    return g.vertices.select("vertex").orderBy(F.xxhash64(F.lit(seed), "vertex"), "vertex").limit(n)


def induced_subgraph(g: Graph, seeds: DataFrame) -> DataFrame:
    """Edges with both ends among seeds(vertex); with a column `seed_set` the rule holds in each set, and sets stay apart."""
    e = g.active
    keys = ["seed_set"] if "seed_set" in seeds.columns else []
    some = seeds.select("vertex", *keys).distinct()
    left = e.join(some.withColumnRenamed("vertex", "src"), "src")
    return left.join(some.withColumnRenamed("vertex", "dst"), ["dst", *keys]).select(*keys, *e.columns)


def ego_graph(g: Graph, seeds: DataFrame, radius: int = 1, center: bool = True) -> DataFrame:
    """seed and the edges among vertices within `radius` hops of each seed (without the seed itself unless center)."""
    e = prims_pairs(g)
    front = seeds.select(F.col("vertex").alias("seed"), "vertex").distinct()
    every = front
    for _ in range(radius):
        front = prims.expand_frontier(front, e, ["seed"]).select("seed", F.col("dst").alias("vertex")).distinct().join(every, ["seed", "vertex"], "left_anti")
        every = every.unionByName(front)
    if not center:
        every = every.where("seed != vertex")
    return induced_subgraph(g, every.withColumnRenamed("seed", "seed_set")).withColumnRenamed("seed_set", "seed")


def lookup_edges(g: Graph, wanted: DataFrame) -> DataFrame:
    """edge_id, edge_type, src, dst for wanted(edge_id, edge_type); -1 where there is no such edge."""
    found = g.edges.select("edge_id", "edge_type", "src", "dst")
    return wanted.join(found, ["edge_id", "edge_type"], "left").na.fill(-1, ["src", "dst"])
