"""Cores, trusses and spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prims
from ..plans.runtime import FailedToConvergeError, cut, release, scoped
from ..sources.graph import Graph
from .components import weakly_connected_components


@scoped
def core_number(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """vertex, core_number: the fixed point of each vertex's h-index over its neighbours' values, from the degrees down.

    After the first round only neighbours of vertices whose value fell are looked at again.
    """
    edges = cut(prims.neighbours(g.active.unionByName(prims.reverse(g.active))), by="src")
    degree = edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).cast("long").alias("value"))
    state = cut(prims.on_vertices(g.vertices.select("vertex"), degree, 0).withColumnRenamed("value", "core_number"))
    touched = None
    for _ in range(max_rounds):
        # A neighbour counts up to the vertex's own value: h = max k with at least k neighbours of value >= k.
        some = edges if touched is None else edges.join(touched, "src", "left_semi")
        values = some.join(state.toDF("dst", "v"), "dst").groupBy("src", "v").agg(F.count(F.lit(1)).alias("n"))
        rows = values.groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list(F.struct("v", "n")), asc=False).alias("a"))
        h = F.aggregate("a", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("h")), lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.greatest(acc["h"], F.least(x["v"], acc["seen"] + x["n"])).alias("h")))["h"]
        new = state.join(rows.select("vertex", h.alias("h")), "vertex", "left")
        new = cut(new.select("vertex", F.least("core_number", F.coalesce("h", "core_number")).alias("core_number"), (F.col("h") < F.col("core_number")).alias("fell")))
        fell = new.where("fell").select(F.col("vertex").alias("src"))
        if fell.isEmpty():
            return new.select("vertex", "core_number")
        # The graph is symmetric, so the neighbours are the ends of the edges that leave the fallen vertices.
        touched = edges.join(fell, "src", "left_semi").select(F.col("dst").alias("src")).distinct()
        state = new.select("vertex", "core_number")
    raise FailedToConvergeError("core numbers did not settle in the rounds allowed")


def k_core(g: Graph, k: int | None = None, core: DataFrame | None = None) -> Graph:
    """The subgraph of vertices with core number at least k (the largest there is, if none is named)."""
    core = core_number(g) if core is None else core
    if k is None:
        k = core.agg(F.max("core_number")).first()[0] or 0
    keep = core.where(F.col("core_number") >= k).select("vertex")
    edges = g.active.join(keep.toDF("src"), "src", "left_semi").join(keep.toDF("dst"), "dst", "left_semi")
    return Graph(edges.select(*g.edges.columns), keep, g.directed, g.multi)


def triangle_count(g: Graph, start: DataFrame | None = None) -> DataFrame:
    """vertex, counts: triangles through each vertex of an undirected simple graph, loops aside."""
    t = prims.triangles(g.active).select(F.explode(F.array("a", "b", "c")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("value"))
    who = g.vertices.select("vertex") if start is None else start.select("vertex").distinct()
    return prims.on_vertices(who, t, 0).select("vertex", F.col("value").cast("long").alias("counts"))


def edge_triangle_count(g: Graph) -> DataFrame:
    """src, dst, counts for each edge, both directions."""
    t = prims.triangles(g.active)
    sides = t.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("e"))
    counts = sides.groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("counts"))
    e = prims.neighbours(g.active).withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")})
    return e.join(counts, ["u", "v"], "left").select("src", "dst", F.coalesce("counts", F.lit(0)).cast("long").alias("counts"))


@scoped
def k_truss(g: Graph, k: int) -> Graph:
    """The largest subgraph in which every edge lies in k - 2 triangles; each round but the last drops an edge."""
    keep = cut(prims.neighbours(k_core(g, k - 1).active))
    n = keep.count()
    while True:
        strong = edge_triangle_count(Graph(keep, prims.endpoints(keep))).where(F.col("counts") >= k - 2).select("src", "dst")
        new = cut(strong)
        left = new.count()
        release(keep)
        keep = new
        if left == n:
            break
        n = left
    edges = g.active.where("src != dst").join(keep, ["src", "dst"], "left_semi")
    return Graph(edges.select(*g.edges.columns), prims.endpoints(keep), g.directed)


ktruss_subgraph = k_truss


@scoped
def minimum_spanning_tree(g: Graph, *, maximum: bool = False) -> Graph:
    """A spanning forest of least (or greatest) weight by Boruvka's rounds; equal weights go by the ends' ids."""
    sign = -1.0 if maximum else 1.0
    e = g.weighted_edges.where("src != dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight")
    e = cut(e.groupBy("u", "v").agg((F.max if maximum else F.min)("weight").alias("weight")).withColumn("k", F.struct((F.col("weight") * sign).alias("w"), "u", "v")))
    label = cut(g.vertices.select("vertex", F.col("vertex").alias("labels")))
    tree: DataFrame | None = None
    while True:
        across = e.join(label.toDF("u", "cu"), "u").join(label.toDF("v", "cv"), "v").where("cu != cv")
        offers = across.select(F.explode(F.array("cu", "cv")).alias("c"), "k")
        best = cut(offers.groupBy("c").agg(F.min("k").alias("k")).select("k").distinct().select("k.u", "k.v", (F.col("k.w") * sign).alias("weight")))
        if best.isEmpty():
            break
        tree = best if tree is None else cut(tree.unionByName(best).distinct())
        links = best.join(label.toDF("u", "cu"), "u").join(label.toDF("v", "cv"), "v").select(F.col("cu").alias("src"), F.col("cv").alias("dst"))
        merged = weakly_connected_components(Graph(links, prims.endpoints(links)))
        label = cut(label.join(merged.toDF("labels", "new"), "labels", "left").select("vertex", F.coalesce("new", "labels").alias("labels")))
    tree = tree if tree is not None else e.select("u", "v", "weight").limit(0)
    both = tree.toDF("src", "dst", "weight").unionByName(tree.select(F.col("v").alias("src"), F.col("u").alias("dst"), "weight"))
    return Graph(both, g.vertices.select("vertex"), False)


def maximum_spanning_tree(g: Graph) -> Graph:
    return minimum_spanning_tree(g, maximum=True)
