"""Connected components, independent sets and colourings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prims
from ..plans.runtime import FailedToConvergeError, cut, release, scoped
from ..sources.graph import Graph


def weakly_connected_components(g: Graph, max_rounds: int = 100) -> DataFrame:
    """vertex, labels: the least id of each component.

    Alternating large and small stars: rounds grow with the logarithm of a component's diameter, and every step groups
    with partial minima or joins edges to one row per vertex.
    """
    e = g.active.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges, before = cut(e), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        mark = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        release(edges)
        edges = after
        if mark == before:
            break
        before = mark
    else:
        raise FailedToConvergeError("components were not found in the rounds allowed")
    return g.vertices.select("vertex").join(edges.toDF("vertex", "labels"), "vertex", "left").select("vertex", F.coalesce("labels", "vertex").alias("labels"))


@scoped
def strongly_connected_components(g: Graph) -> DataFrame:
    """vertex, labels: the least id of each component.

    Rounds of forward colouring: each vertex takes the least id that reaches it; a colour's component is what reaches its
    own least vertex backwards within the colour.  Vertices without incoming or outgoing edges leave first.
    """
    edges = cut(g.active.where("src != dst").select("src", "dst").distinct())
    left = cut(g.vertices.select("vertex"))
    done: DataFrame | None = None

    def add(part: DataFrame) -> None:
        nonlocal done
        done = part if done is None else done.unionByName(part)

    while not left.isEmpty():
        inner = edges.select(F.col("src").alias("vertex")).intersect(edges.select(F.col("dst").alias("vertex")))
        single = cut(left.join(inner, "vertex", "left_anti"))
        if not single.isEmpty():
            add(single.select("vertex", F.col("vertex").alias("labels")))
            left = cut(left.join(single, "vertex", "left_anti"))
            edges = cut(edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
            continue
        colour = cut(left.select("vertex", F.col("vertex").alias("c")))
        while True:
            got = prims.aggregate_messages(edges, colour, F.col("c"), F.min)
            new = cut(colour.join(got, "vertex", "left").select("vertex", F.least("c", F.coalesce("value", "c")).alias("c")))
            if new.join(colour.toDF("vertex", "old"), "vertex").where("c != old").isEmpty():
                break
            colour = new
        inside = cut(edges.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst"))
        back = prims.reverse(inside)
        front = cut(colour.where("vertex = c"))
        found = front
        while True:
            step = prims.expand_frontier(front, back).select(F.col("dst").alias("vertex")).distinct().join(found, "vertex", "left_anti")
            front = cut(step.join(colour, "vertex"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        add(found.select("vertex", F.col("c").alias("labels")))
        left = cut(left.join(found, "vertex", "left_anti"))
        edges = cut(edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
    return done if done is not None else g.vertices.select("vertex", F.col("vertex").alias("labels"))


def connected_components(g: Graph, connection: str = "weak") -> DataFrame:
    return strongly_connected_components(g) if connection == "strong" else weakly_connected_components(g)


@scoped
def maximal_independent_set(g: Graph, seed: int = 42) -> DataFrame:
    """vertex: a set that can take no more vertices without two neighbours; priorities are seeded hashes (Luby)."""
    edges = cut(prims.neighbours(g.active.unionByName(prims.reverse(g.active))))
    left, chosen, round_ = cut(g.vertices.select("vertex")), None, 0
    while not left.isEmpty():
        rank = left.select("vertex", F.struct(F.xxhash64(F.lit(seed + round_), "vertex"), "vertex").alias("r"))
        least = prims.aggregate_messages(edges, rank, F.col("r"), F.min)
        won = cut(rank.join(least, "vertex", "left").where("value IS NULL OR r < value").select("vertex"))
        chosen = won if chosen is None else cut(chosen.unionByName(won))
        gone = won.unionByName(prims.expand_frontier(won, edges).select(F.col("dst").alias("vertex"))).distinct()
        left = cut(left.join(gone, "vertex", "left_anti"))
        edges = cut(edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
        round_ += 1
    return chosen if chosen is not None else left


@scoped
def vertex_coloring(g: Graph, seed: int = 42) -> DataFrame:
    """vertex, color: neighbours differ; each colour is an independent set of what was left."""
    edges, left, out, color = g.active, cut(g.vertices.select("vertex")), None, 0
    while not left.isEmpty():
        some = maximal_independent_set(Graph(edges, left, g.directed), seed + color).withColumn("color", F.lit(color))
        out = some if out is None else out.unionByName(some)
        left = cut(left.join(some, "vertex", "left_anti"))
        edges = cut(edges.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
        color += 1
    return out if out is not None else left.withColumn("color", F.lit(0))
