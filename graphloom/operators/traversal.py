"""Breadth-first search, shortest paths and path extraction; unreached is null inside, the sentinel of a type on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prims
from ..plans.runtime import cut, release, scoped
from ..sources.graph import Graph

MAX_INT, MAX_DOUBLE = (1 << 31) - 1, 1.7976931348623157e308


def _check(g: Graph, start: DataFrame) -> None:
    if not start.join(g.vertices.select("vertex"), "vertex", "left_anti").isEmpty():
        raise ValueError("a start vertex is not in the graph")


@scoped
def multi_source_bfs(g: Graph, starts: DataFrame, depth_limit: int | None = None) -> DataFrame:
    """root, vertex, distance, predecessor (least id; -1 for a root) of what each root reaches."""
    edges = cut(g.active.select("src", "dst").distinct(), by="src")
    front = cut(starts.select(F.col("vertex").alias("root"), "vertex").distinct().select("root", "vertex", F.lit(0).alias("distance"), F.lit(-1).cast("long").alias("predecessor")))
    seen, d = front, 0
    while depth_limit is None or d < depth_limit:
        d += 1
        new = prims.expand_frontier(front, edges, ["root"]).groupBy("root", F.col("dst").alias("vertex")).agg(F.min("src").alias("predecessor"))
        front = cut(new.join(seen, ["root", "vertex"], "left_anti").select("root", "vertex", F.lit(d).alias("distance"), "predecessor"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


@scoped
def bfs(g: Graph, start: DataFrame, depth_limit: int | None = None, *, unreachable: str = "max") -> DataFrame:
    """vertex, distance, predecessor for every vertex, from the nearest of the starts(vertex)."""
    _check(g, start)
    edges = cut(g.active.select("src", "dst").distinct(), by="src")
    front = cut(start.select("vertex").distinct().select("vertex", F.lit(0).alias("distance"), F.lit(-1).cast("long").alias("predecessor")))
    seen, d = front, 0
    while depth_limit is None or d < depth_limit:
        d += 1
        new = prims.expand_frontier(front, edges).groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("predecessor"))
        front = cut(new.join(seen, "vertex", "left_anti").select("vertex", F.lit(d).alias("distance"), "predecessor"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    out = g.vertices.select("vertex").join(seen, "vertex", "left").withColumn("predecessor", F.coalesce("predecessor", F.lit(-1).cast("long")))
    return out.na.fill(MAX_INT, ["distance"]) if unreachable == "max" else out


bfs_edges = bfs
concurrent_bfs = multi_source_bfs


def _relax(g: Graph, state: DataFrame, keys: list[str], cutoff: float | None) -> DataFrame:
    """Bellman-Ford over active vertices only; of equal distances the predecessor with the least id stays."""
    edges = cut(g.active.where("src != dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    state = cut(state)
    front = state
    while True:
        d = F.col("distance") + F.col("weight")
        offers = front.select(*keys, F.col("vertex").alias("src"), "distance").join(edges, "src").select(*keys, F.col("dst").alias("vertex"), d.alias("distance"), F.col("src").alias("predecessor"))
        if cutoff is not None:
            offers = offers.where(F.col("distance") < cutoff)
        best = offers.groupBy(*keys, "vertex").agg(F.min(F.struct("distance", "predecessor")).alias("o"))
        best = best.select(*keys, "vertex", F.col("o.distance").alias("nd"), F.col("o.predecessor").alias("np"))
        better = best.join(state, [*keys, "vertex"], "left").where("distance IS NULL OR nd < distance OR (nd = distance AND predecessor >= 0 AND np < predecessor)")
        changed = cut(better.select(*keys, "vertex", F.col("nd").alias("distance"), F.col("np").alias("predecessor"), (F.col("distance").isNull() | (F.col("nd") < F.col("distance"))).alias("nearer")))
        if changed.isEmpty():
            return state
        front = changed.where("nearer").drop("nearer")
        new = cut(state.join(changed, [*keys, "vertex"], "left_anti").unionByName(changed.drop("nearer")))
        release(state)
        state = new


def sssp(g: Graph, source: int, *, cutoff: float | None = None, unreachable: str = "max") -> DataFrame:
    """vertex, distance, predecessor; the cutoff is exclusive; weights must not be negative."""
    if not g.weighted:
        raise RuntimeError("shortest paths need weights")
    spark = g.edges.sparkSession
    start = spark.createDataFrame([(int(source),)], "vertex long")
    _check(g, start)
    state = _relax(g, start.select("vertex", F.lit(0.0).alias("distance"), F.lit(-1).cast("long").alias("predecessor")), [], cutoff)
    out = g.vertices.select("vertex").join(state, "vertex", "left").withColumn("predecessor", F.coalesce("predecessor", F.lit(-1).cast("long")))
    return out.na.fill(MAX_DOUBLE, ["distance"]) if unreachable == "max" else out


shortest_path = sssp


def shortest_path_length(g: Graph, source: int, target: int | None = None):
    d = sssp(g, source).select("vertex", "distance")
    if target is None:
        return d
    row = d.where(F.col("vertex") == target).first()
    if row is None:
        raise ValueError("the target is not in the graph")
    return row["distance"]


def filter_unreachable(df: DataFrame) -> DataFrame:
    return df.where(F.col("distance").isNotNull() & (F.col("distance") < (MAX_INT if dict(df.dtypes)["distance"] == "int" else MAX_DOUBLE)))


def od_shortest_distances(g: Graph, origins: DataFrame, destinations: DataFrame, *, cutoff: float | None = None) -> DataFrame:
    """origin, destination, distance (the largest double where there is no way) for all pairs asked for."""
    start = origins.select(F.col("vertex").alias("origin"), "vertex", F.lit(0.0).alias("distance"), F.lit(-1).cast("long").alias("predecessor"))
    found = _relax(g, start, ["origin"], cutoff).select("origin", F.col("vertex").alias("destination"), "distance")
    pairs = origins.select(F.col("vertex").alias("origin")).crossJoin(destinations.select(F.col("vertex").alias("destination")))  # the answer has a row for each pair
    return pairs.join(found, ["origin", "destination"], "left").na.fill(MAX_DOUBLE, ["distance"])


def extract_paths(tree: DataFrame, destinations: DataFrame, max_length: int = 1 << 20) -> DataFrame:
    """vertex, path (from the source to it): predecessors followed; unreached vertices have an empty path."""
    known = tree.select("vertex", "predecessor", "distance")
    limit = MAX_INT
    paths = destinations.select("vertex").join(known.where(F.col("distance") < limit), "vertex", "left")
    paths = paths.select("vertex", F.when(F.col("predecessor").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("vertex")).alias("path"), F.coalesce("predecessor", F.lit(-1).cast("long")).alias("next"))
    steps = known.select(F.col("vertex").alias("next"), F.col("predecessor").alias("further"))
    for _ in range(max_length):
        paths = cut(paths)
        if paths.where("next >= 0").isEmpty():
            break
        paths = paths.join(steps, "next", "left").select("vertex", F.when(F.col("next") >= 0, F.array_prepend("path", F.col("next"))).otherwise(F.col("path")).alias("path"), F.coalesce("further", F.lit(-1).cast("long")).alias("next"))
    return paths.select("vertex", "path")


def traversed_path(tree: DataFrame, vertex: int) -> DataFrame:
    return extract_paths(tree, tree.sparkSession.createDataFrame([(int(vertex),)], "vertex long"))


def traversed_cost(tree: DataFrame, costs: DataFrame) -> DataFrame:
    """vertex, cost: costs(vertex, value) added along each vertex's way to the root, by doubling pointers."""
    rows = cut(tree.select("vertex", "predecessor").join(costs.toDF("vertex", "cost"), "vertex", "left").na.fill(0.0, ["cost"]))
    while not rows.where("predecessor >= 0").isEmpty():
        up = rows.select(F.col("vertex").alias("predecessor"), F.col("cost").alias("more"), F.col("predecessor").alias("further"))
        rows = cut(rows.join(up, "predecessor", "left").select("vertex", F.coalesce("further", F.lit(-1).cast("long")).alias("predecessor"), (F.col("cost") + F.coalesce("more", F.lit(0.0))).alias("cost")))
    return rows.select("vertex", "cost")
