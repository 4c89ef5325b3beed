"""The vertex and edge algebra that the operators are made of; frames are E(src, dst, weight, ...) and V(vertex, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the seed and keys only, not on partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    """Edges turned round, other columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def aggregate_messages(edges: DataFrame, state: DataFrame, message: Column, reducer, *, key: str = "dst", other: str = "src") -> DataFrame:
    """vertex, value: reducer(message) over the edges at `key`; message may use the state of `other` and edge columns."""
    joined = edges.join(state, edges[other] == state["vertex"])
    return joined.groupBy(F.col(key).alias("to")).agg(reducer(message).alias("value")).withColumnRenamed("to", "vertex")


def on_vertices(vertices: DataFrame, found: DataFrame, fill=0.0, column: str = "value") -> DataFrame:
    """found's column for every vertex, `fill` where it has none."""
    return vertices.join(found, "vertex", "left").withColumn(column, F.coalesce(F.col(column), F.lit(fill)))


def expand_frontier(frontier: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, vertex -> keys, src, dst and edge columns of the edges that leave the frontier."""
    return frontier.select(*(keys or []), F.col("vertex").alias("src")).join(edges, "src")


def neighbours(edges: DataFrame) -> DataFrame:
    """src, dst: distinct, without loops."""
    return edges.where("src != dst").select("src", "dst").distinct()


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, from the end of smaller (degree, id) to the other: hubs get few outgoing edges."""
    n = neighbours(edges)
    degree = n.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("d"))
    both = n.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    return both.where("ds < dd OR (ds = dd AND src < dst)").select("src", "dst")


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c: each triangle of a symmetric edge list once (degree-ordered wedges closed by a join)."""
    o = oriented(edges)
    wedge = o.toDF("a", "b").join(o.toDF("a", "c"), "a").where("b < c")
    closing = neighbours(edges).where("src < dst").toDF("b", "c")
    return wedge.join(closing, ["b", "c"]).select("a", "b", "c")


def top1_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of each key the one that comes last by `order`, with map-side combination."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best")) if rest else df.distinct()
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]) if rest else best


def sample_per_group(df: DataFrame, keys: list[str], n: int, order: Column) -> DataFrame:
    """The first n rows of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def count_if(df: DataFrame, predicate: Column) -> int:
    return df.where(predicate).count()


def transform_reduce(df: DataFrame, value: Column, reducer=F.sum):
    """One value aggregated over all vertices or edges."""
    return df.agg(reducer(value).alias("v")).first()["v"]


def reduce_by_key(edges: DataFrame, labels: DataFrame, value: Column, reducer=F.sum, side: str = "src") -> DataFrame:
    """key, value: edges aggregated by the label (vertex, key) of one end."""
    return edges.join(labels, edges[side] == labels["vertex"]).groupBy("key").agg(reducer(value).alias("value"))
