"""Synthetic graphs: every edge is a function of the seed and its number, so tables of any size are made in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prims import uniform


def rmat(spark: SparkSession, scale: int, num_edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 42, clip_and_flip: bool = False, scramble_vertex_ids: bool = False,
         weights: tuple[float, float] | None = None, ids: bool = False, types: tuple[int, int] | None = None, dst_scale: int | None = None) -> DataFrame:
    """src, dst[, weight, edge_id, edge_type]: each bit of both ends by the four quadrants' chances; dst_scale makes it bipartite."""
    low = dst_scale if dst_scale is not None else scale
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(max(scale, low)):
        u, v = uniform(seed, F.lit(2 * bit), "id"), uniform(seed, F.lit(2 * bit + 1), "id")
        s = (u > a + b).cast("long")
        d = F.when(s == 1, v > c / max(1 - (a + b), 1e-12)).otherwise(v > a / (a + b)).cast("long")
        src = src * 2 + s if bit < scale else src
        dst = dst * 2 + d if bit < low else dst
    out = spark.range(num_edges).select("id", src.alias("src"), dst.alias("dst"))
    if clip_and_flip:
        # The first bit in which the ends differ moves to src, so that src >= dst.
        filled = F.expr("aggregate(array(1, 2, 4, 8, 16, 32), src ^ dst, (x, k) -> x | shiftrightunsigned(x, k))")
        bit = out.select("*", filled.alias("x")).select("*", F.when(F.col("src") < F.col("dst"), F.expr("x - shiftrightunsigned(x, 1)")).otherwise(0).alias("bit"))
        out = bit.select("id", (F.col("src") + F.col("bit")).alias("src"), (F.col("dst") - F.col("bit")).alias("dst"))
    if scramble_vertex_ids:
        out = scramble(out, scale)
    extra = []
    if weights:
        extra.append((weights[0] + (weights[1] - weights[0]) * uniform(seed + 1, "id")).alias("weight"))
    if ids:
        extra.append(F.col("id").alias("edge_id"))
    if types:
        extra.append((types[0] + F.floor(uniform(seed + 2, "id") * (types[1] - types[0] + 1))).cast("int").alias("edge_type"))
    return out.select("src", "dst", *extra)


def multi_rmat(spark: SparkSession, n_edgelists: int, min_scale: int, max_scale: int, edge_factor: int = 16, seed: int = 42, **options) -> list[DataFrame]:
    span = max_scale - min_scale + 1
    return [rmat(spark, s := min_scale + (i * 7 + seed) % span, edge_factor << s, seed=seed + i, **options) for i in range(n_edgelists)]


def scramble(edges: DataFrame, scale: int) -> DataFrame:
    """A bijection on ids below 2**scale: odd multiplications and shifts within so many bits."""
    mask = (1 << scale) - 1

    def move(x):
        x = (x * F.lit(0x9E3779B1 | 1)).bitwiseAND(F.lit(mask))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, max(1, scale // 2)))
        return (x * F.lit(0x85EBCA6B | 1)).bitwiseAND(F.lit(mask))

    return edges.withColumns({"src": move(F.col("src")), "dst": move(F.col("dst"))})


def path_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def mesh_2d(spark: SparkSession, x: int, y: int) -> DataFrame:
    v = spark.range(x * y).select("id", (F.col("id") % x).alias("i"), F.floor(F.col("id") / x).alias("j"))
    steps = F.array(F.when(F.col("i") + 1 < x, F.col("id") + 1), F.when(F.col("j") + 1 < y, F.col("id") + x))
    return v.select(F.col("id").alias("src"), F.explode(F.array_compact(steps)).alias("dst"))


def mesh_3d(spark: SparkSession, x: int, y: int, z: int) -> DataFrame:
    v = spark.range(x * y * z).select("id", (F.col("id") % x).alias("i"), (F.floor(F.col("id") / x) % y).alias("j"), F.floor(F.col("id") / (x * y)).alias("k"))
    steps = F.array(F.when(F.col("i") + 1 < x, F.col("id") + 1), F.when(F.col("j") + 1 < y, F.col("id") + x), F.when(F.col("k") + 1 < z, F.col("id") + x * y))
    return v.select(F.col("id").alias("src"), F.explode(F.array_compact(steps)).alias("dst"))


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    v = spark.range(n).where(f"id < {n - 1}")
    return v.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """Each ordered pair of different vertices with chance p."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"))
    return pairs.where(f"src != dst").where(uniform(seed, "src", "dst") < p)


def symmetrize_triangular(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def combine(*edges: DataFrame) -> DataFrame:
    out = edges[0].select("src", "dst")
    for e in edges[1:]:
        out = out.unionByName(e.select("src", "dst"))
    return out.distinct()


def random_bipartite(spark: SparkSession, v1: int, v2: int, seed: int = 42, top: int = 100) -> DataFrame:
    """src, dst, weight: all pairs of two sides with random whole weights; second ids start at v1."""
    pairs = spark.range(v1 * v2).select(F.floor(F.col("id") / v2).alias("src"), (F.col("id") % v2 + v1).alias("dst"))
    return pairs.withColumn("weight", F.floor(uniform(seed, "src", "dst") * top).cast("double"))
