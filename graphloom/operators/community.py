"""Community detection, scores of clusterings, and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prims
from ..plans.runtime import cut, scoped
from ..sources.graph import Graph, coarsen
from . import moves


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """modularity of labels(vertex, cluster) over directed weighted edges: inner / m - resolution * sum of (degree / m) squared."""
    c = labels.toDF("vertex", "cluster")
    both = edges.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst")
    totals = both.groupBy("cs").agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("i"))
    m = F.sum("d")
    return totals.agg((F.sum("i") / m - resolution * F.sum(F.col("d") ** 2) / (m * m)).alias("modularity"))


def _q(edges: DataFrame, labels: DataFrame, resolution: float) -> float:
    return modularity(edges, labels, resolution).first()[0] or 0.0


def _move(edges: DataFrame, state: DataFrame, m: float, resolution: float, up: bool) -> DataFrame:
    """One parallel round of local moves: each vertex to the neighbouring cluster of best gain, only up or only down in ids."""
    k = edges.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("k"))
    rows = state.join(k, "vertex", "left").na.fill(0.0, ["k"])
    total = rows.groupBy("cluster").agg(F.sum("k").alias("sigma"))
    links = edges.where("src != dst").join(state.toDF("dst", "to"), "dst").groupBy(F.col("src").alias("vertex"), "to").agg(F.sum("weight").alias("w"))
    own = links.toDF("vertex", "cluster", "w_own")
    full = links.join(rows, "vertex").join(own, ["vertex", "cluster"], "left").na.fill(0.0, ["w_own"])
    full = full.join(total.toDF("to", "s_to"), "to").join(total.toDF("cluster", "s_own"), "cluster").where("to != cluster")
    gain = 2 * (F.col("w") - F.col("w_own")) / m - 2 * resolution * F.col("k") * (F.col("s_to") - F.col("s_own") + F.col("k")) / (m * m)
    best = full.withColumn("gain", gain).groupBy("vertex", "cluster").agg(F.max(F.struct("gain", (-F.col("to")).alias("t"))).alias("b"))
    best = best.select("vertex", F.col("b.gain").alias("gain"), (-F.col("b.t")).alias("to"))
    right = F.col("to") > F.col("cluster") if up else F.col("to") < F.col("cluster")
    chosen = (F.col("gain") > 0) & right
    return state.join(best, "vertex", "left").select("vertex", F.when(chosen, F.col("to")).otherwise(F.col("cluster")).alias("cluster"))


def _local(edges: DataFrame, vertices: DataFrame, m: float, resolution: float, threshold: float) -> tuple[DataFrame, float]:
    """Local moves, round by round: in passes over packed edges if the driver can hold the clusters of all vertices, else by joins."""
    if (held := moves.held(edges, vertices, m, resolution, threshold)) is not None:
        return held
    best = cut(vertices.select("vertex", F.col("vertex").alias("cluster")))
    q = _q(edges, best, resolution)
    state, up, gained = best, True, True
    while gained:
        gained = False
        for direction in (up, not up):
            new = cut(_move(edges, state, m, resolution, direction))
            new_q = _q(edges, new, resolution)
            state = new
            if new_q > q + threshold:
                best, q, gained = new, new_q, True
            else:
                state = best
    return best, q


@scoped
def louvain(g: Graph, max_level: int = 100, resolution: float = 1.0, threshold: float = 1e-7) -> tuple[DataFrame, float]:
    """(vertex, partition) and its modularity: parallel local moves, contraction, and again until nothing is gained."""
    if g.has_edge_mask():
        raise ValueError("louvain does not take an edge mask")
    base = cut(g.weighted_edges.select("src", "dst", "weight"))
    m = base.agg(F.sum("weight")).first()[0] or 0.0
    flat = g.vertices.select("vertex", F.col("vertex").alias("partition"))
    if not m:
        return flat, 0.0
    edges, vertices, q = base, cut(g.vertices.select("vertex")), _q(base, flat, resolution)
    for _ in range(min(max_level, 500)):
        clusters, new_q = _local(edges, vertices, m, resolution, threshold)
        if new_q <= q + threshold:
            break
        q = new_q
        flat = cut(flat.join(clusters.toDF("partition", "c"), "partition").select("vertex", F.col("c").alias("partition")))
        edges = cut(coarsen(edges, clusters))
        vertices = cut(clusters.select(F.col("cluster").alias("vertex")).distinct())
    return flat, q


@scoped
def leiden(g: Graph, max_iter: int = 100, resolution: float = 1.0, random_state: int = 42, theta: float = 1.0) -> tuple[DataFrame, float]:
    """Louvain with refinement: before contraction each cluster is split into its connected parts, which the next level starts from."""
    from .components import weakly_connected_components

    base = cut(g.weighted_edges.select("src", "dst", "weight"))
    m = base.agg(F.sum("weight")).first()[0] or 0.0
    flat = g.vertices.select("vertex", F.col("vertex").alias("partition"))
    if not m:
        return flat, 0.0
    edges, vertices, q = base, cut(g.vertices.select("vertex")), _q(base, flat, resolution)
    for _ in range(max_iter):
        clusters, new_q = _local(edges, vertices, m, resolution, 1e-4 if q > 0 else 1e-7)
        inner = edges.join(clusters.toDF("src", "cs"), "src").join(clusters.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        parts = cut(weakly_connected_components(Graph(inner, vertices)).toDF("vertex", "cluster"))
        new_q = _q(edges, parts, resolution)
        if new_q <= q + 1e-7:
            break
        q = new_q
        flat = cut(flat.join(parts.toDF("partition", "c"), "partition").select("vertex", F.col("c").alias("partition")))
        edges = cut(coarsen(edges, parts))
        vertices = cut(parts.select(F.col("cluster").alias("vertex")).distinct())
    return flat, q


@scoped
def ecg(g: Graph, min_weight: float = 1e-4, ensemble_size: int = 100, max_level: int = 10, threshold: float = 1e-7, resolution: float = 1.0, random_state: int = 42) -> tuple[DataFrame, float]:
    """Ensemble clustering: edges are weighed by how often one-level clusterings of shuffled ids keep both ends together."""
    base = cut(g.weighted_edges.select("src", "dst", "weight"))
    m = base.agg(F.sum("weight")).first()[0] or 0.0
    together: DataFrame | None = None
    for i in range(ensemble_size):
        names = cut(g.vertices.select("vertex", F.xxhash64(F.lit(random_state + i), "vertex").alias("name")))
        renamed = cut(base.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"))
        labels, _ = _local(renamed, names.select(F.col("name").alias("vertex")), m, resolution, threshold)
        back = labels.toDF("name", "cluster").join(names, "name").select("vertex", "cluster")
        votes = base.join(back.toDF("src", "cs"), "src").join(back.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        together = cut(votes) if together is None else together.unionByName(cut(votes))
    share = together.groupBy("src", "dst").agg((F.count(F.lit(1)) / ensemble_size).alias("share"))
    weighed = base.join(share, ["src", "dst"], "left").select("src", "dst", (min_weight + (F.col("weight") - min_weight) * F.coalesce("share", F.lit(0.0))).alias("weight"))
    labels, _ = louvain(Graph(cut(weighed), g.vertices, g.directed), max_level, resolution, threshold)
    return labels, _q(base, labels, resolution)


def edge_cut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Half the weight between clusters, of edges in both directions."""
    c = labels.toDF("vertex", "cluster")
    both = edges.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst").where("cs != cd")
    return both.agg((F.coalesce(F.sum("weight"), F.lit(0.0)) / 2).alias("edge_cut"))


def ratio_cut(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The weight that leaves each cluster over its size, added up."""
    c = labels.toDF("vertex", "cluster")
    leaving = edges.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst").where("cs != cd").groupBy(F.col("cs").alias("cluster")).agg(F.sum("weight").alias("w"))
    sizes = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(leaving, "cluster").agg(F.coalesce(F.sum(F.col("w") / F.col("n")), F.lit(0.0)).alias("ratio_cut"))


def spectral_modularity_clustering(g: Graph, num_clusters: int, num_eigen_vects: int = 2, n_iter: int = 60, seed: int = 42) -> DataFrame:
    """vertex, cluster: k-means over leading eigenvectors of the modularity matrix, by shifted power iteration with deflation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = cut(g.weighted_edges.select("src", "dst", "weight"))
    deg = e.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("k"))
    v = cut(prims.on_vertices(g.vertices.select("vertex"), deg.withColumnRenamed("k", "value")).withColumnRenamed("value", "k"))
    m = v.agg(F.sum("k")).first()[0] or 1.0
    shift = v.agg(F.max("k")).first()[0] or 1.0
    found: list[DataFrame] = []
    for j in range(num_eigen_vects):
        state = v.select("vertex", (prims.uniform(seed + j, "vertex") - 0.5).alias("x"))
        for i in range(n_iter):
            for f in found:  # keep clear of the ones already found
                dot = state.join(f, "vertex").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
                state = state.join(f, "vertex").crossJoin(F.broadcast(dot)).select("vertex", (F.col("x") - F.col("d") * F.col("y")).alias("x"))  # one row
            got = prims.aggregate_messages(e, state, F.col("x") * F.col("weight"), F.sum)
            kx = state.join(v, "vertex").agg(F.sum(F.col("x") * F.col("k")).alias("kx"))
            new = state.join(got, "vertex", "left").join(v, "vertex").crossJoin(F.broadcast(kx))  # one row
            new = new.select("vertex", (F.coalesce("value", F.lit(0.0)) - F.col("k") * F.col("kx") / m + 2 * shift * F.col("x")).alias("x"))
            norm = new.agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("n"))
            state = new.crossJoin(F.broadcast(norm)).select("vertex", (F.col("x") / F.col("n")).alias("x"))  # one row
            if i % 3 == 2:
                state = cut(state)
        found.append(cut(state.toDF("vertex", "y")))
    rows = v.select("vertex")
    for j, f in enumerate(found):
        rows = rows.join(f.toDF("vertex", f"x{j}"), "vertex")
    points = cut(rows.select("vertex", F.array(*[f"x{j}" for j in range(len(found))]).alias("a"))).withColumn("features", array_to_vector("a"))
    fitted = KMeans(k=num_clusters, seed=seed).fit(points)
    return fitted.transform(points).select("vertex", F.col("prediction").alias("cluster"))


spectral_balanced_cut_clustering = spectral_modularity_clustering


@scoped
def approximate_weighted_matching(g: Graph) -> tuple[DataFrame, float]:
    """(vertex, partner; -1 without) and the weight of pairs that prefer each other, found round by round."""
    e = cut(g.weighted_edges.where("src != dst").groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    pairs: DataFrame | None = None
    while not e.isEmpty():
        offer = e.groupBy("src").agg(F.max(F.struct("weight", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "dst")).alias("o")).select("src", F.col("o.dst").alias("dst"), F.col("o.weight").alias("weight"))
        mutual = cut(offer.join(offer.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"))
        pairs = mutual if pairs is None else cut(pairs.unionByName(mutual))
        taken = mutual.select(F.col("src").alias("vertex"))
        e = cut(e.join(taken.toDF("src"), "src", "left_anti").join(taken.toDF("dst"), "dst", "left_anti"))
    if pairs is None:
        return g.vertices.select("vertex", F.lit(-1).cast("long").alias("partner")), 0.0
    total = (pairs.agg(F.sum("weight")).first()[0] or 0.0) / 2
    return g.vertices.select("vertex").join(pairs.select(F.col("src").alias("vertex"), F.col("dst").alias("partner")), "vertex", "left").na.fill(-1, ["partner"]), total
