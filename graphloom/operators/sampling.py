"""Random walks, neighbour sampling (plain, biased, by type, temporal), negative samples; seeded hashes instead of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prims
from ..plans.runtime import cut
from ..sources.graph import Graph


def random_walks(g: Graph, starts: DataFrame, max_depth: int, *, kind: str = "uniform", p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """walk_id, path (max_depth + 1 vertices, -1 behind a dead end), weights (max_depth, 0 there) for starts(vertex).

    Each step chooses among the outgoing edges by the least of -ln(u) / bias, u a hash of walk, step and edge: exactly
    the chances in proportion to bias, whatever the partitioning, with map-side combination.
    """
    if kind == "biased" and not g.weighted:
        raise ValueError("a biased walk needs weights")
    from ..sources.graph import dense_ids

    edges = cut(g.weighted_edges.select("src", "dst", "weight"))
    walks = dense_ids(starts.withColumn("_n", F.monotonically_increasing_id()).select("vertex", "_n"), ["vertex", "_n"])
    state = walks.select(F.col("id").alias("walk_id"), F.array("vertex").alias("path"), F.array().cast("array<double>").alias("weights"), F.col("vertex").alias("at"), F.lit(None).cast("long").alias("prev"))
    pairs = edges.select(F.col("src").alias("prev"), F.col("dst").alias("dst"), F.lit(True).alias("near")).distinct()
    for step in range(max_depth):
        here = state.select("walk_id", F.col("at").alias("src"), "prev").join(edges, "src")
        bias = F.col("weight") if kind == "biased" else F.lit(1.0)
        if kind == "node2vec":
            here = here.join(pairs, ["prev", "dst"], "left")
            bias = F.when(F.col("prev").isNull(), 1.0).when(F.col("dst") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
            bias = bias * F.col("weight")
        u = prims.uniform(seed, F.lit(step), "walk_id", "dst", "weight") + 1e-18
        choice = here.withColumn("k", -F.log(u) / bias).groupBy("walk_id").agg(F.min_by(F.struct("dst", "weight"), F.struct("k", "dst")).alias("c"))
        state = state.join(choice, "walk_id", "left").select(
            "walk_id",
            F.array_append("path", F.coalesce("c.dst", F.lit(-1).cast("long"))).alias("path"),
            F.array_append("weights", F.coalesce("c.weight", F.lit(0.0))).alias("weights"),
            F.col("c.dst").alias("at"),
            F.col("at").alias("prev"),
        )
        state = cut(state)
    return state.select("walk_id", "path", "weights")


def uniform_random_walks(g: Graph, starts: DataFrame, max_depth: int, seed: int = 42) -> DataFrame:
    return random_walks(g, starts, max_depth, seed=seed)


def biased_random_walks(g: Graph, starts: DataFrame, max_depth: int, seed: int = 42) -> DataFrame:
    return random_walks(g, starts, max_depth, kind="biased", seed=seed)


def node2vec_random_walks(g: Graph, starts: DataFrame, max_depth: int = 1, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    return random_walks(g, starts, max_depth, kind="node2vec", p=p, q=q, seed=seed)


def neighbor_sample(g: Graph, starts: DataFrame, fanout: list[int], *, with_replacement: bool = False, with_biases: bool = False, random_state: int = 42, prior_sources: str = "default",
                    deduplicate_sources: bool = False, by_type: int = 0, temporal: str | None = None, renumber: bool = False) -> DataFrame:
    """batch_id, hop_id, src, dst and edge columns; starts(vertex[, batch_id][, time]).

    Per hop at most `fanout` outgoing edges of each frontier vertex (all, if negative).  With by_type = n, fanout has n
    entries a hop, one for each edge type.  With temporal ('>', '>=', '<', '<=') the next edge's start_time compares so
    with the time of the way there.  prior_sources: 'default', 'carryover' (the frontier keeps old sources) or 'exclude'
    (vertices that were sources before are not again).
    """
    columns = [c for c in g.edges.columns if c not in ("src", "dst")]
    edges = g.active.select("src", "dst", *columns)
    if with_biases and "weight" not in columns:
        raise ValueError("a biased sample needs weights")
    keys = ["batch_id"]
    front = starts if "batch_id" in starts.columns else starts.withColumn("batch_id", F.lit(0))
    keep = [*keys, "vertex", *(["time"] if temporal else [])]
    if temporal and "time" not in front.columns:
        front = front.withColumn("time", F.lit(None).cast("long"))
    front = front.select(*keep).distinct()
    used, out = front.select(*keys, "vertex").distinct(), None
    per_hop = max(1, by_type)
    for hop in range(len(fanout) // per_hop):
        limits = fanout[hop * per_hop : (hop + 1) * per_hop]
        near = front.select(*keys, F.col("vertex").alias("src"), *(["time"] if temporal else [])).join(edges, "src")
        if temporal:
            near = near.where(F.col("time").isNull() | F.expr(f"start_time {temporal} time"))
        group = [*keys, "src", *(["time"] if temporal else []), *(["edge_type"] if by_type else [])]
        limit: Column = F.lit(limits[0]) if not by_type else F.element_at(F.array(*map(F.lit, limits)), F.col("edge_type") + 1)
        u = prims.uniform(random_state, F.lit(hop), *keys, "src", "dst", *[c for c in columns if c in ("edge_id", "start_time")]) + 1e-18
        order = -F.log(u) / F.col("weight") if with_biases else u
        if with_replacement:
            draws = near.select(*group).distinct().withColumn("_draw", F.explode(F.sequence(F.lit(1), F.greatest(limit, F.lit(1)))))
            cell = draws.join(near, group)
            pick = prims.uniform(random_state + 1, F.lit(hop), "_draw", *keys, "src", "dst") + 1e-18
            key = -F.log(pick) / (F.col("weight") if with_biases else F.lit(1.0))
            rest = [c for c in ["dst", *columns] if c not in group]
            best = cell.groupBy(*group, "_draw").agg(F.min_by(F.struct(*rest), F.struct(key.alias("k"), "dst")).alias("c"))
            got = best.select(*group, *[F.col(f"c.{c}").alias(c) for c in rest])
        else:
            rank = F.row_number().over(Window.partitionBy(*group).orderBy(order, "dst"))
            got = near.withColumn("_rank", rank).where((limit < 0) | (F.col("_rank") <= limit)).drop("_rank")
        got = cut(got.select(*keys, F.lit(hop).alias("hop_id"), "src", "dst", *columns))
        out = got if out is None else out.unionByName(got)
        new = got.select(*keys, F.col("dst").alias("vertex"), *([F.col("start_time").alias("time")] if temporal else [])).distinct()
        if prior_sources == "carryover":
            new = new.unionByName(front).distinct()
        elif prior_sources == "exclude" or deduplicate_sources:
            new = new.join(used, [*keys, "vertex"], "left_anti")
        front = cut(new)
        used = cut(used.unionByName(front.select(*keys, "vertex")).distinct())
    out = out if out is not None else edges.limit(0).select(F.lit(0).alias("batch_id"), F.lit(0).alias("hop_id"), "src", "dst", *columns)
    return renumber_sampled(out)[0] if renumber else out


homogeneous_neighbor_sample = neighbor_sample


def heterogeneous_neighbor_sample(g: Graph, starts: DataFrame, fanout: list[int], num_edge_types: int, **options) -> DataFrame:
    return neighbor_sample(g, starts, fanout, by_type=num_edge_types, **options)


def renumber_sampled(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with ids from 0 in each batch, sources first, by hop and id; and the map (batch_id, local, vertex)."""
    ends = samples.select("batch_id", F.explode(F.array(F.struct((F.col("hop_id") * 2).alias("at"), F.col("src").alias("vertex")), F.struct((F.col("hop_id") * 2 + 1).alias("at"), F.col("dst").alias("vertex")))).alias("e"))
    first = ends.groupBy("batch_id", "e.vertex").agg(F.min("e.at").alias("at"))
    names = first.select("batch_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("at", "vertex")) - 1).cast("long").alias("local"), "vertex")
    s, d = names.toDF("batch_id", "_s", "src"), names.toDF("batch_id", "_d", "dst")
    out = samples.join(s, ["batch_id", "src"]).join(d, ["batch_id", "dst"])
    rest = [c for c in samples.columns if c not in ("batch_id", "src", "dst")]
    return out.select("batch_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest), names


def compress_sampled(samples: DataFrame, per_hop: bool = True) -> DataFrame:
    """batch_id[, hop_id], majors, offsets, minors: compressed rows with only the majors that have edges."""
    keys = ["batch_id", *(["hop_id"] if per_hop else [])]
    rows = samples.groupBy(*keys, "src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("src", "d"))).alias("r"))
    add = F.aggregate("r", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.size(x["d"])))
    return rows.select(*keys, F.col("r.src").alias("majors"), add.alias("offsets"), F.flatten("r.d").alias("minors"))


def sort_sampled(samples: DataFrame) -> DataFrame:
    return samples.repartition("batch_id").sortWithinPartitions("batch_id", "hop_id", "src", "dst")


def negative_sampling(g: Graph, num_samples: int, *, src_bias: DataFrame | None = None, dst_bias: DataFrame | None = None, remove_duplicates: bool = True, remove_existing: bool = True, exact: bool = True, seed: int = 42, max_rounds: int = 30) -> DataFrame:
    """src, dst: pairs drawn by the biases (vertex, bias), by default all alike, without those that the graph has."""
    def cumulative(bias: DataFrame | None) -> DataFrame:
        b = g.vertices.select("vertex", F.lit(1.0).alias("bias")) if bias is None else bias.toDF("vertex", "bias").where("bias > 0")
        from ..sources.graph import dense_ids

        return dense_ids(b, ["vertex", "bias"])

    spark = g.edges.sparkSession
    sides = []
    for bias in (src_bias, dst_bias):
        ids = cumulative(bias)
        n, top = ids.agg(F.count(F.lit(1)), F.max("bias")).first()
        sides.append((ids, n, top))
    out: DataFrame | None = None
    for round_ in range(max_rounds):
        have = out.count() if out is not None else 0
        if have >= num_samples or (out is not None and not exact):
            break
        draws = spark.range((num_samples - have) * 2).select("id")
        for j, (name, (ids, n, top)) in enumerate(zip(("src", "dst"), sides)):
            pick = F.floor(prims.uniform(seed + 2 * j, F.lit(round_), "id") * n).cast("long").alias("_i")
            taken = draws.select("*", pick).join(ids.select(F.col("id").alias("_i"), F.col("vertex").alias(name), "bias"), "_i")
            draws = taken.where(prims.uniform(seed + 2 * j + 1, F.lit(round_), "id") * top <= F.col("bias")).drop("_i", "bias")
        new = draws.select("src", "dst", F.xxhash64(F.lit(seed + round_), "id").alias("k"))
        if remove_existing:
            new = new.join(g.active.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        out = new if out is None else out.unionByName(new)
        if remove_duplicates:
            out = out.groupBy("src", "dst").agg(F.min("k").alias("k"))
        out = cut(out)
    out = out.orderBy("k", "src", "dst").limit(num_samples) if exact else out
    return out.select("src", "dst")


def sample_groups(df: DataFrame, by: str, n: int, seed: int = 42) -> DataFrame:
    return prims.sample_per_group(df, [by], n, F.xxhash64(F.lit(seed), *df.columns))


class NeighborSampler:
    """Samples batches of start vertices (or edges) and writes them as Parquet, runs of batches to a partition."""

    def __init__(self, g: Graph, path: str, fanout: list[int], **options):
        self.g, self.path, self.fanout, self.options = g, path, fanout, options

    def sample_batches(self, starts: DataFrame) -> DataFrame:
        return neighbor_sample(self.g, starts, self.fanout, **self.options)

    def sample_from_nodes(self, nodes: DataFrame, batch_size: int = 16) -> DataFrame:
        from ..sources.graph import dense_ids
        from ..sources.tables import write_samples

        ids = dense_ids(nodes.select("vertex"), ["vertex"])
        out = self.sample_batches(ids.select("vertex", F.floor(F.col("id") / batch_size).cast("long").alias("batch_id")))
        write_samples(out, self.path)
        return out

    def sample_from_edges(self, edges: DataFrame, batch_size: int = 16) -> DataFrame:
        from ..sources.graph import dense_ids
        from ..sources.tables import write_samples

        ids = dense_ids(edges.select("src", "dst").distinct(), ["src", "dst"])
        ends = ids.select(F.floor(F.col("id") / batch_size).cast("long").alias("batch_id"), F.explode(F.array("src", "dst")).alias("vertex")).distinct()
        out = self.sample_batches(ends)
        write_samples(out, self.path)
        return out
