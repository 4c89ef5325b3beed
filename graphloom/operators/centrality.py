"""PageRank, HITS, Katz, eigenvector and betweenness centrality.

Edges are prepared once (normalised weights, bucketed by the column that is joined on), so that a round moves states only; each round joins the state to them
and adds up messages with map-side combination.  With n_iter the number of rounds is fixed and no scalar is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prims
from ..plans.runtime import FailedToConvergeError, cut, iterate, scoped
from ..sources.graph import Graph


def _finished(state: DataFrame, good: bool, strict: bool) -> DataFrame:
    if strict and not good:
        raise FailedToConvergeError("the tolerance was not met in the rounds allowed")
    return state


def _moved(column: str, tol: float):
    """sum |new - old| below tol."""

    def done(old: DataFrame, new: DataFrame) -> bool:
        gap = old.select("vertex", F.col(column).alias("_old")).join(new.select("vertex", F.col(column).alias("_new")), "vertex").agg(F.sum(F.abs(F.col("_new") - F.col("_old")))).first()[0]
        return (gap or 0.0) < tol

    return done


def pagerank(g: Graph, *, alpha: float = 0.85, personalization: DataFrame | None = None, precomputed_vertex_out_weight: DataFrame | None = None, nstart: DataFrame | None = None,
             max_iter: int = 100, tol: float = 1e-5, n_iter: int | None = None, fail_on_nonconvergence: bool = True) -> DataFrame:
    """vertex, pagerank; personalization(vertex, value) and nstart(vertex, value) are normalised; dangling mass follows the teleport."""
    e = g.weighted_edges.select("src", "dst", "weight")
    out = precomputed_vertex_out_weight.toDF("src", "out") if precomputed_vertex_out_weight is not None else e.groupBy("src").agg(F.sum("weight").alias("out"))
    edges = cut(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("w")), by="src")
    n = g.number_of_vertices()
    if not n:
        return g.vertices.select("vertex", F.lit(0.0).alias("pagerank"))
    sinks = g.vertices.select("vertex").join(out.select(F.col("src").alias("vertex"), F.lit(0).alias("sink")), "vertex", "left").withColumn("sink", F.coalesce("sink", F.lit(1)))
    if personalization is None:
        base = sinks.withColumn("t", F.lit(1.0 / n))
    else:
        p = personalization.toDF("vertex", "p")
        total = p.agg(F.sum("p")).first()[0]
        base = sinks.join(p, "vertex", "left").withColumn("t", F.coalesce(F.col("p") / total, F.lit(0.0))).drop("p")
    base = cut(base)
    if nstart is None:
        state = base.select("vertex", F.lit(1.0 / n).alias("pagerank"))
    else:
        s = nstart.toDF("vertex", "p")
        total = s.agg(F.sum("p")).first()[0]
        state = base.select("vertex").join(s, "vertex", "left").select("vertex", F.coalesce(F.col("p") / total, F.lit(0.0)).alias("pagerank"))

    def step(state: DataFrame, _: int) -> DataFrame:
        got = prims.aggregate_messages(edges, state, F.col("pagerank") * F.col("w"), F.sum)
        lost = base.join(state, "vertex").agg(F.coalesce(F.sum(F.col("sink") * F.col("pagerank")), F.lit(0.0)).alias("lost"))
        new = alpha * F.coalesce("value", F.lit(0.0)) + (alpha * F.col("lost") + (1 - alpha)) * F.col("t")
        return base.join(got, "vertex", "left").crossJoin(F.broadcast(lost)).select("vertex", new.alias("pagerank"))  # lost is one row

    if n_iter is not None:
        return iterate(state, step, None, n_iter)[0]
    return _finished(*iterate(state, step, _moved("pagerank", tol), max_iter), fail_on_nonconvergence)


def hits(g: Graph, *, max_iter: int = 100, tol: float = 1e-5, nstart: DataFrame | None = None, normalized: bool = True, n_iter: int | None = None) -> DataFrame:
    """vertex, hubs, authorities; weights are ignored; each round divides by the largest, the end by the sum if normalized."""
    edges, v = cut(g.active.select("src", "dst")), g.vertices.select("vertex")
    n = g.number_of_vertices()
    start = nstart.toDF("vertex", "hubs") if nstart is not None else v.withColumn("hubs", F.lit(1.0 / max(n, 1)))
    state = v.join(start, "vertex", "left").select("vertex", F.coalesce("hubs", F.lit(0.0)).alias("hubs"), F.lit(0.0).alias("authorities"))

    def step(state: DataFrame, _: int) -> DataFrame:
        a = prims.on_vertices(v, prims.aggregate_messages(edges, state, F.col("hubs"), F.sum)).withColumnRenamed("value", "authorities")
        h = prims.on_vertices(v, prims.aggregate_messages(edges, a, F.col("authorities"), F.sum, key="src", other="dst")).withColumnRenamed("value", "hubs")
        both = cut(h.join(a, "vertex"))
        top = both.agg(F.max("hubs").alias("mh"), F.max("authorities").alias("ma"))
        return both.crossJoin(F.broadcast(top)).select("vertex", (F.col("hubs") / F.col("mh")).alias("hubs"), (F.col("authorities") / F.col("ma")).alias("authorities"))  # top is one row

    state, good = iterate(state, step, None if n_iter is not None else _moved("hubs", tol * max(n, 1)), n_iter if n_iter is not None else max_iter)
    state = _finished(state, good, n_iter is None)
    if normalized:
        total = state.agg(F.sum("hubs").alias("sh"), F.sum("authorities").alias("sa"))
        state = state.crossJoin(F.broadcast(total)).select("vertex", (F.col("hubs") / F.col("sh")).alias("hubs"), (F.col("authorities") / F.col("sa")).alias("authorities"))  # total is one row
    return state


def _unit(df: DataFrame, column: str) -> DataFrame:
    norm = df.agg(F.sqrt(F.sum(F.col(column) ** 2)).alias("_norm"))
    return df.crossJoin(F.broadcast(norm)).withColumn(column, F.col(column) / F.col("_norm")).drop("_norm")  # norm is one row


def katz_centrality(g: Graph, *, alpha: float | None = None, beta: float = 1.0, betas: DataFrame | None = None, max_iter: int = 100, tol: float = 1e-6, normalized: bool = True, n_iter: int | None = None) -> DataFrame:
    """vertex, katz_centrality: x' = beta + alpha * sum of weighted x over incoming edges, from 0; betas(vertex, value) per vertex."""
    if alpha is None:
        from .structure import degrees

        alpha = 1.0 / max(1, degrees(g).agg(F.max("degree")).first()[0] or 1)
    edges, v = cut(g.weighted_edges.select("src", "dst", "weight"), by="src"), g.vertices.select("vertex")
    base = v.withColumn("b", F.lit(float(beta))) if betas is None else v.join(betas.toDF("vertex", "b"), "vertex", "left").na.fill(0.0, ["b"])
    state = v.withColumn("katz_centrality", F.lit(0.0))

    def step(state: DataFrame, _: int) -> DataFrame:
        got = prims.aggregate_messages(edges, state, F.col("katz_centrality") * F.col("weight"), F.sum)
        return base.join(got, "vertex", "left").select("vertex", (F.col("b") + alpha * F.coalesce("value", F.lit(0.0))).alias("katz_centrality"))

    state, good = iterate(state, step, None if n_iter is not None else _moved("katz_centrality", tol), n_iter if n_iter is not None else max_iter)
    state = _finished(state, good, n_iter is None)
    return _unit(cut(state), "katz_centrality") if normalized else state


def eigenvector_centrality(g: Graph, *, max_iter: int = 100, tol: float = 1e-6, n_iter: int | None = None) -> DataFrame:
    """vertex, eigenvector_centrality: power iteration with (A + I) transposed, L2-normalised."""
    edges, v, n = cut(g.weighted_edges.select("src", "dst", "weight"), by="src"), g.vertices.select("vertex"), g.number_of_vertices()
    c = "eigenvector_centrality"

    def step(state: DataFrame, _: int) -> DataFrame:
        got = prims.aggregate_messages(edges, state, F.col(c) * F.col("weight"), F.sum)
        return _unit(cut(state.join(got, "vertex", "left").select("vertex", (F.col(c) + F.coalesce("value", F.lit(0.0))).alias(c))), c)

    state = v.withColumn(c, F.lit(1.0 / max(n, 1)))
    state, good = iterate(state, step, None if n_iter is not None else _moved(c, tol * max(n, 1)), n_iter if n_iter is not None else max_iter)
    return _finished(state, good, n_iter is None)


def _brandes(g: Graph, roots: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(root, vertex, level, sigma, delta) of each root's shortest paths, terms by edge, the roots and the edges."""
    edges = cut(g.active.select("src", "dst").where("src != dst").distinct())
    roots = g.vertices.select("vertex") if roots is None else roots.select("vertex").distinct()
    front = cut(roots.select(F.col("vertex").alias("root"), "vertex", F.lit(1.0).alias("sigma")))
    seen, depth, levels = front.select("root", "vertex"), 0, [front]
    while True:
        depth += 1
        new = prims.expand_frontier(front, edges, ["root", "sigma"]).groupBy("root", F.col("dst").alias("vertex")).agg(F.sum("sigma").alias("sigma"))
        front = cut(new.join(seen, ["root", "vertex"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = cut(seen.unionByName(front.select("root", "vertex")))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    parts, terms = [delta.withColumn("level", F.lit(depth - 1))], []
    for k in range(len(levels) - 1, 0, -1):
        below = delta.select("root", F.col("vertex").alias("dst"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
        term = levels[k - 1].select("root", F.col("vertex").alias("src"), F.col("sigma").alias("sv")).join(edges, "src").join(below, ["root", "dst"])
        term = cut(term.select("root", "src", "dst", (F.col("sv") / F.col("sw") * (1 + F.col("dw"))).alias("value")))
        terms.append(term)
        up = term.groupBy("root", F.col("src").alias("vertex")).agg(F.sum("value").alias("delta"))
        delta = cut(levels[k - 1].join(up, ["root", "vertex"], "left").na.fill(0.0, ["delta"]))
        parts.append(delta.withColumn("level", F.lit(k - 1)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    by_edge = terms[0] if terms else edges.limit(0).select(F.col("src").alias("root"), "src", "dst", F.lit(0.0).alias("value"))
    for t in terms[1:]:
        by_edge = by_edge.unionByName(t)
    return every, by_edge, roots, edges


@scoped
def betweenness_centrality(g: Graph, *, roots: DataFrame | None = None, normalized: bool = True, endpoints: bool = False) -> DataFrame:
    """vertex, betweenness_centrality over all roots or those given (whose own vertices have one source less)."""
    paths, _, chosen, _ = _brandes(g, roots)
    n, k = g.number_of_vertices(), chosen.count()
    value = F.when(F.col("vertex") == F.col("root"), 0.0).otherwise(F.col("delta"))
    if endpoints:
        reached = paths.groupBy("root").agg((F.count(F.lit(1)) - 1.0).alias("reached"))
        paths = paths.join(reached, "root")
        value = F.when(F.col("vertex") == F.col("root"), F.col("reached")).otherwise(F.col("delta") + 1)
    raw = paths.groupBy("vertex").agg(F.sum(value).alias("value"))
    out = prims.on_vertices(g.vertices.select("vertex"), raw)
    every = k == n
    scale = F.lit(1.0)
    targets = n if endpoints else n - 1
    if normalized:
        pairs = float(targets * (targets - 1)) if n > 2 or endpoints else 1.0
        scale = F.lit(1.0 / max(pairs, 1.0))
    elif not g.directed:
        scale = F.lit(0.5)
    if not every:
        own = chosen.select("vertex", F.lit(True).alias("chosen"))
        out = out.join(own, "vertex", "left")
        # A root among the sampled ones is a source k - 1 times, any other vertex k times.
        sources = F.when(F.col("chosen"), F.lit(float(max(k - 1, 1)))).otherwise(F.lit(float(k)))
        full = float(n - 1) if not endpoints else float(n)
        scale = scale * (F.lit(full) / (F.lit(float(k)) if endpoints else sources))
    return out.select("vertex", (F.col("value") * scale).alias("betweenness_centrality"))


@scoped
def edge_betweenness_centrality(g: Graph, *, roots: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """src, dst, betweenness_centrality: divided by n (n - 1) if normalized, else by 2 if undirected; scaled up for a sample."""
    _, terms, chosen, edges = _brandes(g, roots)
    n, k = g.number_of_vertices(), chosen.count()
    scale = 1.0 / (n * (n - 1)) if normalized and n > 1 else (0.5 if not g.directed else 1.0)
    if k and k != n:
        scale *= n / k
    found = terms.groupBy("src", "dst").agg(F.sum("value").alias("value"))
    return edges.join(found, ["src", "dst"], "left").select("src", "dst", (F.coalesce("value", F.lit(0.0)) * scale).alias("betweenness_centrality"))
