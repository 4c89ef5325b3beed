"""Assignment and layout, and bicliques: what isn't relational runs as one bounded task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prims import uniform
from ..plans.runtime import cut
from ..sources.graph import Graph

#: Cells of one assignment problem, at most: it is solved by one task.
CELLS = 25_000_000


def dense_hungarian(costs: np.ndarray) -> tuple[float, np.ndarray]:
    """Least total cost and the column of each row (-1 where there are more rows than columns): shortest augmenting paths."""
    costs = np.asarray(costs, dtype=float)
    flip = costs.shape[0] > costs.shape[1]
    c = costs.T if flip else costs
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j0]:
            used[j0] = True
            slack = c[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    chosen = np.full(n, -1)
    for j in range(1, m + 1):
        if row_of[j]:
            chosen[row_of[j] - 1] = j - 1
    total = float(c[np.arange(n), chosen].sum())
    if flip:
        back = np.full(costs.shape[0], -1)
        back[chosen] = np.arange(n)
        chosen = back
    return total, chosen


def hungarian(g: Graph, workers: DataFrame) -> tuple[float, DataFrame]:
    """Least total cost and (vertex, assignment): each worker one task, over the edges from workers; no edge costs the most."""
    e = g.weighted_edges.join(workers.select(F.col("vertex").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    n_src, n_dst = e.agg(F.count_distinct("src"), F.count_distinct("dst")).first()
    if n_src * n_dst > CELLS:
        raise ValueError(f"an assignment of {n_src} x {n_dst} is beyond one task's {CELLS} cells")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = np.unique(pdf["src"]), np.unique(pdf["dst"])
        costs = np.full((len(rows), len(columns)), 1e12)
        costs[np.searchsorted(rows, pdf["src"]), np.searchsorted(columns, pdf["dst"])] = pdf["weight"]
        _, to = dense_hungarian(costs)
        return pd.DataFrame({"vertex": rows, "assignment": np.where(to >= 0, columns[to], -1), "cost": np.where(to >= 0, costs[np.arange(len(rows)), to], 0.0)}).astype({"vertex": "int64", "assignment": "int64", "cost": "float64"})

    out = cut(e.groupBy(F.lit(0).alias("one")).applyInPandas(solve, "vertex long, assignment long, cost double"))
    return out.agg(F.sum("cost")).first()[0] or 0.0, out.select("vertex", "assignment")


def force_atlas2(g: Graph, max_iter: int = 500, *, pos: DataFrame | None = None, outbound_attraction_distribution: bool = True, lin_log_mode: bool = False, prevent_overlapping: bool = False, vertex_radius: DataFrame | None = None,
                 edge_weight_influence: float = 1.0, jitter_tolerance: float = 1.0, scaling_ratio: float = 2.0, strong_gravity_mode: bool = False, gravity: float = 1.0, random_state: int = 42, block: int = 1024, limit: int = 200_000) -> DataFrame:
    """vertex, x, y: exact repulsion in blocks, attraction along edges, gravity, adaptive speed; one task, so up to `limit` vertices."""
    start = g.vertices.select("vertex", (uniform(random_state, F.lit(0), "vertex") * 200 - 100).alias("x"), (uniform(random_state, F.lit(1), "vertex") * 200 - 100).alias("y"), F.lit(0.0).alias("r"))
    if pos is not None:
        start = start.drop("x", "y").join(pos.select("vertex", "x", "y"), "vertex")
    if vertex_radius is not None:
        start = start.drop("r").join(vertex_radius.toDF("vertex", "r"), "vertex", "left").na.fill(0.0, ["r"])
    if start.count() > limit:
        raise ValueError(f"a layout is for {limit} vertices at most")
    edges = g.weighted_edges.where("src != dst").select("src", "dst", "weight")

    def run(_, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vertex")
        ids, p, radius = v["vertex"].to_numpy(), v[["x", "y"]].to_numpy(float), v["r"].to_numpy(float)
        s, d = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])
        w = e["weight"].to_numpy(float) ** edge_weight_influence
        mass = 1.0 + np.bincount(s, minlength=len(ids))
        speed, efficiency, old = 1.0, 1.0, np.zeros_like(p)
        mean = mass.mean() if outbound_attraction_distribution else 1.0
        for _ in range(max_iter):
            force = np.zeros_like(p)
            for a in range(0, len(ids), block):
                gap = p[a : a + block, None] - p[None]
                far = np.maximum((gap**2).sum(-1), 1e-9)
                k = scaling_ratio * mass[a : a + block, None] * mass[None] / far
                if prevent_overlapping:
                    touch = np.sqrt(far) < radius[a : a + block, None] + radius[None]
                    k = np.where(touch, 100 * scaling_ratio * mass[a : a + block, None] * mass[None], k)
                force[a : a + block] += (gap * k[..., None]).sum(1)
            gap = p[s] - p[d]
            dist = np.maximum(np.sqrt((gap**2).sum(-1)), 1e-9)
            k = w * mean / (mass[s] if outbound_attraction_distribution else 1.0)
            if lin_log_mode:
                k = k * np.log1p(dist) / dist
            np.add.at(force, s, -gap * np.reshape(k, (-1, 1)))
            dist = np.maximum(np.sqrt((p**2).sum(-1)), 1e-9)
            pull = gravity * mass * (1.0 if strong_gravity_mode else 1 / dist)
            force -= p * pull[:, None]
            swing = mass * np.sqrt(((force - old) ** 2).sum(-1))
            traction = mass * np.sqrt(((force + old) ** 2).sum(-1)) / 2
            total = max(swing.sum(), 1e-12)
            jitter = jitter_tolerance * max(0.05 * np.sqrt(len(ids)), min(10.0, 0.05 * np.sqrt(len(ids)) * traction.sum() / max(len(ids) ** 2, 1)))
            if total / max(traction.sum(), 1e-12) > 2.0:
                efficiency = max(efficiency * 0.5, 0.05)
                jitter = max(jitter, jitter_tolerance)
            target = jitter * efficiency * traction.sum() / total
            efficiency = max(efficiency * 0.7, 0.05) if total > jitter * traction.sum() else min(efficiency * 1.3, 10.0)
            speed += min(target - speed, 0.5 * speed)
            p = p + force * (speed / (1.0 + np.sqrt(speed * swing)))[:, None]
            old = force
        return pd.DataFrame({"vertex": ids, "x": p[:, 0], "y": p[:, 1]})

    return start.groupBy(F.lit(0).alias("one")).cogroup(edges.groupBy(F.lit(0).alias("one"))).applyInPandas(run, "vertex long, x double, y double")


def find_bicliques(df: DataFrame, k: int, *, offset: int = 0, max_iter: int = 10, support: float = 1.0) -> DataFrame:
    """biclique, src, dst: greedily, the features that most sources share, and the sources that have at least `support` of them."""
    left, out = cut(df.select("src", "dst").distinct()), None
    for i in range(max_iter):
        top = left.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(k)
        top = cut(top)
        if top.count() < k:
            break
        rows = left.join(top.select("dst"), "dst", "left_semi")
        who = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * k).select("src")
        found = cut(rows.join(who, "src", "left_semi").select(F.lit(i + offset).alias("biclique"), "src", "dst"))
        if found.isEmpty():
            break
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
    return out if out is not None else left.limit(0).select(F.lit(0).alias("biclique"), "src", "dst")


