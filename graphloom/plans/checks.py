"""More queries over whole tables: operators whose answer is one of several right ones, held to what makes it right.

Queries called x_valid count the places where an answer breaks its definition; their SQL says that there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prims
from ..operators import centrality, community, components, cores, generators, layout, sampling, similarity, structure, traversal
from ..sources.graph import Graph, remove_self_loops, symmetrize_edges
from . import queries as q
from .runtime import cut, scoped


def _none(**counts: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def _zeros(*names: str) -> str:
    return "SELECT " + ", ".join(f"0::BIGINT AS {n}" for n in names)


def independent_set(s: SparkSession, d: str) -> DataFrame:
    g = q.parts(s, d)
    chosen, edges = components.maximal_independent_set(g), prims.neighbours(g.active)
    inside = edges.join(chosen.toDF("src"), "src", "left_semi").join(chosen.toDF("dst"), "dst", "left_semi")
    beside = edges.join(chosen.toDF("src"), "src", "left_semi").select(F.col("dst").alias("vertex"))
    free = g.vertices.select("vertex").join(chosen, "vertex", "left_anti").join(beside, "vertex", "left_anti")
    return _none(neighbours_chosen=inside, free_left=free)


def colouring(s: SparkSession, d: str) -> DataFrame:
    g = q.supply(s, d)
    colour = components.vertex_coloring(g)
    same = prims.neighbours(g.active).join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b")
    return _none(same_colour=same, uncoloured=g.vertices.select("vertex").join(colour, "vertex", "left_anti"))


def matching(s: SparkSession, d: str) -> DataFrame:
    g = q.parts(s, d)
    pairs = community.approximate_weighted_matching(g)[0]
    taken = pairs.where("partner >= 0")
    back = taken.select(F.col("partner").alias("vertex"), F.col("vertex").alias("partner"))
    edges, free = prims.neighbours(g.active), pairs.where("partner < 0").select("vertex")
    return _none(
        one_sided=taken.select("vertex", "partner").exceptAll(back),
        no_edge=taken.select(F.col("vertex").alias("src"), F.col("partner").alias("dst")).join(edges, ["src", "dst"], "left_anti"),
        edge_left=edges.join(free.toDF("src"), "src", "left_semi").join(free.toDF("dst"), "dst", "left_semi"),
    )


def _forest(maximum: bool):
    """The forest has an edge less than vertices for each component, joins what the graph joins, and has only its edges."""

    def run(s: SparkSession, d: str) -> DataFrame:
        g = q.parts(s, d)
        tree = cores.minimum_spanning_tree(g, maximum=maximum)
        edges = tree.edges.where("src < dst")
        parts, own = components.weakly_connected_components(g), components.weakly_connected_components(tree)
        short = parts.agg((F.count(F.lit(1)) - F.countDistinct("labels")).alias("n")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("m")))).where("n != m")
        return _none(
            wrong_size=short,
            parted=parts.join(own.toDF("vertex", "own"), "vertex", "left").where("own IS NULL OR own != labels"),
            no_edge=edges.join(g.weighted_edges.select("src", "dst", F.col("weight").alias("w")), ["src", "dst"], "left").where("w IS NULL OR w != weight"),
        )

    return run


def _walks(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        g = q.parts(s, d)
        w = sampling.random_walks(g, g.vertices, 5, kind=kind, p=0.5, q=2.0)
        steps = w.select(F.explode(F.arrays_zip(F.slice("path", 1, 5).alias("src"), F.slice("path", 2, 5).alias("dst"), F.col("weights").alias("w"))).alias("x")).select("x.*")
        known = g.weighted_edges.select("src", "dst", "weight")
        return _none(
            no_edge=steps.where("dst >= 0").join(known, ["src", "dst"], "left").where("weight IS NULL OR weight != w"),
            stopped=steps.where("dst < 0 AND src >= 0"),  # of an undirected graph's vertices none is a dead end
            short=w.where("size(path) != 6"),
            missing=g.vertices.select("vertex").join(w.select(F.col("path")[0].alias("vertex")), "vertex", "left_anti"),
        )

    return run


def sampled_vertices(s: SparkSession, d: str) -> DataFrame:
    g = q.parts(s, d)
    some = structure.select_random_vertices(g, 25)
    return _none(unknown=some.join(g.vertices, "vertex", "left_anti"), repeated=some.groupBy("vertex").count().where("count > 1")).crossJoin(F.broadcast(some.agg(F.count(F.lit(1)).alias("n"))))


def negatives(s: SparkSession, d: str) -> DataFrame:
    g = q.parts(s, d)
    some = sampling.negative_sampling(g, 200)
    return _none(edges=some.join(prims.neighbours(g.active), ["src", "dst"], "left_semi"), unknown=some.select(F.col("src").alias("vertex")).union(some.select("dst")).join(g.vertices, "vertex", "left_anti"))


def _clusters(found, g: Graph) -> DataFrame:
    labels, value = found
    q_value = community.modularity(g.weighted_edges, labels.select("vertex", F.col("partition").alias("cluster"))).select((F.abs(F.col("modularity") - F.lit(float(value))) > 1e-6).alias("wrong"))
    return _none(wrong_modularity=q_value.where("wrong"), unlabelled=g.vertices.select("vertex").join(labels, "vertex", "left_anti"), repeated=labels.groupBy("vertex").count().where("count > 1"))


@scoped
def louvain(s: SparkSession, d: str) -> DataFrame:
    edges = cut(q.stored_parts(s, d).edges)
    g = Graph(edges, prims.endpoints(edges))
    return _clusters(community.louvain(g), g)


def sampled_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Three and then two outgoing edges of every vertex: none too many, none made up, none left out where there are fewer."""
    g = q.parts(s, d, True)
    found = sampling.neighbor_sample(g, g.vertices.select("vertex"), [3, 2])
    counts = found.groupBy("hop_id", "src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("m"))
    degree = g.active.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    return _none(
        wrong_number=counts.join(degree, "src").where("n != m OR n != least(out, CASE WHEN hop_id = 0 THEN 3 ELSE 2 END)"),
        no_edge=found.join(prims.neighbours(g.active).unionByName(g.active.where("src = dst").select("src", "dst")), ["src", "dst"], "left_anti"),
        missing=degree.join(counts.where("hop_id = 0").select("src"), "src", "left_anti"),
    )


def _rmat(**options):
    def run(s: SparkSession, d: str) -> DataFrame:
        e = generators.rmat(s, 20, 1 << 14, **options)
        upper = e.where("src < dst") if options.get("clip_and_flip") else e.limit(0)
        return _none(outside=e.where("src < 0 OR dst < 0 OR src >= 1048576 OR dst >= 1048576"), upper=upper).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))

    return run


def origins_to_destinations(s: SparkSession, d: str) -> DataFrame:
    g = q.parts(s, d, True)
    some = g.vertices.select("vertex").where("vertex <= 3")
    return traversal.od_shortest_distances(g, some, some)


QUERIES = {
    "maximal_independent_set_valid": independent_set,
    "vertex_coloring_valid": colouring,
    "matching_valid": matching,
    "minimum_spanning_tree_valid": _forest(False),
    "maximum_spanning_tree_valid": _forest(True),
    "uniform_random_walks_valid": _walks("uniform"),
    "biased_random_walks_valid": _walks("biased"),
    "node2vec_random_walks_valid": _walks("node2vec"),
    "select_random_vertices_valid": sampled_vertices,
    "negative_sampling_valid": negatives,
    "neighbor_sample_valid": sampled_neighbours,
    "louvain_valid": louvain,
    "rmat_valid": _rmat(),
    "rmat_clipped_valid": _rmat(clip_and_flip=True),
    "all_pairs_cosine": q._all_pairs("cosine"),
    "nodes": lambda s, d: q.parts(s, d).vertices.select("vertex"),
    "graph_size": lambda s, d: s.createDataFrame([((g := q.parts(s, d)).number_of_vertices(), g.number_of_edges(), round(g.density(), 9))], "n_vertices long, n_edges long, density double"),
    "self_loops_removed": lambda s, d: remove_self_loops(q._raw(s, d)).select("src", "dst", "weight"),
    "symmetrized": lambda s, d: symmetrize_edges(q._raw(s, d)).select("src", "dst", q._r("weight")),
    "multi_source_bfs": lambda s, d: traversal.multi_source_bfs(q.parts(s, d, True), q.parts(s, d, True).vertices.where("vertex <= 3"), 3).select("root", "vertex", F.col("distance").cast("long").alias("distance"), "predecessor"),
    "od_shortest_distances": origins_to_destinations,
}

_BFS = f"""WITH RECURSIVE {q._DIR}, {q._V}, r AS (SELECT vertex AS root, vertex, 0 AS d FROM v WHERE vertex <= 3 UNION SELECT r.root, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.vertex WHERE r.d < 3),
    m AS (SELECT root, vertex, min(d) AS d FROM r GROUP BY 1, 2)
    SELECT m.root, m.vertex, max(m.d)::BIGINT AS distance, coalesce(min(CASE WHEN b.d = m.d - 1 THEN e.src END), -1)::BIGINT AS predecessor
    FROM m LEFT JOIN e ON e.dst = m.vertex LEFT JOIN m b ON b.root = m.root AND b.vertex = e.src GROUP BY m.root, m.vertex"""
_REACH = f"WITH RECURSIVE {q._DIR}, {q._V}, r AS (SELECT vertex AS a, vertex AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"
#: Values fall to the fixed point in a few rounds; more change nothing.
_CORE = f"{q._UND}, {q._V}, n AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), " + q._iterated(
    "SELECT vertex, (SELECT count(*) FROM n WHERE src = vertex) AS x FROM v",
    "SELECT vertex, coalesce(max(least(x, k)), 0) AS x FROM v LEFT JOIN (SELECT n.src, r.x, row_number() OVER (PARTITION BY n.src ORDER BY r.x DESC) AS k FROM n JOIN @ r ON r.vertex = n.dst) ON src = vertex GROUP BY vertex",
    60,
)

ORACLE_SQL = {
    "maximal_independent_set_valid": _zeros("neighbours_chosen", "free_left"),
    "vertex_coloring_valid": _zeros("same_colour", "uncoloured"),
    "matching_valid": _zeros("one_sided", "no_edge", "edge_left"),
    "minimum_spanning_tree_valid": _zeros("wrong_size", "parted", "no_edge"),
    "maximum_spanning_tree_valid": _zeros("wrong_size", "parted", "no_edge"),
    **{f"{k}_random_walks_valid": _zeros("no_edge", "stopped", "short", "missing") for k in ("uniform", "biased", "node2vec")},
    "select_random_vertices_valid": _zeros("unknown", "repeated") + ", 25::BIGINT AS n",
    "negative_sampling_valid": _zeros("edges", "unknown"),
    "neighbor_sample_valid": _zeros("wrong_number", "no_edge", "missing"),
    "louvain_valid": _zeros("wrong_modularity", "unlabelled", "repeated"),
    "rmat_valid": _zeros("outside", "upper") + ", 16384::BIGINT AS n",
    "rmat_clipped_valid": _zeros("outside", "upper") + ", 16384::BIGINT AS n",
    "all_pairs_cosine": f"WITH {q._UND} SELECT DISTINCT a.src AS first, b.src AS second, 1.0::DOUBLE AS cosine_coeff FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src ORDER BY first, second LIMIT 200",
    "nodes": f"WITH {q._RAW}, {q._V} SELECT vertex FROM v",
    "self_loops_removed": f"WITH {q._RAW} SELECT src, dst, weight FROM raw WHERE src <> dst",
    "multi_source_bfs": _BFS,
    "strongly_connected_components": f"{_REACH} SELECT x.a AS vertex, min(x.b) AS labels FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a",
    "core_number": f"WITH {_CORE} SELECT vertex, x::BIGINT AS core_number FROM r60",
    "k_core": f"WITH {_CORE}, c AS (SELECT vertex FROM r60 WHERE x >= 3) SELECT src, dst FROM e WHERE src IN (FROM c) AND dst IN (FROM c)",
}
