"""Queries of the graph operators over the driver's tables, with their SQL where SQL can say it.

The graph of parts joins the parts of consecutive lines of an order; weights are pieces of the first.  The graph of supply joins parts and suppliers.

Queries called x_whole ask x of all vertices, or of all pairs with a common neighbour; x itself asks the few ids of its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import centrality, community, components, cores, generators, layout, sampling, similarity, structure, traversal
from ..sources import tables
from ..sources.graph import Graph, coarsen, dense_ids, remove_multi_edges, symmetrize_edges
from .runtime import cut, scoped

SUPPLIERS = 1_000_000_000


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    some = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = some.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return some.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst", F.col("l_quantity").alias("weight"))


def parts(spark: SparkSession, d: str, directed: bool = False) -> Graph:
    return Graph.from_edgelist(_raw(spark, d), weight="weight", directed=directed)


def stored_parts(spark: SparkSession, d: str) -> Graph:
    """parts with its lines joined and written first: what that shuffled is freed before edges are made."""
    return Graph.from_edgelist(cut(_raw(spark, d)), weight="weight")


def supply(spark: SparkSession, d: str) -> Graph:
    pairs = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst"))
    return Graph.from_edgelist(pairs)


def _nodes(spark: SparkSession, d: str, below: int) -> DataFrame:
    return parts(spark, d).vertices.where(F.col("vertex") < below)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return centrality.pagerank(supply(spark, d), n_iter=10).orderBy(F.desc("pagerank"), "vertex").limit(100)


def _rounded(value, digits: int = 6):
    """As SQL rounds a double: the double nearest to value * 10 ** digits decides what lies half-way, not the shortest decimal that F.round reads."""
    return F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def _r(column: str, digits: int = 6):
    return _rounded(F.col(column), digits).alias(column)


def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).vertices.where("vertex < 40").select(F.col("vertex").alias("first")).crossJoin(parts(spark, d).vertices.where("vertex < 40").select(F.col("vertex").alias("second"))).where("first < second")


def _similar(name: str, weighted: bool, whole: bool = False):
    @scoped
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = stored_parts(spark, d) if whole else parts(spark, d)
        found = similarity.similarity(g, name, None if whole else q_pairs(spark, d), use_weight=weighted)
        c = f"{name}_coeff"
        return found.select("first", "second", _rounded(F.when(F.isnan(c), None).otherwise(F.col(c))).alias(c))

    return run


def _all_pairs(name: str):
    @scoped
    def run(spark: SparkSession, d: str) -> DataFrame:
        return similarity.all_pairs(stored_parts(spark, d), name, topk=200).select("first", "second", _r(f"{name}_coeff"))

    return run


def q_hypergraph(spark: SparkSession, d: str) -> DataFrame:
    h = tables.hypergraph(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], event_id="o_orderkey", drop_edge_attrs=True)
    return h["edges"].groupBy("edge_type", "attribute_id").agg(F.count(F.lit(1)).alias("n"))


def q_clusters(g: Graph) -> DataFrame:
    return g.vertices.select("vertex", (F.col("vertex") % 7).alias("cluster"))


def q_renumber(spark: SparkSession, d: str) -> DataFrame:
    return dense_ids(_table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct(), ["c_nationkey", "c_mktsegment"])


def q_sample(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    g = parts(spark, d, True)
    s = sampling.neighbor_sample(g, g.vertices.select("vertex") if whole else _nodes(spark, d, 20), [-1, -1])
    return s.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("hop_id").cast("long").alias("hop_id"), "src", "dst", "weight")


def q_temporal(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """From three customers (or all) to parts they ordered, and on to customers who ordered those later."""
    o = _table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + SUPPLIERS).alias("c"), F.unix_timestamp("o_orderdate").alias("t"))
    e = o.join(_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p")).distinct(), "o_orderkey")
    both = e.select(F.col("c").alias("src"), F.col("p").alias("dst"), "t").unionByName(e.select(F.col("p").alias("src"), F.col("c").alias("dst"), "t")).distinct()
    g = Graph.from_edgelist(both, start_time="t", directed=True, multi=True)
    starts = e.select(F.col("c").alias("vertex")).distinct() if whole else spark.range(3).select((F.col("id") + SUPPLIERS).alias("vertex"))
    s = sampling.neighbor_sample(g, starts, [-1, -1], temporal=">")
    return s.select(F.col("hop_id").cast("long").alias("hop_id"), "src", "dst", "start_time").distinct()


def _walks(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = parts(spark, d)
        return sampling.random_walks(g, g.vertices, 5, kind=kind, p=0.5, q=2.0)

    return run


def q_bc_roots(spark: SparkSession, d: str) -> DataFrame:
    g = parts(spark, d)
    return centrality.betweenness_centrality(g, roots=_nodes(spark, d, 5))


QUERIES = {
    "graph_edges": lambda s, d: parts(s, d).edges.select("src", "dst", _r("weight")),
    "graph_edges_directed": lambda s, d: parts(s, d, True).edges,
    "graph_multi_edges_removed": lambda s, d: remove_multi_edges(_raw(s, d)),
    "graph_reciprocal": lambda s, d: symmetrize_edges(remove_multi_edges(_raw(s, d)), reciprocal=True).select("src", "dst", _r("weight")),
    "graph_transposed": lambda s, d: parts(s, d, True).transposed().edges.select("src", "dst", "weight"),
    "graph_masked": lambda s, d: structure.degrees(parts(s, d, True).attach_edge_mask(F.col("weight") > 40)),
    "renumber": q_renumber,
    "hypergraph": q_hypergraph,
    "coarsen": lambda s, d: coarsen(parts(s, d).weighted_edges, q_clusters(parts(s, d))).select("src", "dst", _r("weight")),
    "adjacency_list": lambda s, d: parts(s, d, True).view_adj_list().select("src", F.array_join(F.transform("dsts", lambda x: x.cast("string")), ",").alias("dsts")),
    "degrees": lambda s, d: structure.degrees(parts(s, d)),
    "degree_centrality": lambda s, d: structure.degree_centrality(parts(s, d)).select("vertex", _r("degree_centrality", 9)),
    "weight_sums": lambda s, d: structure.weight_sums(parts(s, d, True)),
    "max_in_weight": lambda s, d: structure.weight_sums(parts(s, d, True), "in", F.max),
    "total_edge_weight": lambda s, d: structure.total_edge_weight(parts(s, d, True)),
    "count_multi_edges": lambda s, d: structure.count_multi_edges(_raw(s, d)),
    "count_self_loops": lambda s, d: structure.count_self_loops(_raw(s, d)),
    "has_edge": lambda s, d: parts(s, d).has_edge(q_pairs(s, d).toDF("src", "dst")),
    "two_hop_neighbors": lambda s, d: structure.two_hop_neighbors(parts(s, d), _nodes(s, d, 100)),
    "k_hop_nbrs": lambda s, d: structure.k_hop_nbrs(parts(s, d, True), _nodes(s, d, 20), 3),
    "induced_subgraph": lambda s, d: structure.induced_subgraph(parts(s, d, True), _nodes(s, d, 500)),
    "ego_graph": lambda s, d: structure.ego_graph(parts(s, d), _nodes(s, d, 10), 1).select("seed", "src", "dst"),
    "select_random_vertices": lambda s, d: structure.select_random_vertices(parts(s, d), 25),
    "pagerank": lambda s, d: centrality.pagerank(supply(s, d), n_iter=6).select("vertex", _r("pagerank", 9)),
    "pagerank_weighted": lambda s, d: centrality.pagerank(parts(s, d, True), n_iter=5).select("vertex", _r("pagerank", 9)),
    "pagerank_personalized": lambda s, d: centrality.pagerank(parts(s, d, True), personalization=_nodes(s, d, 10).select("vertex", F.lit(1.0).alias("value")), n_iter=5).select("vertex", _r("pagerank", 9)),
    "hits": lambda s, d: centrality.hits(parts(s, d, True), n_iter=4).select("vertex", _r("hubs", 9), _r("authorities", 9)),
    "katz_centrality": lambda s, d: centrality.katz_centrality(parts(s, d, True), alpha=0.0001, n_iter=5).select("vertex", _r("katz_centrality", 9)),
    "eigenvector_centrality": lambda s, d: centrality.eigenvector_centrality(parts(s, d), n_iter=4).select("vertex", _r("eigenvector_centrality", 9)),
    "betweenness_sampled": q_bc_roots,
    "bfs": lambda s, d: traversal.bfs(parts(s, d, True), _nodes(s, d, 3), 6).select("vertex", F.col("distance").cast("long").alias("distance"), "predecessor"),
    "sssp": lambda s, d: traversal.sssp(parts(s, d, True), _nodes(s, d, 100).agg(F.min("vertex")).first()[0]).select("vertex", "distance"),
    "weakly_connected_components": lambda s, d: components.weakly_connected_components(parts(s, d)),
    "strongly_connected_components": lambda s, d: components.strongly_connected_components(parts(s, d, True)),
    "core_number": lambda s, d: cores.core_number(parts(s, d)),
    "k_core": lambda s, d: cores.k_core(parts(s, d), 3).edges.select("src", "dst"),
    "triangle_count": lambda s, d: cores.triangle_count(parts(s, d)),
    "edge_triangle_count": lambda s, d: cores.edge_triangle_count(parts(s, d)),
    "k_truss": lambda s, d: cores.k_truss(parts(s, d), 3).edges.select("src", "dst"),
    "modularity": lambda s, d: community.modularity(parts(s, d).weighted_edges, q_clusters(parts(s, d))).select(_r("modularity")),
    "edge_cut": lambda s, d: community.edge_cut(parts(s, d).weighted_edges, q_clusters(parts(s, d))).select(_r("edge_cut")),
    "ratio_cut": lambda s, d: community.ratio_cut(parts(s, d).weighted_edges, q_clusters(parts(s, d))).select(_r("ratio_cut")),
    "jaccard": _similar("jaccard", False), "sorensen": _similar("sorensen", False), "overlap": _similar("overlap", False), "cosine": _similar("cosine", False),
    "jaccard_weighted": _similar("jaccard", True), "sorensen_weighted": _similar("sorensen", True), "overlap_weighted": _similar("overlap", True), "cosine_weighted": _similar("cosine", True),
    "all_pairs_jaccard": _all_pairs("jaccard"), "all_pairs_sorensen": _all_pairs("sorensen"), "all_pairs_overlap": _all_pairs("overlap"),
    "neighbor_sample": q_sample,
    "temporal_neighbor_sample": q_temporal,
    "uniform_random_walks": _walks("uniform"), "biased_random_walks": _walks("biased"), "node2vec_random_walks": _walks("node2vec"),
    "negative_sampling": lambda s, d: sampling.negative_sampling(parts(s, d), 200),
    "rmat": lambda s, d: generators.rmat(s, 10, 4096),
    "mesh_2d": lambda s, d: generators.mesh_2d(s, 5, 4),
    "mesh_3d": lambda s, d: generators.mesh_3d(s, 3, 4, 2),
    "complete_graph": lambda s, d: generators.complete_graph(s, 12),
    "path_graph": lambda s, d: generators.path_graph(s, 9),
    "hungarian": lambda s, d: layout.hungarian(parts(s, d), _nodes(s, d, 30))[1],
    **{f"{n}_whole": _similar(n, False, True) for n in similarity.NAMES},
    **{f"{n}_weighted_whole": _similar(n, True, True) for n in similarity.NAMES},
    "has_edge_whole": lambda s, d: parts(s, d).has_edge(structure.two_hop_neighbors(parts(s, d)).toDF("src", "dst")),
    "two_hop_neighbors_whole": lambda s, d: structure.two_hop_neighbors(parts(s, d)),
    "k_hop_nbrs_whole": lambda s, d: structure.k_hop_nbrs(parts(s, d, True), parts(s, d, True).vertices, 3),
    "induced_subgraph_whole": lambda s, d: structure.induced_subgraph(parts(s, d, True), parts(s, d, True).vertices),
    "ego_graph_whole": lambda s, d: structure.ego_graph(parts(s, d), parts(s, d).vertices, 1).select("seed", "src", "dst"),
    "neighbor_sample_whole": lambda s, d: q_sample(s, d, True),
    "temporal_neighbor_sample_whole": lambda s, d: q_temporal(s, d, True),
}

_RAW = """raw AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_quantity AS weight FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_DIR = f"{_RAW}, e AS (SELECT src, dst, min(weight) AS weight FROM raw GROUP BY src, dst)"
_UND = f"""{_RAW}, s AS (SELECT src, dst, min(weight) AS weight FROM raw GROUP BY src, dst),
    e AS (SELECT src, dst, avg(weight) AS weight FROM (SELECT * FROM s UNION ALL SELECT dst, src, weight FROM s WHERE src <> dst) GROUP BY src, dst)"""
_V = "v AS (SELECT DISTINCT vertex FROM (SELECT src AS vertex FROM raw UNION ALL SELECT dst FROM raw))"
_C = "c AS (SELECT vertex, vertex % 7 AS cluster FROM v)"
_P = "p AS (SELECT a.vertex AS first, b.vertex AS second FROM v a, v b WHERE a.vertex < b.vertex AND b.vertex < 40)"
_TWO = "p AS (SELECT DISTINCT a.src AS first, b.dst AS second FROM e a JOIN e b ON a.dst = b.src)"


def _degree_sql(where: str = "") -> str:
    return f"""SELECT vertex, count(*) FILTER (k = 0)::BIGINT AS in_degree, count(*) FILTER (k = 1)::BIGINT AS out_degree, count(k)::BIGINT AS degree
        FROM v LEFT JOIN (SELECT src AS x, 1 AS k FROM e {where} UNION ALL SELECT dst, 0 FROM e {where}) ON x = vertex GROUP BY vertex"""


def _pagerank_sql(with_: str, n_iter: int, weight: str = "weight", teleport: str = "1.0 / (SELECT count(*) FROM v)") -> str:
    rounds = [f"""w AS (SELECT src, dst, {weight} / sum({weight}) OVER (PARTITION BY src) AS w FROM e),
        b AS (SELECT vertex, {teleport} AS t, CAST(vertex NOT IN (SELECT src FROM e) AS INT) AS sink FROM v),
        r0 AS (SELECT vertex, 1.0 / (SELECT count(*) FROM v) AS x FROM v)"""]
    for i in range(n_iter):
        rounds.append(f"""r{i + 1} AS (SELECT b.vertex, 0.85 * coalesce(sum(w.w * r.x), 0) + (0.85 * (SELECT sum(x * sink) FROM r{i} JOIN b USING (vertex)) + 0.15) * max(b.t) AS x
            FROM b LEFT JOIN w ON w.dst = b.vertex LEFT JOIN r{i} r ON r.vertex = w.src GROUP BY b.vertex)""")
    return f"WITH {with_}, {', '.join(rounds)} SELECT vertex, round(x, 9) AS pagerank FROM r{n_iter}"


def _iterated(first: str, step: str, n: int) -> str:
    return ", ".join([f"r0 AS ({first})", *[f"r{i + 1} AS ({step.replace('@', f'r{i}')})" for i in range(n)]])


def _similar_sql(name: str, weighted: bool, pairs: str = _P) -> str:
    w = "weight" if weighted else "1.0"
    down = {"jaccard": "wa + wb - b", "sorensen": "wa + wb", "overlap": "least(wa, wb)"}.get(name)
    up = "2 * b" if name == "sorensen" else "b"
    if name == "cosine":
        score = "CASE WHEN n > 0 THEN dot / (sqrt(na) * sqrt(nb)) END" if weighted else "CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END"
    else:
        score = f"CASE WHEN {down} > 0 THEN {up} / ({down}) ELSE 0.0 END"
    return f"""WITH {_UND}, {_V}, {pairs}, x AS (SELECT src, dst, ({w})::DOUBLE AS w FROM e), t AS (SELECT src, sum(w) AS w FROM x GROUP BY src),
        h AS (SELECT first, second, count(*) AS n, sum(least(a.w, b.w)) AS b, sum(a.w * b.w) AS dot, sum(a.w * a.w) AS na, sum(b.w * b.w) AS nb
            FROM p JOIN x a ON a.src = first JOIN x b ON b.src = second AND b.dst = a.dst GROUP BY 1, 2),
        f AS (SELECT p.first, p.second, coalesce(n, 0) AS n, coalesce(b, 0.0) AS b, dot, na, nb, coalesce(ta.w, 0.0) AS wa, coalesce(tb.w, 0.0) AS wb
            FROM p LEFT JOIN h USING (first, second) LEFT JOIN t ta ON ta.src = p.first LEFT JOIN t tb ON tb.src = p.second)
        SELECT first, second, round(({score})::DOUBLE, 6) AS {name}_coeff FROM f"""


def _all_pairs_sql(name: str) -> str:
    down = {"jaccard": "da + db - n", "sorensen": "da + db", "overlap": "least(da, db)"}[name]
    up = "2.0 * n" if name == "sorensen" else "1.0 * n"
    return f"""WITH {_UND}, t AS (SELECT src, count(*) AS d FROM e GROUP BY src),
        h AS (SELECT a.src AS first, b.src AS second, count(*) AS n FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2),
        f AS (SELECT first, second, n, x.d AS da, y.d AS db FROM h JOIN t x ON x.src = first JOIN t y ON y.src = second)
        SELECT first, second, round(({up} / ({down}))::DOUBLE, 6) AS {name}_coeff FROM f ORDER BY {up} / ({down}) DESC, first, second LIMIT 200"""


_TRI = """n AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
    t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM n x JOIN n y ON y.src = x.dst AND x.src < x.dst AND x.dst < y.dst JOIN n z ON z.src = x.src AND z.dst = y.dst)"""

ORACLE_SQL = {
    "graph_edges": f"WITH {_UND} SELECT src, dst, round(weight, 6) AS weight FROM e",
    "graph_edges_directed": f"WITH {_DIR} SELECT * FROM e",
    "graph_multi_edges_removed": f"WITH {_DIR} SELECT * FROM e",
    "graph_reciprocal": f"WITH {_DIR}, r AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)) SELECT src, dst, round(avg(weight), 6) AS weight FROM (SELECT * FROM r UNION ALL SELECT dst, src, weight FROM r WHERE src <> dst) GROUP BY src, dst",
    "graph_transposed": f"WITH {_DIR} SELECT dst AS src, src AS dst, weight FROM e",
    "graph_masked": f"WITH {_DIR}, {_V} {_degree_sql('WHERE weight > 40')}",
    "renumber": "SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS id, c_nationkey, c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)",
    "hypergraph": "SELECT edge_type, attribute_id, count(*) AS n FROM (SELECT 'o_orderstatus' AS edge_type, 'o_orderstatus::' || o_orderstatus AS attribute_id FROM orders UNION ALL SELECT 'o_orderpriority', 'o_orderpriority::' || o_orderpriority FROM orders) WHERE attribute_id IS NOT NULL GROUP BY 1, 2",
    "coarsen": f"WITH {_UND} SELECT src % 7 AS src, dst % 7 AS dst, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2",
    "adjacency_list": f"WITH {_DIR} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts FROM e GROUP BY src",
    "degrees": f"WITH {_UND}, {_V} {_degree_sql()}",
    "degree_centrality": f"WITH {_UND}, {_V} SELECT vertex, round(degree / ((SELECT count(*) FROM v) - 1.0), 9)::DOUBLE AS degree_centrality FROM ({_degree_sql()})",
    "weight_sums": f"WITH {_DIR}, {_V} SELECT vertex, coalesce(sum(weight), 0.0) AS value FROM v LEFT JOIN e ON src = vertex GROUP BY vertex",
    "max_in_weight": f"WITH {_DIR}, {_V} SELECT vertex, coalesce(max(weight), 0.0) AS value FROM v LEFT JOIN e ON dst = vertex GROUP BY vertex",
    "total_edge_weight": f"WITH {_DIR} SELECT sum(weight) AS total_weight FROM e",
    "count_multi_edges": f"WITH {_RAW} SELECT (count(*) - count(DISTINCT (src, dst)))::BIGINT AS n_multi_edges FROM raw",
    "count_self_loops": f"WITH {_RAW} SELECT count(*) AS n_self_loops FROM raw WHERE src = dst",
    "has_edge": f"WITH {_UND}, {_V}, {_P} SELECT first AS src, second AS dst, count(e.src) AS multiplicity FROM p LEFT JOIN e ON e.src = first AND e.dst = second GROUP BY 1, 2",
    "two_hop_neighbors": f"WITH {_UND} SELECT DISTINCT a.src AS first, b.dst AS second FROM e a JOIN e b ON a.dst = b.src WHERE a.src < 100",
    "k_hop_nbrs": f"WITH {_DIR} SELECT DISTINCT a.src AS start, c.dst AS vertex FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src < 20",
    "induced_subgraph": f"WITH {_DIR} SELECT src, dst, weight FROM e WHERE src < 500 AND dst < 500",
    "ego_graph": f"WITH {_UND}, {_V}, m AS (SELECT vertex AS seed, vertex FROM v WHERE vertex < 10 UNION SELECT src, dst FROM e WHERE src < 10) SELECT a.seed, e.src, e.dst FROM e JOIN m a ON a.vertex = e.src JOIN m b ON b.vertex = e.dst AND a.seed = b.seed",
    "pagerank": _pagerank_sql(f"raw AS (SELECT DISTINCT l_partkey AS src, l_suppkey + {SUPPLIERS} AS dst FROM lineitem), e AS (SELECT src, dst, 1.0 AS weight FROM raw UNION ALL SELECT dst, src, 1.0 FROM raw), {_V}", 6),
    "pagerank_weighted": _pagerank_sql(f"{_DIR}, {_V}", 5),
    "pagerank_personalized": _pagerank_sql(f"{_DIR}, {_V}", 5, teleport="CASE WHEN vertex < 10 THEN 1.0 / (SELECT count(*) FROM v WHERE vertex < 10) ELSE 0.0 END"),
    "hits": f"WITH {_DIR}, {_V}, " + _iterated(
        "SELECT vertex, 1.0::DOUBLE / (SELECT count(*) FROM v) AS h, 0.0::DOUBLE AS a FROM v",
        "SELECT vertex, h / max(h) OVER () AS h, a / max(a) OVER () AS a FROM (SELECT x.vertex, coalesce(h, 0.0) AS h, x.a FROM (SELECT v.vertex, coalesce(sum(r.h), 0.0) AS a FROM v LEFT JOIN e ON e.dst = v.vertex LEFT JOIN @ r ON r.vertex = e.src GROUP BY v.vertex) x LEFT JOIN (SELECT e.src AS vertex, sum(y.a) AS h FROM e JOIN (SELECT e.dst AS vertex, sum(r.h) AS a FROM e JOIN @ r ON r.vertex = e.src GROUP BY e.dst) y ON y.vertex = e.dst GROUP BY e.src) z ON z.vertex = x.vertex)",
        4) + " SELECT vertex, round(h / sum(h) OVER (), 9) AS hubs, round(a / sum(a) OVER (), 9) AS authorities FROM r4",
    "katz_centrality": f"WITH {_DIR}, {_V}, " + _iterated(
        "SELECT vertex, 0.0::DOUBLE AS x FROM v",
        "SELECT v.vertex, 1.0 + 0.0001 * coalesce(sum(e.weight * r.x), 0.0) AS x FROM v LEFT JOIN e ON e.dst = v.vertex LEFT JOIN @ r ON r.vertex = e.src GROUP BY v.vertex",
        5) + " SELECT vertex, round(x / sqrt(sum(x * x) OVER ()), 9) AS katz_centrality FROM r5",
    "eigenvector_centrality": f"WITH {_UND}, {_V}, " + _iterated(
        "SELECT vertex, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v",
        "SELECT vertex, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT o.vertex, max(o.x) + coalesce(sum(e.weight * r.x), 0.0) AS x FROM @ o LEFT JOIN e ON e.dst = o.vertex LEFT JOIN @ r ON r.vertex = e.src GROUP BY o.vertex)",
        4) + " SELECT vertex, round(x, 9) AS eigenvector_centrality FROM r4",
    "bfs": f"""WITH RECURSIVE {_DIR}, {_V}, r AS (SELECT vertex, 0 AS d FROM v WHERE vertex < 3 UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.vertex WHERE r.d < 6),
        m AS (SELECT vertex, min(d) AS d FROM r GROUP BY vertex)
        SELECT v.vertex, coalesce(max(m.d), {traversal.MAX_INT})::BIGINT AS distance, coalesce(min(CASE WHEN b.d = m.d - 1 THEN e.src END), -1)::BIGINT AS predecessor
        FROM v LEFT JOIN m USING (vertex) LEFT JOIN e ON e.dst = v.vertex LEFT JOIN m b ON b.vertex = e.src GROUP BY v.vertex""",
    "weakly_connected_components": f"WITH RECURSIVE {_UND}, {_V}, r AS (SELECT vertex, vertex AS c FROM v UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.vertex WHERE r.c < e.dst) SELECT vertex, min(c) AS labels FROM r GROUP BY vertex",
    "triangle_count": f"WITH {_UND}, {_V}, {_TRI} SELECT vertex, count(x)::BIGINT AS counts FROM v LEFT JOIN (SELECT a AS x FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) ON x = vertex GROUP BY vertex",
    "edge_triangle_count": f"WITH {_UND}, {_TRI}, u3 AS (SELECT a AS u, b AS w FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) SELECT src, dst, count(u)::BIGINT AS counts FROM n LEFT JOIN u3 ON u = least(src, dst) AND w = greatest(src, dst) GROUP BY src, dst",
    "modularity": f"WITH {_UND}, {_V}, {_C}, t AS (SELECT a.cluster, sum(weight) AS d, sum(CASE WHEN a.cluster = b.cluster THEN weight ELSE 0 END) AS i FROM e JOIN c a ON a.vertex = src JOIN c b ON b.vertex = dst GROUP BY 1) SELECT round(sum(i) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6) AS modularity FROM t",
    "edge_cut": f"WITH {_UND} SELECT round(sum(weight) / 2, 6) AS edge_cut FROM e WHERE src % 7 <> dst % 7",
    "ratio_cut": f"WITH {_UND}, {_V}, w AS (SELECT src % 7 AS k, sum(weight) AS w FROM e WHERE src % 7 <> dst % 7 GROUP BY 1), z AS (SELECT vertex % 7 AS k, count(*) AS n FROM v GROUP BY 1) SELECT round(sum(w / n), 6) AS ratio_cut FROM w JOIN z USING (k)",
    **{n: _similar_sql(n, False) for n in similarity.NAMES},
    **{f"{n}_weighted": _similar_sql(n, True) for n in similarity.NAMES},
    **{f"all_pairs_{n}": _all_pairs_sql(n) for n in similarity.NAMES[:3]},
    **{f"{n}_whole": _similar_sql(n, False, _TWO) for n in similarity.NAMES},
    **{f"{n}_weighted_whole": _similar_sql(n, True, _TWO) for n in similarity.NAMES},
    "has_edge_whole": f"WITH {_UND}, {_TWO} SELECT first AS src, second AS dst, count(e.src) AS multiplicity FROM p LEFT JOIN e ON e.src = first AND e.dst = second GROUP BY 1, 2",
    "two_hop_neighbors_whole": f"WITH {_UND}, {_TWO} SELECT first, second FROM p",
    "k_hop_nbrs_whole": f"WITH {_DIR} SELECT DISTINCT a.src AS start, c.dst AS vertex FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src",
    "induced_subgraph_whole": f"WITH {_DIR} SELECT src, dst, weight FROM e",
    "ego_graph_whole": f"WITH {_UND}, {_V}, m AS (SELECT vertex AS seed, vertex FROM v UNION SELECT src, dst FROM e) SELECT a.seed, e.src, e.dst FROM e JOIN m a ON a.vertex = e.src JOIN m b ON b.vertex = e.dst AND a.seed = b.seed",
    "neighbor_sample_whole": f"WITH {_DIR}, h AS (SELECT 0::BIGINT AS batch_id, 0::BIGINT AS hop_id, src, dst, weight FROM e) SELECT * FROM h UNION ALL SELECT 0, 1, src, dst, weight FROM e WHERE src IN (SELECT dst FROM h)",
    "temporal_neighbor_sample_whole": f"""WITH b AS (SELECT DISTINCT o_custkey + {SUPPLIERS} AS c, l_partkey AS p, epoch(o_orderdate)::BIGINT AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
        SELECT 0::BIGINT AS hop_id, c AS src, p AS dst, t AS start_time FROM b UNION SELECT 1, b.p, b.c, b.t FROM b h JOIN b ON b.p = h.p AND b.t > h.t""",
    "neighbor_sample": f"WITH {_DIR}, {_V}, h AS (SELECT 0 AS batch_id, 0 AS hop_id, src, dst, weight FROM e WHERE src < 20) SELECT batch_id::BIGINT AS batch_id, hop_id::BIGINT AS hop_id, src, dst, weight FROM (SELECT * FROM h UNION ALL SELECT 0, 1, src, dst, weight FROM e WHERE src IN (SELECT dst FROM h))",
    "temporal_neighbor_sample": f"""WITH b AS (SELECT DISTINCT o_custkey + {SUPPLIERS} AS c, l_partkey AS p, epoch(o_orderdate)::BIGINT AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        h AS (SELECT c AS src, p AS dst, t FROM b WHERE c < {SUPPLIERS} + 3)
        SELECT 0::BIGINT AS hop_id, src, dst, t AS start_time FROM h UNION SELECT 1, b.p, b.c, b.t FROM h JOIN b ON b.p = h.dst AND b.t > h.t""",
    "sssp": f"""WITH RECURSIVE {_DIR}, {_V}, r AS (SELECT min(vertex) AS vertex, 0.0::DOUBLE AS d, 0 AS n FROM v WHERE vertex < 100
            UNION SELECT vertex, d, n FROM (SELECT e.dst AS vertex, min(r.d + e.weight) AS d, r.n + 1 AS n FROM r JOIN e ON e.src = r.vertex WHERE r.n < 40 GROUP BY e.dst, r.n + 1))
        SELECT v.vertex, coalesce(min(r.d), {traversal.MAX_DOUBLE})::DOUBLE AS distance FROM v LEFT JOIN r USING (vertex) GROUP BY v.vertex""",
    "mesh_2d": "SELECT i + 5 * j AS src, i + 5 * j + 1 AS dst FROM range(5) a(i), range(4) b(j) WHERE i < 4 UNION ALL SELECT i + 5 * j, i + 5 * j + 5 FROM range(5) a(i), range(4) b(j) WHERE j < 3",
    "mesh_3d": "SELECT i + 3 * j + 12 * k AS src, i + 3 * j + 12 * k + s AS dst FROM range(3) a(i), range(4) b(j), range(2) c(k), (VALUES (1), (3), (12)) d(s) WHERE (s = 1 AND i < 2) OR (s = 3 AND j < 3) OR (s = 12 AND k < 1)",
    "complete_graph": "SELECT a AS src, b AS dst FROM range(12) x(a), range(12) y(b) WHERE a < b",
    "path_graph": "SELECT a AS src, a + 1 AS dst FROM range(8) x(a)",
}
