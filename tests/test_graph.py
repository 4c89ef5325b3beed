"""Golden values on small graphs, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import centrality, community, components, cores, generators, layout, sampling, similarity, structure, traversal
from graphloom.sources.graph import Graph

SRC, DST = [0, 1, 1, 2, 2, 2, 3, 4], [1, 3, 4, 0, 1, 3, 5, 5]
W = [0.1, 2.1, 1.1, 5.1, 3.1, 4.1, 7.2, 3.2]


@pytest.fixture(scope="module")
def d8(spark):
    e = spark.createDataFrame(list(zip(SRC, DST, W)), "src long, dst long, weight double")
    return Graph.from_edgelist(e, weight="weight", directed=True)


@pytest.fixture(scope="module")
def u16(spark):
    e = spark.createDataFrame(list(zip(SRC, DST, W)), "src long, dst long, weight double")
    return Graph.from_edgelist(e, weight="weight")


def column(df, name, key="vertex"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_pagerank(d8):
    got = column(centrality.pagerank(d8, alpha=0.95, tol=1e-4, max_iter=20, fail_on_nonconvergence=False), "pagerank")
    assert np.allclose(got, [0.0915528, 0.168382, 0.0656831, 0.191468, 0.120677, 0.362237], atol=1e-3)


def test_katz(d8):
    got = column(centrality.katz_centrality(d8, alpha=0.01, n_iter=8), "katz_centrality")
    assert np.allclose(got, [0.410614, 0.403211, 0.390689, 0.415175, 0.395125, 0.433226], atol=1e-4)


def test_betweenness(u16, d8, spark):
    assert np.allclose(column(centrality.betweenness_centrality(u16, normalized=False), "betweenness_centrality"), [0, 3.66667, 0.833333, 2.16667, 0.833333, 0.5], atol=1e-4)
    assert np.allclose(column(centrality.betweenness_centrality(d8, normalized=False), "betweenness_centrality"), [0, 4, 0, 2, 1, 0], atol=1e-6)
    roots = spark.createDataFrame([(0,), (3,)], "vertex long")
    assert np.allclose(column(centrality.betweenness_centrality(u16, roots=roots), "betweenness_centrality"), [0, 0.395833, 0.166667, 0.166667, 0.0416667, 0.0625], atol=1e-4)


def test_similarity(u16, spark):
    pairs = spark.createDataFrame([(0, 1), (0, 3), (0, 4), (1, 2), (1, 3), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4)], "first long, second long")
    expect = {"jaccard": [0.2, 0.666667, 0.333333, 0.4, 0.166667, 0.5, 0.2, 0.25, 0.25, 0.666667], "overlap": [0.5, 1, 0.5, 0.666667, 0.333333, 1, 0.333333, 0.5, 0.5, 1]}
    for name, values in expect.items():
        got = [r[2] for r in similarity.similarity(u16, name, pairs).orderBy("first", "second").collect()]
        assert np.allclose(got, values, atol=1e-5)


def test_sssp_and_bfs(d8, spark):
    got = traversal.sssp(d8, 0, cutoff=10.0)
    assert np.allclose(column(got, "distance"), [0, 0.1, traversal.MAX_DOUBLE, 2.2, 1.2, 4.4])
    assert column(got, "predecessor") == [-1, 0, -1, 1, 1, 4]
    with pytest.raises(ValueError):
        traversal.sssp(d8, 99)
    tree = traversal.bfs(d8, spark.createDataFrame([(0,)], "vertex long"))
    assert column(tree, "distance") == [0, 1, traversal.MAX_INT, 2, 2, 3]
    paths = {r[0]: r[1] for r in traversal.extract_paths(tree, spark.createDataFrame([(5,), (2,)], "vertex long")).collect()}
    assert paths == {5: [0, 1, 3, 5], 2: []}


def test_communities(u16):
    labels = u16.vertices.select("vertex", (u16.vertices["vertex"] >= 3).cast("int").alias("cluster"))
    assert abs(community.modularity(u16.weighted_edges, labels).first()[0] - 0.215969) < 1e-5
    _, q = community.louvain(u16)
    assert q > 0.2


def test_ecg_default_is_the_reference_signature():
    from inspect import signature

    assert signature(community.ecg).parameters["ensemble_size"].default == 100


def test_degrees_cores_trees(d8, u16):
    d = structure.degrees(d8)
    assert column(d, "in_degree") == [1, 2, 0, 2, 1, 2] and column(d, "out_degree") == [1, 2, 3, 1, 1, 0]
    assert {(r[0], r[1]) for r in cores.triangle_count(u16).collect()} >= {(0, 1), (1, 2), (2, 2), (4, 0)}
    assert cores.k_truss(u16, 3).edges.count() == 10
    tree = {(r["src"], r["dst"]) for r in cores.minimum_spanning_tree(u16).edges.where("src < dst").collect()}
    assert tree == {(0, 1), (1, 2), (1, 3), (1, 4), (4, 5)}


def test_components(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 5)], "src long, dst long")
    g = Graph.from_edgelist(e, directed=True)
    assert column(components.strongly_connected_components(g), "labels") == [0, 0, 0, 3, 4, 5]
    assert column(components.weakly_connected_components(g), "labels") == [0, 0, 0, 0, 0, 5]
    colors = dict(components.vertex_coloring(g).collect())
    assert all(colors[a] != colors[b] for a, b in e.where("src != dst").collect())


def test_ingest_rules(spark):
    e = spark.createDataFrame([(0, 1, 3.0), (0, 1, 1.0), (1, 0, 5.0), (2, 2, 7.0)], "a long, b long, w double")
    g = Graph.from_edgelist(e, "a", "b", weight="w")
    assert {tuple(r) for r in g.edges.collect()} == {(0, 1, 3.0), (1, 0, 3.0), (2, 2, 7.0)}
    with pytest.raises(ValueError):
        Graph.from_edgelist(e, "a", "nope")


def test_walks_are_edges(d8):
    edges = {(r["src"], r["dst"]) for r in d8.edges.collect()}
    for r in sampling.uniform_random_walks(d8, d8.vertices, 4).collect():
        path = [x for x in r["path"] if x >= 0]
        assert len(r["path"]) == 5 and all(p in edges for p in zip(path, path[1:]))


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 1000))
def test_hungarian(n, m, seed):
    from itertools import permutations

    c = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    total, _ = layout.dense_hungarian(c)
    small, big = (c, m) if n <= m else (c.T, n)
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
    assert abs(total - best) < 1e-9


def test_generators(spark):
    assert generators.complete_graph(spark, 5).count() == 10
    assert generators.rmat(spark, 6, 100).where("src >= 64 OR dst >= 64").isEmpty()
    plain, clipped = (generators.rmat(spark, 20, 2000, ids=True, clip_and_flip=c).collect() for c in (False, True))
    for x, y in zip(plain, clipped):
        top = 1 << ((x["src"] ^ x["dst"]).bit_length() - 1) if x["src"] < x["dst"] else 0
        assert (y["src"], y["dst"], y["edge_id"]) == (x["src"] + top, x["dst"] - top, x["edge_id"]) and y["src"] >= y["dst"]


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "find_spec", lambda name: None)
    names = [*e.queries(), *e.oracle_sql()]
    assert "pagerank" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_forests(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(30), r.randrange(30), float(r.randrange(1, 9))) for _ in range(70)]
    g = Graph.from_edgelist(spark.createDataFrame(edges, "src long, dst long, weight double"), weight="weight")
    known = {(x["src"], x["dst"]): x["weight"] for x in g.weighted_edges.where("src < dst").collect()}
    for maximum in (False, True):
        up, total = {v: v for e in known for v in e}, 0.0

        def root(x, up=up):
            return x if up[x] == x else root(up[x])

        for (a, b), w in sorted(known.items(), key=lambda x: (-x[1] if maximum else x[1], x[0])):
            if root(a) != root(b):
                up[root(a)] = root(b)
                total += w
        tree = cores.minimum_spanning_tree(g, maximum=maximum).edges.where("src < dst").collect()
        assert abs(sum(x["weight"] for x in tree) - total) < 1e-9 and all(known[x["src"], x["dst"]] == x["weight"] for x in tree)


def test_scoped_tables_are_freed(spark):
    import os

    from graphloom.plans import runtime

    g = Graph.from_edgelist(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long"))
    before = len(runtime._paths)
    found = cores.core_number(g)
    there = [p for _, p in runtime._paths[before:] if os.path.exists(p.removeprefix("file://"))]
    assert len(runtime._paths) - before > 3 and len(there) == 1
    assert {tuple(x) for x in found.collect()} == {(0, 2), (1, 2), (2, 2), (3, 1)}


def test_whole_queries(spark, tmp_path):
    """Over ids beyond every cut of the queries for few ids, against brute force."""
    import random
    from datetime import datetime, timedelta

    from graphloom.plans import queries

    r = random.Random(4)
    lines = [(o, n, r.randrange(2000, 2040), r.choice([20.0, 31.0, 40.0, 50.0])) for o in range(60) for n in range(4)]
    orders = [(o, 700 + o % 9, datetime(2020, 1, 1) + timedelta(days=r.randrange(40))) for o in range(60)]
    d = str(tmp_path)
    spark.createDataFrame([(*x, 1) for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")

    line = {(o, n): (p, w) for o, n, p, w in lines}
    e = {}
    for (o, n), (p, w) in line.items():
        if (o, n + 1) in line:
            k = p, line[o, n + 1][0]
            e[k] = min(w, e.get(k, w))
    both = {}
    for (a, b), w in e.items():
        for k in {(a, b), (b, a)}:
            both.setdefault(k, []).append(w)
    u = {k: sum(w) / len(w) for k, w in both.items()}
    v = {x for k in e for x in k}
    two = {(a, c) for a, b in u for x, c in u if x == b}
    steps = lambda pairs: {(a, c) for a, b in pairs for x, c in e if x == b}
    got = lambda name: [tuple(x) for x in queries.QUERIES[name](spark, d).collect()]
    assert sorted(got("two_hop_neighbors_whole")) == sorted(two)
    assert sorted(got("has_edge_whole")) == sorted((a, b, int((a, b) in u)) for a, b in two)
    assert sorted(got("k_hop_nbrs_whole")) == sorted(steps(steps(e)))
    assert sorted(got("induced_subgraph_whole")) == sorted((a, b, w) for (a, b), w in e.items())
    ego = {x: {x} | {b for a, b in u if a == x} for x in v}
    assert sorted(got("ego_graph_whole")) == sorted((x, a, b) for x in v for a, b in u if {a, b} <= ego[x])
    assert sorted(got("neighbor_sample_whole")) == sorted([(0, 0, a, b, w) for (a, b), w in e.items()] + [(0, 1, a, b, w) for (a, b), w in e.items() if a in {y for _, y in e}])
    epoch = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    bought = {(c + queries.SUPPLIERS, p, epoch(t)) for o, c, t in orders for x, _, p, _ in lines if x == o}
    later = {(1, p, c, t) for _, q, s in bought for c, p, t in bought if p == q and t > s}
    assert sorted(got("temporal_neighbor_sample_whole")) == sorted({(0, c, p, t) for c, p, t in bought} | later)
    for weighted in (False, True):
        near = {x: {b: w if weighted else 1.0 for (a, b), w in u.items() if a == x} for x in v}
        for name in similarity.NAMES:
            expect = {}
            for a, b in two:
                x, y = near[a], near[b]
                common = x.keys() & y.keys()
                shared, wa, wb = sum(min(x[k], y[k]) for k in common), sum(x.values()), sum(y.values())
                norm = lambda z: sum(z[k] ** 2 for k in common) ** 0.5  # noqa: B023, E731
                expect[a, b] = {"jaccard": shared / (wa + wb - shared), "sorensen": 2 * shared / (wa + wb), "overlap": shared / min(wa, wb), "cosine": sum(x[k] * y[k] for k in common) / (norm(x) * norm(y))}[name]
            found = {(a, b): c for a, b, c in got(f"{name}{'_weighted' if weighted else ''}_whole")}
            assert found.keys() == expect.keys() and all(abs(found[k] - expect[k]) < 1e-6 for k in expect)
    for kind in ("uniform", "biased", "node2vec"):
        walks = got(f"{kind}_random_walks")
        assert sorted(path[0] for _, path, _ in walks) == sorted(v)
        assert all((a, b) in u for _, path, _ in walks for a, b in zip(path, path[1:]))


def test_values_half_way_round_as_in_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    from graphloom.plans import queries

    values = [0.0640625, 0.1640625, 0.0000005, 0.3984375, 2.5, -0.0640625, 1 / 3, 41 / 640]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(queries._rounded(F.col("x"))).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]


def test_pairs_of_neighbours_stay_in_their_block(spark, monkeypatch):
    """Many blocks, a vertex of more wedges than a step, weights: as brute force, and pairs are never shuffled."""
    from graphloom.operators import wedges

    rng = np.random.default_rng(5)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (250, 2)).tolist()} | {(0, b) for b in range(60)}
    rows = [(a, b, float(w) / 2) for (a, b), w in zip(sorted(pairs), rng.integers(1, 60, len(pairs)).tolist())]
    g = Graph.from_edgelist(spark.createDataFrame(rows, "src long, dst long, weight double"), weight="weight")
    near: dict[int, dict[int, float]] = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    monkeypatch.setattr(wedges, "WEDGES", 2_000)
    for weighted in (False, True):
        found = similarity.similarity(g, "jaccard", use_weight=weighted)
        assert "hashpartitioning(first" not in found._jdf.queryExecution().toString()
        expect = {}
        for a, x in near.items():
            for b, y in near.items():
                if common := x.keys() & y.keys():
                    value = lambda w: w if weighted else 1.0  # noqa: B023, E731
                    both = sum(min(value(x[k]), value(y[k])) for k in common)
                    expect[a, b] = both / (sum(map(value, x.values())) + sum(map(value, y.values())) - both)
        got = {(r[0], r[1]): r[2] for r in found.collect()}
        assert got.keys() == expect.keys() and all(abs(got[k] - expect[k]) < 1e-12 for k in expect)
        best = similarity.all_pairs(g, "jaccard", use_weight=weighted, topk=7, vertices=spark.createDataFrame([(v,) for v in range(0, 60, 3)], "vertex long"))
        order = sorted((-got[k], *k) for k in got if k[0] % 3 == 0 and k[0] != k[1])
        assert [(-r[2], r[0], r[1]) for r in best.collect()] == order[:7]
    import pyarrow as pa

    e = [(a, b, w) for a in near for b, w in near[a].items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(a, b, w, sum(near[a].values()), True) for a, b, w in e])], ["src", "dst", "weight", "total", "asked"])
    block = wedges._Block([r.column("data")[0].as_py() for r in wedges._lists(np.zeros(0, dtype=np.int64))(iter([batch]))])
    whole = {k: v for x in block.pairs(("n", "both")) for k, v in zip(zip(x[0].tolist(), x[1].tolist()), zip(x[2]["n"].tolist(), x[2]["both"].tolist()))}
    monkeypatch.setattr(wedges, "STEP", 20)
    steps = {k: v for x in block.pairs(("n", "both")) for k, v in zip(zip(x[0].tolist(), x[1].tolist()), zip(x[2]["n"].tolist(), x[2]["both"].tolist()))}
    assert steps == whole and whole.keys() == expect.keys()


def test_hops_stay_in_their_block(spark, monkeypatch):
    """Many blocks, one start of many paths, starts without edges: as brute force, and pairs are never shuffled."""
    from graphloom.operators import hops

    rng = np.random.default_rng(6)
    e = sorted({(a, b) for a, b in rng.integers(0, 50, (200, 2)).tolist()} | {(0, b) for b in range(50)} | {(3, 90)})
    g = Graph.from_edgelist(spark.createDataFrame(e, "src long, dst long"), directed=True)
    starts = [*range(0, 50, 2), 90, 91]
    monkeypatch.setattr(hops, "EDGES", 20)
    for k in (0, 1, 2, 3):
        expect = {(v, v) for v in starts}
        for _ in range(k):
            expect = {(a, y) for a, b in expect for x, y in e if x == b}
        found = structure.k_hop_nbrs(g, spark.createDataFrame([(v,) for v in starts], "vertex long"), k)
        assert not k or "hashpartitioning(start" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(expect)
    monkeypatch.setattr(hops, "STEP", 30)
    paths = hops._Paths(*(np.array(c) for c in zip(*e)))
    own = np.searchsorted(paths.ids, [v for v in starts if v != 91])
    got = [(int(paths.ids[a]), int(paths.ids[z])) for x, y in paths.ends(own, 3) for a, z in zip(x, y)]
    assert sorted(got) == sorted(expect)


def test_edges_of_pairs_are_shuffled_packed(spark, tmp_path):
    """Of what a whole similarity has written only packed lists stay, and their totals are right; rows of edges are never shuffled again."""
    from pyspark.sql import functions as F

    from graphloom.operators import wedges
    from graphloom.plans import queries as q

    rng = np.random.default_rng(8)
    lines = [(int(o), i, int(p), float(w)) for o in range(60) for i, (p, w) in enumerate(zip(rng.integers(0, 25, 5), rng.integers(1, 50, 5)))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [tuple(r) for r in q.parts(spark, str(tmp_path)).weighted_edges.select("src", "dst", "weight").collect()]
    totals: dict[int, float] = {}
    for a, _, w in edges:
        totals[a] = totals.get(a, 0.0) + w
    found = q.QUERIES["sorensen_weighted_whole"](spark, str(tmp_path))
    folders = {f.rsplit("/", 1)[0] for f in found.inputFiles()}
    assert len(folders) == 1
    rows = spark.read.parquet(*folders)
    assert "data" in rows.columns and rows.agg(F.sum("edges")).first()[0] == len(edges)
    got = []
    for r in rows.collect():
        src, dst, weight, total, asked = wedges.unpack(r["data"])
        assert asked.all() and (np.diff(dst) >= 0).all()
        got += zip(src.tolist(), dst.tolist(), weight.view(np.float64).tolist(), total.view(np.float64).tolist())
    assert sorted(got) == sorted((a, b, w, totals[a]) for a, b, w in edges)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning(dst" not in plan


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    """With no garbage collected: what a written table has shuffled is gone at once, and what was set before is set again."""
    import gc

    from graphloom.plans import runtime

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {b.toString() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllBlocks()) if b.toString().startswith("shuffle")}
    before, was = held(), spark.conf.get(key, None)
    gc.disable()
    try:
        table = runtime.cut(spark.range(10_000, numPartitions=4).groupBy("id").count())
        bucketed = runtime.cut(spark.range(1000, numPartitions=4).groupBy("id").count(), by="id")
        assert held() <= before
    finally:
        gc.enable()
    assert table.count() == 10_000 and bucketed.count() == 1000 and spark.conf.get(key, None) == was
    for x in (table, bucketed):
        runtime.release(x)


def test_local_moves_are_passes_over_packed_edges(spark, monkeypatch):
    """The same clusters as by joins, in a fraction of the jobs; loops, lone vertices, negative ids, ends that are no vertices."""
    from graphloom.operators import moves

    rng = np.random.default_rng(9)
    e = {(int(a) * 7 - 50, int(b) * 7 - 50) for a, b in rng.integers(0, 40, (90, 2))} | {(6, 6)}
    rows = [(a, b, float(w)) for (a, b), w in zip(sorted(e), rng.integers(1, 9, len(e)).tolist())]
    lone = spark.createDataFrame([(1000,), (1001,)], "vertex long")
    g = Graph.from_edgelist(spark.createDataFrame(rows, "src long, dst long, weight double"), weight="weight", vertices=lone)

    def run(group):
        spark.sparkContext.setJobGroup(group, group)
        labels, q = community.louvain(g)
        out = dict(tuple(r) for r in labels.collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, q, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    found, q, jobs = run("packed")
    assert abs(community.modularity(g.weighted_edges, spark.createDataFrame(list(found.items()), "vertex long, cluster long")).first()[0] - q) < 1e-9
    monkeypatch.setattr(moves, "MOST", 0)
    expect, expect_q, expect_jobs = run("joins")
    assert found == expect and abs(q - expect_q) < 1e-9 and q > 0.2 and found[1000] == 1000
    assert jobs < expect_jobs / 3
    monkeypatch.setattr(moves, "MOST", 100)
    assert moves.held(g.weighted_edges, lone, 1.0, 1.0, 1e-7) is None


def test_best_pairs_of_scattered_ids_come_in_rounds(spark, monkeypatch):
    """Copies whose ids alternate, so that every block needs most lists: few are shuffled at once, none wait for the result, and the best are those of all pairs."""
    import itertools

    from graphloom.operators import wedges

    rng = np.random.default_rng(10)
    one = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 30, (80, 2)).tolist()})
    rows = [(a * 5 + i, b * 5 + i, float(w)) for i in range(5) for (a, b), w in zip(one, rng.integers(1, 9, len(one)).tolist())]
    g = Graph.from_edgelist(spark.createDataFrame(rows, "src long, dst long, weight double"), weight="weight")
    monkeypatch.setattr(wedges, "WEDGES", 200)
    monkeypatch.setattr(wedges, "SHARE", 4)
    monkeypatch.setattr(wedges, "ROUND", 2, raising=False)
    for weighted in (False, True):
        every = [tuple(r) for r in similarity.similarity(g, "sorensen", use_weight=weighted).collect()]
        best = similarity.all_pairs(g, "sorensen", use_weight=weighted, topk=40)
        assert "hashpartitioning(block" not in best._jdf.queryExecution().toString()
        assert len({f.rsplit("/", 1)[0] for f in best.inputFiles()}) > 1
        assert [tuple(r) for r in best.collect()] == sorted((x for x in every if x[0] != x[1]), key=lambda x: (-x[2], x[0], x[1]))[:40]
    for need, most in itertools.product(([], [7], [1, 1, 1, 1], [9, 0, 1, 5, 5]), (1, 5, 100)):
        rounds = wedges._rounds(need, most)
        assert [b for a, z in rounds for b in range(a, z)] == [*range(len(need))]
        assert all(z - a == 1 or sum(need[a:z]) <= most for a, z in rounds if need)


def test_louvain_query_goes_on_while_a_level_gains(spark, tmp_path, monkeypatch):
    """A chain of parts, whose clusters two levels leave too small."""
    from graphloom.plans import checks

    lines = [(0, i, i, 1.0) for i in range(100)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    local, found = community._local, []

    def level(*args):
        found.append(local(*args))
        return found[-1]

    monkeypatch.setattr(community, "_local", level)
    assert [tuple(r) for r in checks.QUERIES["louvain_valid"](spark, str(tmp_path)).collect()] == [(0, 0, 0)]
    q = [x for _, x in found]
    assert len(q) > 3 and q[2] > q[1] + 1e-3 and q[-1] <= q[-2] + 1e-7


def test_hops_of_scattered_ids_are_sent_few_edges(spark, monkeypatch):
    """Copies whose ids alternate: a block's starts are of few copies, and it is sent little more than their edges."""
    from graphloom.operators import hops

    rng = np.random.default_rng(11)
    one = {(a, (a + 1) % 12) for a in range(12)} | {(a, b) for a, b in rng.integers(0, 12, (24, 2)).tolist()}
    e = sorted((a * 8 + i, b * 8 + i) for i in range(8) for a, b in one)
    g = Graph.from_edgelist(spark.createDataFrame(e, "src long, dst long"), directed=True)
    monkeypatch.setattr(hops, "EDGES", len(one))
    sent = spark.sparkContext.accumulator(0)
    reached = hops._reached

    def counted(k):
        run = reached(k)

        def rows(batches):
            some = list(batches)
            sent.add(sum(b.num_rows for b in some))
            return run(iter(some))

        return rows

    monkeypatch.setattr(hops, "_reached", counted)
    found = sorted(tuple(r) for r in structure.k_hop_nbrs(g, g.vertices, 3).collect())
    expect = set(e)
    for _ in range(2):
        expect = {(a, y) for a, b in expect for x, y in e if x == b}
    assert found == sorted(expect) and sent.value <= 3 * len(e)
