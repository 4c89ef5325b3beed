"""Graphs as pairs of DataFrames, and how they are made from tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prims

OPTIONAL = ("weight", "edge_id", "edge_type", "start_time", "end_time")


@dataclass(frozen=True)
class Graph:
    """edges(src, dst[, weight, edge_id, edge_type, start_time, end_time]) and vertices(vertex, ...).

    An undirected graph holds each edge in both directions.  Parallel edges are dropped unless multi; loops stay.
    """

    edges: DataFrame
    vertices: DataFrame
    directed: bool = False
    multi: bool = False
    mask: Column | None = None

    # Construction -------------------------------------------------------------------------------------------------

    @classmethod
    def from_edgelist(cls, df: DataFrame, source="src", destination="dst", *, weight: str | None = None, edge_id: str | None = None, edge_type: str | None = None,
                      start_time: str | None = None, end_time: str | None = None, directed: bool = False, multi: bool = False,
                      symmetrize: bool | None = None, drop_self_loops: bool = False, vertices: DataFrame | None = None) -> Graph:
        """Loops go (if asked), parallel edges go (the least by weight, id, type, times stays), then edges are made symmetric."""
        named = {"src": source, "dst": destination, "weight": weight, "edge_id": edge_id, "edge_type": edge_type, "start_time": start_time, "end_time": end_time}
        missing = [c for c in named.values() if isinstance(c, str) and c not in df.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")
        if directed and symmetrize:
            raise ValueError("a directed graph cannot be made symmetric")
        if not directed and symmetrize is not False and (edge_id or edge_type):
            raise ValueError("edge ids and types on an undirected graph need symmetrize=False")
        kinds = {"weight": "double", "edge_type": "int"}
        edges = df.select(*[F.col(c).cast(kinds.get(k, "long")).alias(k) for k, c in named.items() if c])
        if drop_self_loops:
            edges = remove_self_loops(edges)
        if not multi:
            edges = remove_multi_edges(edges)
        if not directed and symmetrize is not False:
            edges = symmetrize_edges(edges, multi=multi)
        ends = prims.endpoints(edges)
        if vertices is not None:
            ends = ends.unionByName(vertices.select(F.col("vertex").cast("long").alias("vertex"))).distinct()
        return cls(edges, ends, directed, multi)

    @classmethod
    def from_adjlist(cls, adjacency: DataFrame, **options) -> Graph:
        """From rows (src, dsts array[, weights array])."""
        weighted = "weights" in adjacency.columns
        zipped = F.arrays_zip("dsts", "weights") if weighted else F.transform("dsts", lambda x: F.struct(x.alias("dsts")))
        rows = adjacency.select("src", F.explode(zipped).alias("e"))
        rows = rows.select("src", F.col("e.dsts").alias("dst"), *([F.col("e.weights").alias("weight")] if weighted else []))
        return cls.from_edgelist(rows, weight="weight" if weighted else None, **options)

    # Views --------------------------------------------------------------------------------------------------------

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    @property
    def active(self) -> DataFrame:
        """Edges that the mask lets through."""
        return self.edges if self.mask is None else self.edges.where(self.mask)

    @property
    def weighted_edges(self) -> DataFrame:
        return self.active if self.weighted else self.active.withColumn("weight", F.lit(1.0))

    def attach_edge_mask(self, predicate: Column) -> Graph:
        return replace(self, mask=predicate)

    def detach_edge_mask(self) -> Graph:
        return replace(self, mask=None)

    def has_edge_mask(self) -> bool:
        return self.mask is not None

    def view_edge_list(self) -> DataFrame:
        """Edges; of an undirected graph those with src <= dst."""
        return self.edges if self.directed else self.edges.where("src <= dst")

    def view_adj_list(self, transposed: bool = False) -> DataFrame:
        """src, dsts (sorted)[, weights]: one row for each vertex with edges."""
        e = prims.reverse(self.edges) if transposed else self.edges
        if not self.weighted:
            return e.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))
        rows = e.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("e"))
        return rows.select("src", F.col("e.dst").alias("dsts"), F.col("e.weight").alias("weights"))

    def nodes(self) -> DataFrame:
        return self.vertices.select("vertex")

    def number_of_vertices(self) -> int:
        return self.vertices.count()

    def number_of_edges(self, directed_edges: bool = False) -> int:
        return self.edges.count() if self.directed or directed_edges else self.edges.where("src >= dst").count()

    def is_directed(self) -> bool:
        return self.directed

    def is_weighted(self) -> bool:
        return self.weighted

    def is_multigraph(self) -> bool:
        return self.multi

    def is_bipartite(self) -> bool:
        return "partition" in self.vertices.columns and self.vertices.select("partition").distinct().count() == 2

    def is_multipartite(self) -> bool:
        return "partition" in self.vertices.columns

    def sets(self) -> dict[str, DataFrame]:
        names = [r[0] for r in self.vertices.select("partition").distinct().collect()]
        return {n: self.vertices.where(F.col("partition") == n).select("vertex") for n in names}

    def add_nodes_from(self, nodes: DataFrame, partition: str | None = None) -> Graph:
        """Declares vertices (vertex), of a partition if named."""
        have = self.vertices if partition is None or "partition" in self.vertices.columns else self.vertices.withColumn("partition", F.lit(None).cast("string"))
        more = nodes.select(F.col("vertex").cast("long").alias("vertex"))
        if "partition" in have.columns:
            more = more.withColumn("partition", F.lit(partition).cast("string"))
            both = have.unionByName(more).groupBy("vertex").agg(F.max("partition").alias("partition"))
        else:
            both = have.select("vertex").unionByName(more).distinct()
        return replace(self, vertices=both)

    def has_isolated_vertices(self) -> bool:
        return not self.vertices.join(prims.endpoints(self.edges), "vertex", "left_anti").isEmpty()

    def density(self) -> float:
        """Edges over possible ones: m / (n (n - 1)) directed, twice that for undirected pairs counted once."""
        if self.multi:
            raise TypeError("density is not defined for a multigraph")
        n = self.number_of_vertices()
        m = self.number_of_edges()
        return (1 if self.directed else 2) * m / (n * (n - 1)) if n > 1 else 0.0

    def has_node(self, nodes: DataFrame) -> DataFrame:
        """vertex, present."""
        known = self.vertices.select("vertex", F.lit(True).alias("present"))
        return nodes.join(known, "vertex", "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def has_edge(self, pairs: DataFrame) -> DataFrame:
        """src, dst, multiplicity (0 where there is none)."""
        count = self.active.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("multiplicity"))
        return pairs.join(count, ["src", "dst"], "left").withColumn("multiplicity", F.coalesce("multiplicity", F.lit(0)).cast("long"))

    def has_self_loop(self) -> bool:
        return not self.edges.where("src = dst").isEmpty()

    def neighbors(self, n: int) -> DataFrame:
        e = self.active
        out = e.where(F.col("src") == n).select(F.col("dst").alias("vertex"))
        if self.directed:
            out = out.unionByName(e.where(F.col("dst") == n).select(F.col("src").alias("vertex")))
        return out.distinct()

    # Conversions --------------------------------------------------------------------------------------------------

    def to_directed(self) -> Graph:
        return replace(self, directed=True)

    def to_undirected(self) -> Graph:
        return self if not self.directed else replace(self, edges=symmetrize_edges(self.edges, multi=self.multi), directed=False)

    def simple(self) -> Graph:
        """A multigraph without its parallel edges."""
        return replace(self, edges=remove_multi_edges(self.edges), multi=False)

    def transposed(self) -> Graph:
        return replace(self, edges=prims.reverse(self.edges))

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges, mask=None)

    def to_pandas_edgelist(self):
        return self.view_edge_list().toPandas()

    def adjacency(self) -> DataFrame:
        """vertex and one column for each vertex, with the weight (1 without, 0 for no edge); for small graphs."""
        ids = sorted(r[0] for r in self.vertices.select("vertex").collect())
        wide = self.weighted_edges.groupBy(F.col("src").alias("vertex")).pivot("dst", ids).sum("weight")
        return self.vertices.select("vertex").join(wide, "vertex", "left").na.fill(0.0).orderBy("vertex")

    def to_numpy_array(self):
        return self.adjacency().drop("vertex").toPandas().to_numpy()


def MultiGraph(*args, **options) -> Graph:
    return Graph.from_edgelist(*args, multi=True, **options)


def from_pandas_edgelist(spark: SparkSession, pdf, source="src", destination="dst", **options) -> Graph:
    return Graph.from_edgelist(spark.createDataFrame(pdf), source, destination, **options)


def from_numpy_array(spark: SparkSession, array, **options) -> Graph:
    """Non-zero cells of a square matrix are weighted edges."""
    import numpy as np

    rows, columns = np.nonzero(array)
    data = [(int(r), int(c), float(array[r, c])) for r, c in zip(rows, columns)]
    options = {"directed": True, **options}
    return Graph.from_edgelist(spark.createDataFrame(data, "src long, dst long, weight double"), weight="weight", **options)


def from_pandas_adjacency(spark: SparkSession, pdf, **options) -> Graph:
    return from_numpy_array(spark, pdf.to_numpy(), **options)


def from_csr(spark: SparkSession, offsets: DataFrame, indices: DataFrame, **options) -> Graph:
    """From offsets(vertex, first, last) and indices(place, dst[, weight]); a vertex's edges are places first .. last - 1."""
    places = offsets.where("last > first").select(F.col("vertex").alias("src"), F.explode(F.expr("sequence(first, last - 1)")).alias("place"))
    weighted = "weight" in indices.columns
    return Graph.from_edgelist(places.join(indices, "place"), weight="weight" if weighted else None, **options)


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src != dst")


def remove_multi_edges(edges: DataFrame, keep_min: bool = True) -> DataFrame:
    """One edge for each (src, dst): the least by weight, id, type and times (or the greatest)."""
    rest = [c for c in OPTIONAL if c in edges.columns]
    if not rest:
        return edges.select("src", "dst").distinct()
    best = edges.groupBy("src", "dst").agg((F.min if keep_min else F.max)(F.struct(*rest)).alias("e"))
    return best.select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in rest])


def symmetrize_edges(edges: DataFrame, *, multi: bool = False, reciprocal: bool = False, combine: str = "avg") -> DataFrame:
    """Both directions of each edge; where both are there already their weights are averaged (or combined by `combine`).

    reciprocal keeps only edges that are there in both directions.
    """
    if reciprocal:
        edges = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_semi")
    both = edges.unionByName(prims.reverse(edges.where("src != dst")))
    if multi:
        return both
    rest = [c for c in OPTIONAL if c in edges.columns]
    if not rest:
        return both.distinct()
    how = {c: (getattr(F, combine) if c == "weight" else F.min) for c in rest}
    return both.groupBy("src", "dst").agg(*[how[c](c).alias(c) for c in rest])


def symmetrize(edges: DataFrame, multi: bool = False) -> DataFrame:
    """The table helper: of weights in both directions the smaller stays."""
    return symmetrize_edges(edges, multi=multi, combine="min")


class NumberMap:
    """External identifiers, of any columns, and dense internal ones from 0 in the order of the external ones."""

    def __init__(self, table: DataFrame, columns: list[str]):
        self.table, self.columns = table, columns

    @classmethod
    def renumber(cls, df: DataFrame, source: list[str], destination: list[str]) -> tuple[DataFrame, NumberMap]:
        """src and dst ids in place of the columns named, and the map."""
        names = [f"ext_{i}" for i in range(len(source))]
        every = df.select(*[F.col(c).alias(n) for c, n in zip(source, names)]).unionByName(df.select(*[F.col(c).alias(n) for c, n in zip(destination, names)])).distinct()
        made = cls(dense_ids(every, names), names)
        rest = [c for c in df.columns if c not in source + destination]
        out = made.add_internal(made.add_internal(df, source, "src"), destination, "dst")
        return out.select("src", "dst", *rest), made

    def add_internal(self, df: DataFrame, columns: list[str], name: str) -> DataFrame:
        keyed = self.table.select(F.col("id").alias(name), *[F.col(n).alias(f"_{name}_{n}") for n in self.columns])
        on = [df[c].eqNullSafe(keyed[f"_{name}_{n}"]) for c, n in zip(columns, self.columns)]
        joined = df.join(keyed, on, "left")
        return joined.drop(*[f"_{name}_{n}" for n in self.columns])

    def unrenumber(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self.table.withColumnRenamed("id", column), column, "left")


def dense_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """id (0, 1, ... in the order of the columns) and the columns; ranges are numbered in parallel, then shifted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *columns).withColumn("_part", F.spark_partition_id())
    from ..plans.runtime import cut

    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*columns)) - 1
    return ranged.withColumn("_rank", rank).join(F.broadcast(first.select("_part", "first")), "_part").select((F.col("first") + F.col("_rank")).alias("id"), *columns)


def coarsen(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, weight between clusters: labels (vertex, label) on both ends, weights added."""
    a, b = labels.toDF("src", "cs"), labels.toDF("dst", "cd")
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("weight").alias("weight"))


def relabel(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """column's values replaced by mapping (old, new); values it doesn't know stay."""
    m = mapping.toDF("_old", "_new")
    return df.join(m, df[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def replicate(df: DataFrame, limit_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint, but only for a table that is known to be small."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df
