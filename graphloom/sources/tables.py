"""Readers and writers: delimited edge lists, MatrixMarket files, a dataset catalogue, sampling results, hypergraphs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph


def read_edgelist(spark: SparkSession, path: str, *, sep: str = " ", schema: str = "src long, dst long, weight double", header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema, header=header, comment="#")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight (1 for a pattern) of a coordinate file, ids from 0; a symmetric file's other half is added."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    kind = head[0].lower().split() if head else []
    data = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    cells = data.select(F.split(F.trim("value"), r"\s+").alias("v"))
    size = cells.where(F.size("v") == 3).first() if "pattern" in kind else cells.first()
    entries = cells.where(F.size("v") == 2) if "pattern" in kind else cells.where(F.col("v") != F.array(*[F.lit(x) for x in size[0]]))
    weight = F.lit(1.0) if "pattern" in kind else F.col("v")[2].cast("double")
    out = entries.select((F.col("v")[0].cast("long") - 1).alias("src"), (F.col("v")[1].cast("long") - 1).alias("dst"), weight.alias("weight"))
    if "symmetric" in kind:
        out = out.unionByName(out.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return out


class Dataset:
    """A named edge list: where it lies, how it is written, and what kind of graph it holds."""

    catalogue: dict[str, Dataset] = {}

    def __init__(self, name: str, path: str, *, sep: str = " ", schema: str = "src long, dst long, weight double", header: bool = False, directed: bool = False, multi: bool = False):
        self.name, self.path, self.sep, self.schema, self.header, self.directed, self.multi = name, path, sep, schema, header, directed, multi
        self._edges: DataFrame | None = None
        Dataset.catalogue[name] = self

    def get_path(self) -> str:
        return self.path

    def get_edgelist(self, spark: SparkSession) -> DataFrame:
        if self._edges is None:
            self._edges = read_matrix_market(spark, self.path) if self.path.endswith(".mtx") else read_edgelist(spark, self.path, sep=self.sep, schema=self.schema, header=self.header)
        return self._edges

    def get_graph(self, spark: SparkSession) -> Graph:
        e = self.get_edgelist(spark)
        return Graph.from_edgelist(e, weight="weight" if "weight" in e.columns else None, directed=self.directed, multi=self.multi)

    def unload(self) -> None:
        self._edges = None


def set_download_dir(path: str) -> None:
    """Where the catalogue looks for relative paths."""
    for d in Dataset.catalogue.values():
        if "://" not in d.path and not os.path.isabs(d.path):
            d.path = os.path.join(path, d.path)


def write_samples(samples: DataFrame, path: str, batches_per_partition: int = 256) -> None:
    """Sampling results as Parquet, partitioned by runs of batches."""
    part = F.floor(F.col("batch_id") / batches_per_partition).cast("long")
    samples.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_samples(spark: SparkSession, path: str, batches: tuple[int, int] | None = None, batches_per_partition: int = 256) -> DataFrame:
    """Sampling results again; a range of batches (first, last) reads only its partitions."""
    df = spark.read.parquet(path)
    if batches:
        a, b = batches
        df = df.where(F.col("part").between(a // batches_per_partition, b // batches_per_partition) & F.col("batch_id").between(a, b))
    return df.drop("part")


def hypergraph(values: DataFrame, columns: list[str] | None = None, *, direct: bool = False, dropna: bool = True, skip: list[str] | None = None, edges_between: dict[str, list[str]] | None = None,
               event_id: str | None = None, categories: dict[str, str] | None = None, delim: str = "::", drop_edge_attrs: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, events, entities of a table of events.

    Each value of a column is an entity `category::value`.  By default every event is a node with an edge to each of its
    entities; with `direct`, entities of one event are joined directly, by all pairs of columns or those of edges_between.
    """
    columns = [c for c in (columns or values.columns) if c not in (skip or []) and c != event_id]
    categories = categories or {}
    kind = lambda c: categories.get(c, c)
    own = F.col(event_id).cast("string") if event_id else F.monotonically_increasing_id().cast("string")
    events = values.withColumn("event_id", F.concat_ws(delim, F.lit("event_id"), own))
    node = {c: F.when(F.col(c).isNotNull() | F.lit(not dropna), F.concat_ws(delim, F.lit(kind(c)), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c in columns}
    attrs = [] if drop_edge_attrs else columns
    one = lambda c: F.struct(F.lit(kind(c)).alias("category"), node[c].alias("node_id"))
    entities = events.select(F.explode(F.array(*map(one, columns))).alias("e")).select("e.node_id", "e.category").where("node_id IS NOT NULL").distinct()
    if direct:
        wanted = edges_between or {c: columns[i + 1 :] for i, c in enumerate(columns)}
        pairs = [F.struct(F.lit(f"{kind(a)}{delim}{kind(b)}").alias("edge_type"), node[a].alias("src"), node[b].alias("dst")) for a in wanted for b in wanted[a]]
        edges = events.select("event_id", *attrs, F.explode(F.array(*pairs)).alias("e")).select("event_id", "e.edge_type", "e.src", "e.dst", *attrs)
        nodes = entities
    else:
        links = [F.struct(F.lit(kind(c)).alias("edge_type"), node[c].alias("attribute_id")) for c in columns]
        edges = events.select("event_id", *attrs, F.explode(F.array(*links)).alias("e")).select("event_id", "e.edge_type", "e.attribute_id", *attrs)
        nodes = entities.unionByName(events.select(F.col("event_id").alias("node_id"), F.lit("event").alias("category")))
    ends = ["src", "dst"] if direct else ["attribute_id"]
    return {"nodes": nodes, "edges": edges.dropna(subset=ends), "events": events, "entities": entities}
