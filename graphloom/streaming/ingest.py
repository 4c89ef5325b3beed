"""Edges from a stream: windowed counts and running degrees (an extension; batch graphs don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(events: DataFrame, *, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, src, dst, n: parallel edges counted in each window, with late rows up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "src", "dst").agg(F.count(F.lit(1)).alias("n")).select("w.start", "src", "dst", "n")


def running_degrees(edges: DataFrame) -> DataFrame:
    """vertex, degree: a stateful count over all edges so far (update or complete mode)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))
