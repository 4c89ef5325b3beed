"""Exact deduplication as a stateful stream.

Fingerprints of the rows run through a Structured Streaming aggregation whose keyed state lives on disk (RocksDB), never
expires, and holds for each digest the stable identifier of the row that stays, a content locator and the group's size.
Spark combines the rows of a digest on the map side before they reach the state, so a text that fills a third of the
table costs one row per task.  When the stream has caught up, the state itself is read as a table.  Rows that hit an
existing digest are then checked on their full bytes: their texts are fetched by locator (hash of the file, number of the
row in it; for rows that no file holds, the identifier) and grouped by the text itself.
Should two texts share a digest, their rows are decided by full text instead.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _state_of_stream(prints: DataFrame, files_per_batch: int) -> DataFrame:
    """digest, keep_id, file and row (the content's locator), n_rows after every row of `prints` (a written table) has run through the stream."""
    spark = prints.sparkSession
    source = prints.inputFiles()
    if not source:
        return prints.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max("file").alias("file"), F.max("row").alias("row"), F.count(F.lit(1)).alias("n_rows"))
    folder = source[0].rsplit("/", 1)[0]
    checkpoint = shared.new_path(spark, "exact-state")
    settings = {
        "spark.sql.streaming.stateStore.providerClass": _STORE,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        # Each of many small stores would otherwise reserve disk for its logs.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        kept = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("n_rows")
        )
        query = (
            kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").option("path", checkpoint).load()
    # The buffers of max and of count, which have no names of their own.
    value = F.col("value").cast("struct<kept:struct<doc_id:bigint,file:bigint,row:bigint>,n_rows:bigint>")
    state = state.select(F.col("key.digest").alias("digest"), value.alias("v"))
    return state.select("digest", F.col("v.kept.doc_id").alias("keep_id"), "v.kept.file", "v.kept.row", "v.n_rows")


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, text, file and row, which together locate a text: it is fetched by them and by nothing else."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    try:
        return docs.select(*own, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # rows of no file, or of a format that doesn't number them
        return docs.select(*own, F.lit(0).cast("long").alias("file"), F.col("doc_id").cast("long").alias("row"))


def exact_groups(docs: DataFrame, *, digest=sha256, files_per_batch: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest doc_id stays.  Null text counts as empty; empty texts are equal to each
    other.  A repeated doc_id with the same text counts as one more row of its group, and all its rows stay.  An empty
    table gives no rows; other columns are ignored.  `digest` may be any function of the text, however weak.
    """
    docs = _located(docs)
    prints = shared.written(docs.select("doc_id", digest(F.col("text")).alias("digest"), "file", "row"), "exact-prints")
    state = _state_of_stream(prints, files_per_batch).select("digest", "keep_id", "n_rows")
    members = prints.join(state.hint("merge"), "digest")
    hits = shared.written(members.where("n_rows > 1").select("file", "row", "digest").distinct(), "exact-hits")
    texts = docs.join(hits.hint("shuffle_hash"), ["file", "row"]).groupBy("digest", "text").agg(F.max("doc_id").alias("by_text"))
    clash = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not clash.isEmpty():
        full = docs.select("doc_id", "text", digest(F.col("text")).alias("digest")).join(clash.select("digest"), "digest", "left_semi")
        sizes = full.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
        resolved = full.join(sizes, ["digest", "text"]).select("doc_id", "digest", "keep_id", "n_rows")
        members = members.select("doc_id", "digest", "keep_id", "n_rows").join(clash.select("digest"), "digest", "left_anti").unionByName(resolved)
    return members.select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest"
    )


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    lost = exact_groups(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_lost"), "left_anti")
