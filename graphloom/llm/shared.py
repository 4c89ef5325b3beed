"""Reading tables, cutting lineage through written tables, and small column helpers."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) only, so that no other column can clash with an operator's own."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by spark.checkpoint.dir; a local session without one uses this machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="graphloom-"))
        at = f"file://{_own[0].name}"
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the process; its cluster then clears the folder
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; removed when this process ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: [_remove(*x) for x in _written])
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # Shuffle files of the write are of no more use once the table is there.
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    if isinstance(df_or_path, str):
        _remove(spark, df_or_path)
        return
    for path in {x.rsplit("/", 1)[0] for x in df_or_path.inputFiles()}:
        if "/graphloom/" in path:
            _remove(spark, path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_fold(divisor: int, remainder: int):
    """crc32(doc_id as text) mod divisor = remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == remainder


def log_factor(n: int) -> float:
    return math.log2(max(2, n))
