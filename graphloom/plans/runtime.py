"""Lineage, iteration and scalar state for algorithms that run to a fixed point."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_own: list[tempfile.TemporaryDirectory] = []
_paths: list[tuple[SparkSession, str]] = []
#: Tables made by the operators that run now, the innermost last.
_scopes: list[list[DataFrame]] = []


class FailedToConvergeError(Exception):
    """An iteration ran out of rounds before its tolerance was met."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one uses a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="graphloom-"))
        at = f"file://{_own[0].name}"
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the process does
        pass


@contextmanager
def _freed(spark: SparkSession):
    """Of what is written meanwhile, Spark deletes the shuffle files as soon as it is written, and not when garbage happens to be collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: its lineage ends, losing an executor loses nothing, and what it shuffled is freed.

    With `by` the table is bucketed by that column, so that joins and groupings on it, round after round, move only the
    other side.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/graphloom/core-{name}"
    if not _paths:
        atexit.register(lambda: [_drop(*x) for x in _paths])
    _paths.append((spark, path))
    if by is None:
        with _freed(spark):
            df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        with _freed(spark):
            df.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(f"graphloom_{name}")
        out = spark.table(f"graphloom_{name}")
    if _scopes:
        _scopes[-1].append(out)
    return out


def tidy(spark: SparkSession) -> None:
    """Has Python and the driver collect their garbage, upon which Spark deletes shuffle files of finished jobs; they would else stay for up to 30 minutes.

    More than once: events of a job that has just ended hold its plan for a while.
    """
    for _ in range(3):
        gc.collect()
        with suppress(Exception):  # a busy bus only means that less is freed
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def release(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    for path in _folders(df):
        _drop(df.sparkSession, path)
        table = f"graphloom_{path.rsplit('core-', 1)[1]}"
        if df.sparkSession.catalog.tableExists(table):
            df.sparkSession.sql(f"DROP TABLE {table}")


def _folders(df: DataFrame) -> set[str]:
    return {path for path in (f.rsplit("/", 1)[0] for f in df.inputFiles()) if "/graphloom/core-" in path}


def scoped(operator):
    """Frees the tables that an operator's rounds have made, but for those that its result reads."""

    @wraps(operator)
    def run(*args, **options):
        _scopes.append([])
        try:
            out = operator(*args, **options)
        except BaseException:
            _scopes.pop()
            raise
        made, read = _scopes.pop(), set()
        parts = out if isinstance(out, tuple) else (out,)
        for x in [y for part in parts for y in (part, getattr(part, "edges", None), getattr(part, "vertices", None))]:
            if isinstance(x, DataFrame):
                read |= {f.rsplit("core-", 1)[1] for f in _folders(x)}
        for table in made:
            folders = _folders(table)
            if any(f.rsplit("core-", 1)[1] in read for f in folders):
                if _scopes:
                    _scopes[-1].append(table)
            elif folders:
                release(table)
        return out

    return run


def iterate(
    state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool] | None, max_iter: int, every: int = 1
) -> tuple[DataFrame, bool]:
    """state = step(state, round) until done(old, new) or max_iter rounds; each round's table is cut.

    Without `done`, exactly max_iter rounds run, and lineage is cut after every `every` of them but the last: a step that
    uses its state more than once would else repeat all earlier rounds as often.
    """
    if done is None:
        for i in range(max_iter):
            state = step(state, i)
            if i % every == every - 1 and i + 1 < max_iter:
                state = cut(state)
        return state, True
    state = cut(state)
    for i in range(max_iter):
        new = cut(step(state, i))
        over = done(state, new)
        release(state)
        state = new
        if over:
            return state, i + 1 < max_iter
    return state, False
