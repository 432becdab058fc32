"""Folder for intermediate tables that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST, BROADCAST_MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

_own: dict[str, str] = {}
#: (table, folder) of what the innermost ``scratch`` has seen written; None outside of one.
_written: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("written", default=None)


def _local_only(spark: SparkSession) -> bool:
    """One JVM, so that the driver's disk is every task's disk; ``local-cluster`` is not."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names; in one-JVM mode, where none is named, one of its own until the process ends."""
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    if not _local_only(spark):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="larder-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _tidy(spark: SparkSession):
    """Let Spark remove an execution's shuffle files at its end: what it wrote is all that is read later."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def measured_joins(spark: SparkSession):
    """What is written inside broadcasts a table only where the size of its rows, measured while the job runs, allows it.

    Before the run Spark goes by the size of files. Rows of a written table that
    repeat their texts take a hundred times that in the driver, which builds them.
    """
    before = {k: spark.conf.get(k, None) for k in (BROADCAST, BROADCAST_MEASURED)}
    spark.conf.set(BROADCAST_MEASURED, before[BROADCAST_MEASURED] or spark.conf.get(BROADCAST))
    spark.conf.set(BROADCAST, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage of a table that several outputs reuse; an executor loss
    re-reads files instead of recomputing the whole plan.
    """
    path = shared_dir(df.sparkSession, label)
    with _tidy(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (seen := _written.get()) is not None:
        seen.append((table, path))
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside are removed at the end, but for those passed to the function it gives.

    What leaves the block may read those kept and nothing else written inside; a
    block around this one removes them in turn. Where the block fails, the tables
    stay until the shared folder is cleared.
    """
    seen, outer, stay = [], _written.get(), []
    token = _written.set(seen)

    def keep(table: DataFrame) -> DataFrame:
        stay.append(table)
        return table

    try:
        yield keep
    finally:
        _written.reset(token)
    for table, path in seen:
        if any(table is x for x in stay):
            if outer is not None:
                outer.append((table, path))
        else:
            remove(spark, path)


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own making, wherever the shared folder is."""
    fs, place = _at(spark, path)
    fs.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if there is no such folder."""
    fs, place = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
