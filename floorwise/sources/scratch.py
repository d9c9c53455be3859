"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    That folder is taken as it is named. Where the setting is absent, a local session takes a temporary folder and any other
    takes the warehouse if that is shared; a folder of one machine is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return _local_root()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise ValueError("spark.checkpoint.dir is unset and the warehouse is a folder of one machine; name a shared folder")
    return warehouse + "/_scratch"


def _local_root(made: list[str] = []) -> str:  # noqa: B006  one folder for the process
    if not made:
        made.append("file://" + tempfile.mkdtemp(prefix="floorwise-"))
    return made[0]


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; it goes when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    hadoop, files = _hadoop(spark, path)
    files.delete(hadoop, True)


#: Files of the shuffles behind a table go once it is written, not when the driver's JVM collects their plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


_scopes = threading.local()


@contextmanager
def tidy() -> Iterator[None]:
    """Tables written in this block go when it ends, but for those that are kept for the block around it."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for table in stack.pop():
            if not table.kept:
                table.discard()
            elif stack:  # the block around this one has it now
                table.kept = False
                stack[-1].append(table)


class Written:
    """A DataFrame written once as Parquet and read again, which cuts its lineage.

    ``keep`` leaves the table to the block around the innermost ``tidy``, or to the caller's plan.
    """

    def __init__(self, df: DataFrame, name: str, keep: bool = False):
        self.spark, self.kept = df.sparkSession, keep
        self.path = scratch_path(self.spark, name)
        _write(df, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        stack = getattr(_scopes, "stack", None)
        if stack:
            stack[-1].append(self)

    def discard(self) -> None:
        discard(self.spark, self.path)
