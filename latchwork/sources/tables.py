"""Tables that cut lineage: written to the shared folder and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: A setting of Spark from 4.0 on; earlier ones ignore it.
_END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="latchwork-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode, where it is unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir()


@contextmanager
def ended_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made inside let go of their shuffle files as soon as an action on them has ended; the session's own setting comes back."""
    before = spark.conf.get(_END_SHUFFLES, None)
    spark.conf.set(_END_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_END_SHUFFLES)
        else:
            spark.conf.set(_END_SHUFFLES, before)


def settle(df: DataFrame, name: str, rows_a_file: int | None = None) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it again: lineage ends there. Returns it and its path.

    Once it is written, nothing reads the shuffles behind it any more, so their files go
    then and not when the driver's garbage collector finds them. ``rows_a_file``: rows of
    a file at most, for very large ones, since Parquet's writer and reader hold many rows
    of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latchwork-{uuid.uuid4().hex}/{name}"
    with ended_shuffles(spark):
        df.select("*").write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file or 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes settled tables that no later plan reads."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)
