"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, settle

__all__ = ["LOWER", "UPPER", "ascii_lower", "bounded_batches", "discard", "pick", "settle"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name.

    Other columns may have any name, also one that differs in case only: they are
    renamed by position before the selection, so no reference is ambiguous.
    """
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch, and bounded bytes where Spark knows that setting, so that long texts fit a task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
