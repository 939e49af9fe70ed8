"""Integrity of edges kept in two copies: halves without their peer, reports and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from .grants import EDGE


def dangling(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Edges in one copy only, with ``half``: forward or reverse."""
    keys = list(EDGE)
    alone = lambda a, b, half: a.select(*keys).join(b.select(*keys), keys, "left_anti").withColumn("half", F.lit(half))
    return alone(forward, reverse, "forward").union(alone(reverse, forward, "reverse"))


def report(halves: DataFrame, sample: int = 10) -> dict:
    """Number of dangling halves, by half, and a few of them."""
    if sample < 0:
        raise EngineError("integrity/invalid-options", f"{sample} isn't a sample size")
    counts = {r["half"]: r["count"] for r in halves.groupBy("half").count().collect()}
    return {"total": sum(counts.values()), "by_half": counts, "sample": [r.asDict() for r in halves.orderBy("half", *EDGE).limit(sample).collect()]}


def repaired(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """The edges that both copies hold."""
    return forward.select(*EDGE).join(reverse.select(*EDGE), list(EDGE), "left_semi").distinct()


def relation_counts(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(resource_type, relation, subject_type, n): the larger of both copies' counts."""
    keys = ["resource_type", "relation", "subject_type"]
    both = forward.select(*keys, F.lit(1).alias("f"), F.lit(0).alias("r")).union(reverse.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg(F.greatest(F.sum("f"), F.sum("r")).alias("n"))
