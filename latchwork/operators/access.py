"""Checks, enumerations and counts over grants; ``most_rows`` is the limit of ``Evaluation``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.schema import Schema
from .grants import Evaluation


def check(schema: Schema, edges: DataFrame, demands: DataFrame, resource_type: str, permission: str, subject_type: str, most_rows: int | None = None) -> DataFrame:
    """``demands`` (subject_id, resource_id and others) with ``allowed``: does the subject hold the permission?

    Unknown ids hold nothing. Repeated demands keep a row each. All demands are one
    evaluation, bounded from both sides: the demand goes down the rules from the
    resources asked for, and meets the edges of the subjects asked for only. So neither
    a subject who holds everything nor a resource that all share brings in the rest.
    """
    schema.require_type(subject_type)
    schema.require_permission(resource_type, permission)
    run = Evaluation(schema, edges, subject_type, demands.select("subject_id"), most_rows)
    held = run.demanded(resource_type, permission, demands.select("resource_id")).select(F.col("subject_id").alias("s"), F.col("resource_id").alias("r"))
    both = demands.join(held, (demands.subject_id == held.s) & (demands.resource_id == held.r), "left")
    return both.withColumn("allowed", F.col("s").isNotNull()).drop("s", "r")


def lookup_resources(schema: Schema, edges: DataFrame, resource_type: str, permission: str, subject_type: str, subjects: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    """Distinct (subject_id, resource_id): the resources on which subjects hold a permission, all subjects if none are given."""
    schema.require_type(subject_type)
    schema.require_permission(resource_type, permission)
    return Evaluation(schema, edges, subject_type, subjects, most_rows).grants(resource_type, permission).select("subject_id", "resource_id")


def lookup_subjects(schema: Schema, edges: DataFrame, resource_type: str, permission: str, subject_type: str, resources: DataFrame | None = None, most_rows: int | None = None) -> DataFrame:
    """Distinct (resource_id, subject_id): the subjects of a type that hold a permission on resources, all resources if none are given."""
    schema.require_type(subject_type)
    schema.require_permission(resource_type, permission)
    run = Evaluation(schema, edges, subject_type, most_rows=most_rows)
    held = run.grants(resource_type, permission) if resources is None else run.demanded(resource_type, permission, resources)
    return held.select("resource_id", "subject_id")


def count_by(held: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Distinct counts by ``key`` of (subject_id, resource_id) rows: (key, count, limit, truncated).

    With a limit of n the count stops at n, and truncated says whether there is more; without one the limit is -1.
    """
    if limit is not None and limit < 0:
        raise EngineError("count/invalid-limit", f"{limit} isn't a count", limit=limit)
    n = F.count("*").cast("long")
    counted = held.groupBy(key).agg(n.alias("n"))
    if limit is None:
        return counted.select(key, F.col("n").alias("count"), F.lit(-1).cast("long").alias("limit"), F.lit(False).alias("truncated"))
    return counted.select(key, F.least("n", F.lit(limit)).alias("count"), F.lit(limit).cast("long").alias("limit"), (F.col("n") > limit).alias("truncated"))


def count_one(held: DataFrame, limit: int | None = None) -> tuple[int, int, bool]:
    """(count, limit, truncated) of distinct rows; with a limit no more than limit + 1 rows are counted."""
    if limit is None:
        return held.count(), -1, False
    if limit < 0:
        raise EngineError("count/invalid-limit", f"{limit} isn't a count", limit=limit)
    n = held.limit(limit + 1).count()
    return min(n, limit), limit, n > limit
