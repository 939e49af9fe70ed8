"""Edges that arrive as a stream: exactly-once ingestion and what it changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.grants import EDGE, Evaluation
from ..plans.schema import Schema
from ..sources.store import Store
from ..sources.tables import settle

UPDATE_SCHEMA = "op string, subject_type string, subject_id string, relation string, resource_type string, resource_id string"


def compared(schema: Schema, before: DataFrame, after: DataFrame, resource_type: str, permission: str) -> tuple[DataFrame, str]:
    """Each edge that the rules of a permission read, once, with ``was`` and ``is`` (there before, there after), as a settled table; and its path."""
    needed = sorted(schema.relation_dependencies((resource_type, permission)))
    read = reduce(Column.__or__, [(F.col("resource_type") == t) & (F.col("relation") == r) for t, r in needed], F.lit(False))
    both = before.select(*EDGE).where(read).withColumn("side", F.lit(0)).union(after.select(*EDGE).where(read).withColumn("side", F.lit(1)))
    by_edge = Window.partitionBy(*EDGE).orderBy("side")
    first, last = F.first("side").over(by_edge), F.last("side").over(by_edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.select(*EDGE, F.lag("side").over(by_edge).alias("prior"), (first == 0).alias("was"), (last == 1).alias("is"))
    return settle(rows.where("prior IS NULL").drop("prior"), "compared")


def touched_resources(schema: Schema, both: DataFrame, resource_type: str, permission: str) -> DataFrame:
    """Distinct resource_id: every resource on which a permission can differ between the two sides of ``compared``.

    Changed edges are marked and the marks follow the rules up. A changed edge gives its
    resource a mark as a holder, and, where a rule arrows through it, leads to an object
    of its subject's type that the mark holds everything on. So only what the marks
    reach is derived, not the grants.
    """
    changed = both.where("was <> is").select(*EDGE)
    kind = both.schema["subject_id"].dataType.simpleString()
    mark, top = (F.lit(v).cast(kind) for v in (("\0mark", "\0top") if kind == "string" else (-(2**31), -(2**31) + 1)))
    held = changed.select("subject_type", mark.alias("subject_id"), "relation", "resource_type", "resource_id")
    led = changed.select("subject_type", top.alias("subject_id"), "relation", "resource_type", "resource_id")
    every = [(st, rel, rt) for (rt, rel), types in sorted(schema.relations.items()) for st in types]
    all_of = both.sparkSession.createDataFrame(every, "subject_type string, relation string, resource_type string")
    on_top = [all_of.select("subject_type", x.alias("subject_id"), "relation", "resource_type", top.alias("resource_id")) for x in (mark, top)]
    edges = both.select(*EDGE).union(held).union(led).union(on_top[0]).union(on_top[1])
    marks = both.sparkSession.range(1).select(mark.alias("subject_id"))
    found = Evaluation(schema, edges, subjects=marks).grants(resource_type, permission).select("resource_id").distinct()
    return found.where(F.col("resource_id") != top)


def changed_grants(schema: Schema, before: DataFrame, after: DataFrame, resource_type: str, permission: str) -> DataFrame:
    """(resource_id, subject_type, subject_id, change): grants of a permission gained or lost between two tables of edges.

    Both tables are read once. Only the resources that changed edges touch are evaluated, before and after.
    """
    both, _ = compared(schema, before, after, resource_type, permission)
    touched, _ = settle(touched_resources(schema, both, resource_type, permission), "touched")
    old, new = (Evaluation(schema, both.where(side).select(*EDGE)).demanded(resource_type, permission, touched) for side in ("was", "is"))
    keys = ["resource_id", "subject_type", "subject_id"]
    sides = old.withColumn("was", F.lit(1)).withColumn("is", F.lit(0)).union(new.withColumn("was", F.lit(0)).withColumn("is", F.lit(1)))
    moved = sides.groupBy(*keys).agg(F.max("was").alias("was"), F.max("is").alias("is")).where("was <> is")
    return moved.select(*keys, F.when(F.col("is") == 1, "gained").otherwise("lost").alias("change"))


def affected_subjects(schema: Schema, edges: DataFrame, changed: DataFrame, resource_type: str, permission: str, subject_type: str) -> DataFrame:
    """Distinct (resource_id, subject_id): who holds a permission on the resources of changed edges, by demand from these."""
    touched = changed.where(F.col("resource_type") == resource_type).select("resource_id").distinct()
    return Evaluation(schema, edges, subject_type).demanded(resource_type, permission, touched).select("resource_id", "subject_id")


def ingest(store: Store, updates: DataFrame, checkpoint: str, notify: Callable[[int, DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Writes a stream of updates (op and the edge's columns) to the store, a version a batch.

    Of several updates of one edge in a batch the last by ``seq`` holds, where there is such a
    column. Updates are applied as touch and delete, so a batch that is repeated after a failure
    changes nothing. ``notify`` gets the version and the batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if "seq" in rows.columns:
            rows = rows.groupBy(*EDGE).agg(F.max_by("op", "seq").alias("op"))
        rows = rows.withColumn("op", F.when(F.col("op") == "create", "touch").otherwise(F.col("op")))
        store.write_relationships(rows)
        if notify:
            notify(store.current().version, rows)

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
