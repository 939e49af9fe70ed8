"""Objects: numbers for public ids, retraction with components, and the move from single edges to halves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError
from ..sources.tables import settle
from .grants import EDGE, reach


def dictionary(edges: DataFrame, known: DataFrame | None = None, rows_a_part: int = 500_000) -> DataFrame:
    """(type, id, eid): a number for each object that edges have as an end; known ones keep theirs.

    New objects are numbered part by part after the largest known number, in as many parts
    as their number asks for, so no task sees all of them.
    """
    ends = edges.select(F.col("subject_type").alias("type"), F.col("subject_id").alias("id")).union(edges.select("resource_type", "resource_id")).distinct()
    fresh = ends if known is None else ends.join(known, ["type", "id"], "left_anti")
    fresh, _ = settle(fresh, "objects")
    parts = 1 + fresh.count() // rows_a_part
    fresh = fresh.withColumn("part", F.pmod(F.xxhash64("type", "id"), F.lit(parts)).cast("int"))
    largest = known.agg(F.coalesce(F.max("eid"), F.lit(0))).first()[0] if known is not None else 0
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    before = fresh.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("type", "id"))
    numbered = fresh.withColumn("rank", rank).join(F.broadcast(before), "part")
    numbered = numbered.select("type", "id", (F.col("rank") + F.col("before") + largest).cast("long").alias("eid"))
    return numbered if known is None else known.select("type", "id", "eid").union(numbered)


def encode(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges with eids in place of ids; edges with an end that has none are left out."""
    s = objects.select(F.col("type").alias("subject_type"), F.col("id").alias("subject_id"), F.col("eid").alias("subject_eid"))
    r = objects.select(F.col("type").alias("resource_type"), F.col("id").alias("resource_id"), F.col("eid").alias("resource_eid"))
    both = edges.join(s, ["subject_type", "subject_id"]).join(r, ["resource_type", "resource_id"])
    return both.select("subject_type", F.col("subject_eid").alias("subject_id"), "relation", "resource_type", F.col("resource_eid").alias("resource_id"))


def decode(rows: DataFrame, objects: DataFrame, column: str, type_name: str, required: bool = True) -> DataFrame:
    """Rows with the public id in ``column``; an eid without one is an error if ``required``, else a null."""
    names = objects.where(F.col("type") == type_name).select(F.col("eid").alias(column), F.col("id").alias("public_id"))
    out = rows.join(names, column, "left")
    if required and not out.where(F.col("public_id").isNull() & F.col(column).isNotNull()).isEmpty():
        raise EngineError("unresolvable-object", f"a {type_name} has no public id")
    return out.drop(column).withColumnRenamed("public_id", column)


def component_closure(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (type, id): the roots and all that ``parts`` (owner_type, owner_id, type, id) puts below them."""
    name = lambda t, i: F.concat_ws("\0", t, i)
    seed = roots.select(F.lit(0).alias("node"), name(F.col("type"), F.col("id")).alias("resource_id"), F.lit("").alias("subject_type"), F.lit("").alias("subject_id")).distinct()
    steps = parts.select(F.lit(0).alias("from_node"), name(F.col("owner_type"), F.col("owner_id")).alias("from_id"), F.lit(0).alias("to_node"), name(F.col("type"), F.col("id")).alias("to_id"))
    found, _ = reach(seed, steps)
    split = F.split("resource_id", "\0", 2)
    return found.select(split[0].alias("type"), split[1].alias("id"))


def retract(edges: DataFrame, objects: DataFrame, parts: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and objects that stay once roots and their components go, and the relations whose edges changed."""
    gone = component_closure(parts, roots)
    at = lambda side: gone.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"))
    kept = edges.join(at("subject"), ["subject_type", "subject_id"], "left_anti").join(at("resource"), ["resource_type", "resource_id"], "left_anti").select(*EDGE)
    touched = edges.select(*EDGE).join(kept, list(EDGE), "left_anti").select("resource_type", "relation", "subject_type").distinct()
    return kept, objects.join(gone, ["type", "id"], "left_anti"), touched


def to_halves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two copies of single edges, each in the order that its scans read."""
    rows = edges.select(*EDGE).distinct()
    return rows.sortWithinPartitions("subject_type", "subject_id", "relation", "resource_type", "resource_id"), rows.sortWithinPartitions("resource_type", "resource_id", "relation", "subject_type", "subject_id")


def migration_gaps(edges: DataFrame, forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Single edges that a copy lacks, with the copy's name; no rows: the move is complete."""
    lacking = lambda half, name: edges.select(*EDGE).join(half, list(EDGE), "left_anti").withColumn("half", F.lit(name))
    return lacking(forward, "forward").union(lacking(reverse, "reverse"))
