"""Expansion: the tree of a permission on resources, as tables of nodes and leaf subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.schema import Schema
from ..sources.tables import settle
from .grants import relation_edges

MOST_DEPTH, MOST_NODES = 50, 100_000


def escaped(name: Column) -> Column:
    """An id as a part of a path: %, / and : by their codes."""
    out = name.cast("string")
    for mark, code in (("%", "%25"), ("/", "%2F"), (":", "%3A")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def expand(schema: Schema, edges: DataFrame, resource_type: str, name: str, resources: DataFrame, most_nodes: int | None = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (root_id, path, parent, depth, object_type, object_id, name, kind) and leaves (root_id, path, subject_type, subject_id).

    A node is a relation (kind leaf: its subjects) or a permission (kind union: its
    children in the schema's order). An arrow has a child for each edge that it follows.
    Nothing is made distinct: two ways to a subject are two leaves. Each level is one
    join with the edges for each permission on it, for all roots at once, written and
    counted as one table. Ids stand in paths with %, / and : escaped. An object
    that comes up again below itself is an error, as is a tree deeper than 50 levels or,
    with ``most_nodes``, larger than that.
    """
    schema.require_expandable(resource_type, name)
    key = lambda t, n, o: F.concat_ws("#", F.lit(t), o.cast("string"), F.lit(n))
    roots = resources.select(F.col("resource_id").alias("root_id"), F.col("resource_id").alias("object_id")).distinct()
    roots = roots.withColumn("path", F.lit(name)).withColumn("seen", F.array(key(resource_type, name, F.col("object_id")))).withColumn("parent", F.lit(None).cast("string"))
    level = {(resource_type, name): roots}
    nodes, leaves, total = [], [], 0
    for depth in range(MOST_DEPTH + 1):
        below: dict[tuple[str, str], list[DataFrame]] = {}
        for (t, n), rows in sorted(level.items()):
            kind = "union" if (t, n) in schema.permissions else "leaf"
            nodes.append(rows.select("root_id", "path", "parent", F.lit(depth).alias("depth"), F.lit(t).alias("object_type"), "object_id", F.lit(n).alias("name"), F.lit(kind).alias("kind")))
            if kind == "leaf":
                held = relation_edges(edges, t, n).select(F.col("resource_id").alias("object_id"), "subject_type", "subject_id")
                leaves.append(rows.join(held, "object_id").select("root_id", "path", "subject_type", "subject_id"))
                continue
            for rule in schema.permissions[(t, n)]:
                if rule.via is None:
                    child = rows.select("root_id", "object_id", F.col("path").alias("parent"), F.concat("path", F.lit(f"/{rule.target}")).alias("path"), "seen")
                    below.setdefault((t, rule.target), []).append(child)
                    continue
                for through in schema.relations[(t, rule.via)]:
                    via = relation_edges(edges, t, rule.via, through).select(F.col("resource_id").alias("object_id"), F.col("subject_id").alias("next_id"))
                    path = F.concat("path", F.lit(f"/{rule.via}:{through}:"), escaped(F.col("next_id")), F.lit(f"/{rule.target}"))
                    child = rows.join(via, "object_id").select("root_id", F.col("next_id").alias("object_id"), F.col("path").alias("parent"), path.alias("path"), "seen")
                    below.setdefault((through, rule.target), []).append(child)
        if not below:
            break
        parts = []
        for (t, n), made in below.items():
            own = key(t, n, F.col("object_id"))
            rows = reduce(DataFrame.union, made).withColumn("own", own)
            parts.append(rows.select(F.lit(t).alias("type"), F.lit(n).alias("name"), "root_id", "object_id", "path", F.concat("seen", F.array("own")).alias("seen"), "parent", F.array_contains("seen", F.col("own")).alias("again")))
        settled, _ = settle(reduce(DataFrame.union, parts), "level")
        # One row for each permission of the level.
        sums = settled.groupBy("type", "name").agg(F.count("*").alias("n"), F.max(F.when(F.col("again"), F.struct("object_id", "path"))).alias("looped")).collect()
        for r in sums:
            if r.looped:
                raise EngineError("permission-tree/cycle-detected", f"{r.type}:{r.looped.object_id} comes up again below itself", path=r.looped.path)
        total += sum(r.n for r in sums)
        columns = ("root_id", "object_id", "path", "seen", "parent")
        level = {(r.type, r.name): settled.where((F.col("type") == r.type) & (F.col("name") == r.name)).select(*columns) for r in sums}
        if most_nodes is not None and total > most_nodes:
            raise EngineError("permission-tree/limit-exceeded", f"more than {most_nodes} nodes", limit="nodes")
        if not level:
            break
    else:
        raise EngineError("permission-tree/limit-exceeded", f"deeper than {MOST_DEPTH} levels", limit="depth")
    none = roots.select("root_id", "path", F.lit("").alias("subject_type"), F.col("object_id").alias("subject_id")).where(F.lit(False))
    return reduce(DataFrame.union, nodes), reduce(DataFrame.union, leaves) if leaves else none


def as_tree(nodes: DataFrame, leaves: DataFrame) -> dict:
    """The nested tree of one root, made on the driver: more than MOST_NODES nodes and leaves together are an error. Larger trees stay the two tables."""
    rows = nodes.limit(MOST_NODES + 1).collect()
    held = leaves.limit(max(0, MOST_NODES - len(rows)) + 1).collect()
    if len(rows) + len(held) > MOST_NODES:
        raise EngineError("permission-tree/limit-exceeded", f"more than {MOST_NODES} nodes and leaves", limit="leaves" if len(rows) <= MOST_NODES else "nodes")
    subjects: dict[str, list] = {}
    for r in sorted(held, key=lambda r: (r.path, r.subject_type, str(r.subject_id))):
        subjects.setdefault(r.path, []).append({"type": r.subject_type, "id": r.subject_id})
    made, children, top = {}, {}, None
    for r in sorted(rows, key=lambda r: (r.depth, r.path)):
        node = {"object": {"type": r.object_type, "id": r.object_id}, "name": r.name}
        node |= {"leaf": {"subjects": subjects.get(r.path, [])}} if r.kind == "leaf" else {"intermediate": {"operation": "union", "children": children.setdefault(r.path, [])}}
        made[r.path] = node
        if r.parent is None:
            top = node
        else:
            children.setdefault(r.parent, []).append(node)
    return top
