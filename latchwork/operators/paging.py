"""Pages of enumerations: an order by least derivation, signed cursors, and page assembly."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.tokens import Signer
from ..plans.schema import Schema
from .grants import Evaluation, relation_edges
from .relationships import keyset_page


@dataclass
class Page:
    """At most 10,000 rows in forward order, and where they begin and end.

    ``ordinal`` is the place of the first row in the whole enumeration, counted from
    one. Pages that start from its end don't know it.
    """

    data: list[dict]
    start_cursor: str | None
    end_cursor: str | None
    has_next: bool
    has_previous: bool
    ordinal: int | None = None


def least_paths(schema: Schema, edges: DataFrame, resource_type: str, permission: str, subject_type: str, subject_id) -> DataFrame:
    """(resource_id, path): the least derivation of each resource of a permission that isn't recursive.

    A path lists, from the permission down, each rule's place in the canonical order and
    the object that it goes through; paths compare as arrays do, so this is an order of
    results that doesn't depend on how they were found.
    """
    if schema.is_recursive((resource_type, permission)):
        raise EngineError("pagination/recursive-order", "a recursive permission has no least path; its order is by id")
    made: dict[tuple[str, str], DataFrame] = {}

    def step(ordinal: int, column: str):
        return F.array(F.struct(F.lit(ordinal).alias("rule"), F.col(column).cast("string").alias("through")))

    def holders(t: str, relation: str) -> DataFrame:
        return relation_edges(edges, t, relation, subject_type).where(F.col("subject_id") == subject_id)

    for (node,), _ in ((tuple(g), r) for g, r in schema.components((resource_type, permission))):
        parts = []
        for rule in schema.permissions[node]:
            if rule.kind == "direct":
                parts.append(holders(node[0], rule.target).select("resource_id", step(rule.ordinal, "resource_id").alias("path")))
            elif rule.kind == "self":
                inner = made[(node[0], rule.target)]
                parts.append(inner.select("resource_id", F.concat(step(rule.ordinal, "resource_id"), "path").alias("path")))
            else:
                for t in schema.relations[(node[0], rule.via)]:
                    via = relation_edges(edges, node[0], rule.via, t).select("resource_id", F.col("subject_id").alias("through"))
                    if rule.kind == "arrow_relation":
                        inner = holders(t, rule.target).select(F.col("resource_id").alias("through"), F.array().cast("array<struct<rule:int,through:string>>").alias("path"))
                    else:
                        inner = made[(t, rule.target)].select(F.col("resource_id").alias("through"), "path")
                    parts.append(via.join(inner, "through").select("resource_id", F.concat(step(rule.ordinal, "through"), "path").alias("path")))
        made[node] = reduce(DataFrame.union, parts).groupBy("resource_id").agg(F.min("path").alias("path"))
    return made[(resource_type, permission)]


def assemble(rows: DataFrame, keys: tuple[str, ...], signer: Signer, scope: dict, columns: tuple[str, ...], first=None, after=None, last=None, before=None, held: dict | None = None) -> Page:
    """A page of ``rows`` ordered by ``keys``.

    Cursors are signed with their scope and refused in any other. They carry the keys and
    columns of their row, its ordinal, and what ``held`` says.
    """
    cursor = after if after is not None else before
    told = signer.read(cursor, scope) if cursor is not None else None
    bound = tuple(told["at"]) if told else None
    chosen, size, backwards = keyset_page(rows, keys, first, bound if after is not None else None, last, bound if before is not None else None)
    got = [r.asDict(recursive=True) for r in chosen.collect()]
    more = len(got) > size
    got = got[:size][::-1] if backwards else got[:size]
    if not got:
        return Page([], None, None, False, False)
    start = 1 if told is None else told["ordinal"]
    if told and start is not None:
        start = start - len(got) if backwards else start + 1
    start = None if backwards and told is None else start
    plain = lambda v: [[s["rule"], s["through"]] for s in v] if isinstance(v, list) else v
    mark = lambda i: signer.issue({"at": [plain(got[i][k]) for k in keys], "row": {c: got[i][c] for c in columns}, "ordinal": start + i % len(got) if start else None, **(held or {})}, scope)
    has_next, has_previous = (before is not None, more) if backwards else (more, after is not None)
    return Page([{c: r[c] for c in columns} for r in got], mark(0), mark(-1), has_next, has_previous, start)


def resources_page(schema: Schema, edges: DataFrame, resource_type: str, permission: str, subject_type: str, subject_id, signer: Signer, scope: dict, evaluation: str | None = None, most_rows: int | None = None, **page) -> Page:
    """A page of the resources on which one subject holds a permission.

    The order is that of least paths; that of ids for recursive permissions. Pages of one
    snapshot, put together, are the whole enumeration without repeats. The end of a
    recursive enumeration is known only once all of it is: a bare ``last`` there needs
    ``evaluation`` complete-denotation.
    """
    schema.require_type(subject_type)
    schema.require_permission(resource_type, permission)
    if evaluation not in (None, "complete-denotation"):
        raise EngineError("invalid-request", f"{evaluation} isn't an evaluation", evaluation=evaluation)
    if schema.is_recursive((resource_type, permission)):
        if page.get("last") is not None and page.get("before") is None and evaluation is None:
            raise EngineError("pagination/complete-evaluation-required", "the last rows of a recursive permission need evaluation complete-denotation")
        one = edges.sparkSession.createDataFrame([(subject_id,)], ["subject_id"])
        rows = Evaluation(schema, edges, subject_type, one, most_rows).grants(resource_type, permission).select("resource_id").withColumn("key", F.col("resource_id"))
    else:
        rows = least_paths(schema, edges, resource_type, permission, subject_type, subject_id).select("resource_id", F.col("path").alias("key"))
    return assemble(rows, ("key", "resource_id"), signer, scope, ("resource_id",), **page)
