"""Filtered reads of edges, in a stable order, and pages of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.schema import Schema
from .grants import EDGE

FILTERS = ("subject_type", "subject_id", "resource_type", "resource_id", "relation")
MOST_ROWS, DEFAULT_ROWS = 10_000, 1_000


def validate(filters: dict) -> dict:
    """The filters that are set; at least one type or id, no unknown ones, and a subject's id only with its type."""
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise EngineError("filters/unknown-filter", f"unknown filters {sorted(unknown)}", filters=sorted(unknown))
    for key, value in filters.items():
        if value is None or value == "":
            raise EngineError("filters/missing-anchor", f"{key} has no value", filter=key)
    if not filters:
        raise EngineError("filters/missing-anchor", "a read needs a filter")
    if "subject_id" in filters and "subject_type" not in filters:
        raise EngineError("filters/missing-subject-type", "subject_id needs subject_type")
    return filters


def scan_kind(filters: dict) -> str:
    """Which side leads the order: that of a given id, else that of the subject's type."""
    if "subject_id" in filters:
        return "exact" if "resource_id" in filters else "forward-anchored"
    if "resource_id" in filters:
        return "reverse-anchored"
    return "forward-partial" if "subject_type" in filters else "reverse-partial"


def read(schema: Schema, edges: DataFrame, **filters) -> DataFrame:
    """Edges that match all filters, with ``spec`` (the place of their relation among the matching ones, by name), ``major`` and ``minor``.

    Only matching relations of the schema are read. The order is (spec, major, minor).
    """
    wanted = validate(filters)
    for key in ("subject_type", "resource_type"):
        if key in wanted:
            schema.require_type(wanted[key])
    specs = sorted((rt, name, st) for (rt, name), types in schema.relations.items() for st in types)
    specs = [s for s in specs if all(wanted.get(k, v) == v for k, v in zip(("resource_type", "relation", "subject_type"), s, strict=True))]
    if "relation" in wanted and not specs:
        raise EngineError("unknown-relation-or-permission", f"no relation {wanted['relation']} matches", name=wanted["relation"])
    rows = edges.select(*EDGE)
    for key in ("subject_id", "resource_id"):
        if key in wanted:
            rows = rows.where(F.col(key) == wanted[key])
    place = F.lit(None).cast("int")
    for i, (rt, name, st) in reversed(list(enumerate(specs))):
        place = F.when((F.col("resource_type") == rt) & (F.col("relation") == name) & (F.col("subject_type") == st), i).otherwise(place)
    named = reduce(Column.__or__, [(F.col("resource_type") == rt) & (F.col("relation") == name) & (F.col("subject_type") == st) for rt, name, st in specs], F.lit(False))
    rows = rows.where(named).withColumn("spec", place)
    by_resource = scan_kind(wanted) in ("forward-anchored", "forward-partial", "exact")
    major, minor = ("resource_id", "subject_id") if by_resource else ("subject_id", "resource_id")
    return rows.withColumn("major", F.col(major)).withColumn("minor", F.col(minor))


def page_size(n) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= MOST_ROWS:
        raise EngineError("pagination/invalid-page-size", f"a page has 1 to {MOST_ROWS} rows, not {n}", size=n)
    return n


def _literal(value) -> Column:
    """A key's value as a column: a plain one, or a path of (rule, through) steps."""
    if not isinstance(value, list | tuple):
        return F.lit(value)
    return F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(through).alias("through")) for rule, through in value]).cast("array<struct<rule:int,through:string>>")


def keyset_page(rows: DataFrame, keys: tuple[str, ...], first: int | None = None, after: tuple | None = None, last: int | None = None, before: tuple | None = None) -> tuple[DataFrame, int, bool]:
    """Rows of one page and one more, in the page's direction; the page's size; whether it runs backwards.

    The bound is a comparison of the keys, so Spark keeps the few smallest rows of each
    task and nothing is skipped over.
    """
    if (first is not None or after is not None) and (last is not None or before is not None):
        raise EngineError("pagination/invalid-page", "first and after don't go with last and before")
    backwards = last is not None or before is not None
    size = page_size(last if backwards else first) if (last if backwards else first) is not None else DEFAULT_ROWS
    bound = before if backwards else after
    if bound is not None:
        beyond, tied = F.lit(False), F.lit(True)
        for key, value in zip(keys, bound, strict=True):
            column, value = F.col(key), _literal(value)
            beyond = beyond | (tied & ((column < value) if backwards else (column > value)))
            tied = tied & (column == value)
        rows = rows.where(beyond)
    order = [F.col(k).desc() if backwards else F.col(k).asc() for k in keys]
    return rows.orderBy(*order).limit(size + 1), size, backwards
