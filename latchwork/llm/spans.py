"""Spans of regular expressions, as DataFrame expressions: code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:int,end:int,hit:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches an empty string.

    The text between matches (split) and the matches themselves alternate, so running
    lengths give the positions.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"))

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(seen["found"], F.array(span)).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))
    return F.when(F.size(hits) > 0, F.aggregate(steps, zero, step, lambda seen: seen["found"])).otherwise(no_spans())


def in_order(found: Column) -> Column:
    """By start, then kind, then end."""
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def written(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(in_order(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
