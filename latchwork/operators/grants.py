"""Grants: who holds which permission on what, as a least fixed point of the schema's rules.

Edges are a DataFrame (subject_type, subject_id, relation, resource_type, resource_id).
Permissions that don't read themselves become one plan of joins and unions, which
Catalyst orders and into which it pushes filters. A recursive component is reachability
over its transitions, found by doubling path lengths round by round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.schema import Rule, Schema
from ..sources.tables import discard, settle

EDGE = ("subject_type", "subject_id", "relation", "resource_type", "resource_id")
#: Times the edges that the paths of one length may number before rounds follow single edges again.
PATHS_PER_EDGE = 4
MOST_ROUNDS = 100_000

Node = tuple[str, str]


def relation_edges(edges: DataFrame, resource_type: str, relation: str, subject_type: str | None = None) -> DataFrame:
    """The edges of one relation; literals, so that a table partitioned by them is pruned."""
    rows = edges.where((F.col("resource_type") == resource_type) & (F.col("relation") == relation))
    return rows.where(F.col("subject_type") == subject_type) if subject_type else rows


class Evaluation:
    """Evaluates permissions of one schema over one table of edges; nodes are (resource_type, permission).

    ``subject_type`` and ``subjects`` (a DataFrame with subject_id) restrict the holders:
    rules that lead to no such type aren't run, and the seeds are filtered before any join.
    ``most_rows``: rows that a recursive component may reach; more are an error.
    """

    def __init__(self, schema: Schema, edges: DataFrame, subject_type: str | None = None, subjects: DataFrame | None = None, most_rows: int | None = None):
        self.schema, self.edges, self.subject_type, self.subjects, self.most_rows = schema, edges, subject_type, subjects, most_rows
        self.done: dict[Node, DataFrame] = {}
        self.rounds = 0

    def holders(self, resource_type: str, relation: str) -> DataFrame:
        """(resource_id, subject_type, subject_id) of a relation's edges, for the holders asked for."""
        rows = relation_edges(self.edges, resource_type, relation, self.subject_type).select("resource_id", "subject_type", "subject_id")
        return rows.join(self.subjects.select("subject_id").distinct(), "subject_id", "left_semi").select(*rows.columns) if self.subjects is not None else rows

    def _useful(self, node: Node) -> bool:
        return self.subject_type is None or self.subject_type in self.schema.subject_types(node)

    def rule(self, rule: Rule, wanted: DataFrame | None = None) -> DataFrame | None:
        """What one rule that reads no permission of its own component derives, on the ``wanted`` resources if given; not distinct."""
        only = lambda rows: rows if wanted is None else rows.join(wanted, "resource_id", "left_semi")
        if rule.kind == "direct":
            types = self.schema.relations[(rule.resource_type, rule.target)]
            return only(self.holders(rule.resource_type, rule.target)) if self.subject_type is None or self.subject_type in types else None
        if rule.kind == "self":
            node = (rule.resource_type, rule.target)
            return only(self.done[node]).select("resource_id", "subject_type", "subject_id") if self._useful(node) else None
        parts = []
        for t in self.schema.relations[(rule.resource_type, rule.via)]:
            if rule.kind == "arrow_relation":
                if self.subject_type is not None and self.subject_type not in self.schema.relations[(t, rule.target)]:
                    continue
                inner = self.holders(t, rule.target)
            elif self._useful((t, rule.target)):
                inner = self.done[(t, rule.target)]
            else:
                continue
            via = only(relation_edges(self.edges, rule.resource_type, rule.via, t).select("resource_id", F.col("subject_id").alias("through")))
            inner = inner.select(F.col("resource_id").alias("through"), "subject_type", "subject_id")
            parts.append(via.join(inner, "through").select("resource_id", "subject_type", "subject_id"))
        return reduce(DataFrame.union, parts) if parts else None

    def nothing(self) -> DataFrame:
        return self.edges.select("resource_id", "subject_type", "subject_id").where(F.lit(False))

    def grants(self, resource_type: str, permission: str) -> DataFrame:
        """Distinct (resource_id, subject_type, subject_id) of a permission; empty if there is no such permission."""
        root = (resource_type, permission)
        if root not in self.schema.permissions:
            return self.nothing()
        for group, recursive in self.schema.components(root):
            if all(n in self.done for n in group):
                continue
            if recursive:
                self._component(group)
            else:
                parts = [p for r in self.schema.permissions[group[0]] if (p := self.rule(r)) is not None]
                self.done[group[0]] = reduce(DataFrame.union, parts).distinct() if parts else self.nothing()
        return self.done[root]

    def demanded(self, resource_type: str, permission: str, wanted: DataFrame) -> DataFrame:
        """Grants on the ``wanted`` resources (resource_id) alone.

        Down the rules goes the demand, as distinct objects; on these alone grants are
        then derived from the bottom up. Through a recursive component the demand carries
        the resource it is for, and meets holders at the ends.
        """
        node = (resource_type, permission)
        if node not in self.schema.permissions:
            return self.nothing()
        if not any(recursive for _, recursive in self.schema.components(node)):
            return self._from_below(node, wanted.select("resource_id").distinct())
        rows = wanted.select(F.col("resource_id").alias("root"), F.col("resource_id").alias("object")).distinct()
        parts = self._ends(node, rows)
        return reduce(DataFrame.union, parts).select(F.col("root").alias("resource_id"), "subject_type", "subject_id").distinct() if parts else self.nothing()

    def _from_below(self, root: Node, wanted: DataFrame) -> DataFrame:
        """Grants of an acyclic permission on the ``wanted`` resources, from those of what it reads on the objects they lead to."""
        order = [group[0] for group, _ in self.schema.components(root)]
        demand: dict[Node, list[DataFrame]] = {root: [wanted]}
        needed: dict[Node, DataFrame] = {}
        for node in reversed(order):
            here = demand.get(node)
            if not here or not self._useful(node):
                continue
            needed[node] = here[0] if len(here) == 1 else settle(reduce(DataFrame.union, here).distinct(), "demand")[0]
            led: dict[tuple[str, str], DataFrame] = {}
            for rule in self.schema.permissions[node]:
                if rule.kind == "self":
                    demand.setdefault((rule.resource_type, rule.target), []).append(needed[node])
                for t in self.schema.relations[(rule.resource_type, rule.via)] if rule.kind == "arrow_permission" else ():
                    if self._useful((t, rule.target)):
                        if (rule.via, t) not in led:
                            via = relation_edges(self.edges, rule.resource_type, rule.via, t).join(needed[node], "resource_id", "left_semi")
                            led[(rule.via, t)] = settle(via.select(F.col("subject_id").alias("resource_id")).distinct(), "demand")[0]
                        demand.setdefault((t, rule.target), []).append(led[(rule.via, t)])
        below = Evaluation(self.schema, self.edges, self.subject_type, self.subjects, self.most_rows)
        for node in order:
            parts = [p for r in self.schema.permissions[node] if (p := below.rule(r, needed[node])) is not None] if node in needed else []
            below.done[node] = reduce(DataFrame.union, parts).distinct() if parts else self.nothing()
        return below.done[root]

    def _ends(self, node: Node, rows: DataFrame) -> list[DataFrame]:
        """(root, subject_type, subject_id) of the holders that the demand ``rows`` (root, object) on a permission comes to."""
        group, recursive = next((g, r) for g, r in self.schema.components(node) if node in g)
        if not recursive:
            return [p for rule in self.schema.permissions[node] for p in self._end(rule, rows, ())]
        number = {n: i for i, n in enumerate(group)}
        alias = self._aliases(group)
        into = {n: [m for m in group if n in alias[m]] for n in group}
        seed = reduce(DataFrame.union, [rows.select(F.lit(number[m]).alias("node"), F.col("object").alias("resource_id"), F.lit("").alias("subject_type"), F.col("root").alias("subject_id")) for m in into[node]])
        back = []
        for n in group:
            for rule in self.schema.permissions[n]:
                for t in self.schema.relations[(rule.resource_type, rule.via)] if rule.kind == "arrow_permission" else ():
                    if (t, rule.target) in number:
                        via = relation_edges(self.edges, rule.resource_type, rule.via, t)
                        back += [via.select(F.lit(number[n]).alias("from_node"), F.col("resource_id").alias("from_id"), F.lit(number[m]).alias("to_node"), F.col("subject_id").alias("to_id")) for m in into[(t, rule.target)]]
        if back:
            seed, self.rounds = reach(seed, reduce(DataFrame.union, back), most_rows=self.most_rows)
        out = []
        for n in group:
            own = seed.where(F.col("node") == number[n]).select(F.col("subject_id").alias("root"), F.col("resource_id").alias("object"))
            out += [p for rule in self.schema.permissions[n] for p in self._end(rule, own, group)]
        return out

    def _end(self, rule: Rule, rows: DataFrame, group) -> list[DataFrame]:
        """The same for one rule; what it reads inside ``group`` is followed elsewhere."""
        t = rule.resource_type

        def met(type_: str, relation: str, demand: DataFrame) -> list[DataFrame]:
            if self.subject_type is not None and self.subject_type not in self.schema.relations[(type_, relation)]:
                return []
            held = self.holders(type_, relation).withColumnRenamed("resource_id", "object")
            return [demand.join(held, "object").select("root", "subject_type", "subject_id")]

        if rule.kind == "direct":
            return met(t, rule.target, rows)
        if rule.kind == "self":
            return self._ends((t, rule.target), rows) if (t, rule.target) not in group and self._useful((t, rule.target)) else []
        out = []
        for through in self.schema.relations[(t, rule.via)]:
            if rule.kind == "arrow_permission" and ((through, rule.target) in group or not self._useful((through, rule.target))):
                continue
            via = relation_edges(self.edges, t, rule.via, through).select(F.col("resource_id").alias("object"), F.col("subject_id").alias("next"))
            below = rows.join(via, "object").select("root", F.col("next").alias("object")).distinct()
            out += met(through, rule.target, below) if rule.kind == "arrow_relation" else self._ends((through, rule.target), below)
        return out

    def _component(self, group: list[Node]) -> None:
        seeds, steps, number = self._seeds_and_steps(group)
        if not seeds:
            self.done |= {n: self.nothing() for n in group}
            return
        found = reduce(DataFrame.unionByName, seeds).select("node", "resource_id", "subject_type", "subject_id").distinct()
        if steps:
            found, self.rounds = reach(found, reduce(DataFrame.union, steps), most_rows=self.most_rows)
        for n in group:
            self.done[n] = found.where(F.col("node") == number[n]).select("resource_id", "subject_type", "subject_id")

    def _seeds_and_steps(self, group: list[Node]) -> tuple[list[DataFrame], list[DataFrame], dict[Node, int]]:
        """What a component gets from outside it, the steps inside it, and the numbers of its nodes."""
        number = {n: i for i, n in enumerate(group)}
        alias = self._aliases(group)  # node -> nodes that hold whatever it holds
        seeds, steps = [], []
        for node in group:
            for rule in self.schema.permissions[node]:
                inside = [t for t in self.schema.targets(rule) if t in number]
                if not inside:
                    part = self.rule(rule)
                    if part is not None:
                        seeds += [part.withColumn("node", F.lit(number[m])) for m in alias[node]]
                elif rule.kind == "arrow_permission":
                    for t in self.schema.relations[(rule.resource_type, rule.via)]:
                        via = relation_edges(self.edges, rule.resource_type, rule.via, t).select(F.col("subject_id").alias("from_id"), F.col("resource_id").alias("to_id"))
                        if (t, rule.target) in number:
                            steps += [via.select(F.lit(number[(t, rule.target)]).alias("from_node"), "from_id", F.lit(number[m]).alias("to_node"), "to_id") for m in alias[node]]
                        elif self._useful((t, rule.target)):
                            inner = self.done[(t, rule.target)].select(F.col("resource_id").alias("from_id"), "subject_type", "subject_id")
                            part = via.join(inner, "from_id").select(F.col("to_id").alias("resource_id"), "subject_type", "subject_id")
                            seeds += [part.withColumn("node", F.lit(number[m])) for m in alias[node]]
        return seeds, steps, number

    def _aliases(self, group: list[Node]) -> dict[Node, set[Node]]:
        out = {n: {n} for n in group}
        changed = True
        while changed:
            changed = False
            for node in group:
                for rule in self.schema.permissions[node]:
                    if rule.kind == "self" and (rule.resource_type, rule.target) in out:
                        for reached in out.values():
                            if (rule.resource_type, rule.target) in reached and node not in reached:
                                reached.add(node)
                                changed = True
        return out


def reach(seed: DataFrame, steps: DataFrame, most_rounds: int = MOST_ROUNDS, most_rows: int | None = None) -> tuple[DataFrame, int]:
    """All (node, resource_id, subject_type, subject_id) that steps lead to from the seed; and the rounds it took.

    ``steps``: (from_node, from_id, to_node, to_id). Round k joins what is found with the
    pairs joined by exactly 2^k steps, so a chain of length n takes log n rounds; a round
    that finds nothing new ends it. Where pairs of that length would outnumber the
    steps too much, the pairs stay as they are and rounds go on from the newest rows
    alone, as long as there are any. Each round writes its new rows only; the result
    reads all of them. The driver sees counts only. More than ``most_rows`` rows, counted
    after each round, are an error, never a part of the result.
    """
    spark = seed.sparkSession
    row = ["node", "resource_id", "subject_type", "subject_id"]
    delta, seed_path = settle(seed.select(*row).distinct(), "seed")
    found, found_paths = delta, [seed_path]
    single, single_path = settle(steps.distinct(), "paths")
    paths, paths_path = single, single_path
    most, doubling = PATHS_PER_EDGE * max(1, single.count()), True
    for k in range(1, most_rounds + 1):
        if most_rows is not None and found.count() > most_rows:
            raise EngineError("traversal/limit-exceeded", f"a recursive permission reaches more than {most_rows} grants", limit=most_rows)
        source = found if doubling else delta
        led = source.join(paths, (F.col("node") == F.col("from_node")) & (F.col("resource_id") == F.col("from_id")))
        led = led.select(F.col("to_node").alias("node"), F.col("to_id").alias("resource_id"), "subject_type", "subject_id").distinct()
        delta, path = settle(led.join(found, row, "left_anti"), "fresh")
        if delta.isEmpty():
            discard(spark, path)
            return found, k
        found_paths.append(path)
        found = spark.read.schema(delta.schema).parquet(*found_paths)
        if doubling:
            second = paths.select(F.col("from_node").alias("to_node"), F.col("from_id").alias("to_id"), F.col("to_node").alias("last_node"), F.col("to_id").alias("last_id"))
            longer = paths.join(second, ["to_node", "to_id"]).select("from_node", "from_id", F.col("last_node").alias("to_node"), F.col("last_id").alias("to_id")).distinct()
            longer, longer_path = settle(longer.limit(most + 1), "paths")
            if longer.count() > most:
                discard(spark, longer_path)
                doubling, paths, delta = False, single, found
            else:
                paths = longer
            if paths_path != single_path:
                discard(spark, paths_path)
            paths_path = longer_path if doubling else single_path
    raise EngineError("traversal/limit-exceeded", f"no fixed point after {most_rounds} rounds")
