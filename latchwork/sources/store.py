"""A versioned store of edges and schemas: Parquet deltas and commit files that only one writer can create."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineError
from ..functions.tokens import Signer
from ..operators.grants import EDGE
from ..plans.schema import Schema, difference, relation_id
from .tables import ended_shuffles

EDGE_SCHEMA = "subject_type string, subject_id string, relation string, resource_type string, resource_id string"
OPERATIONS = ("create", "touch", "delete")
#: Deltas after which a commit also writes all edges, so that a read joins no more of them.
COMPACT_AFTER = 16
#: Times that a write of edges is judged against a newer version before it gives up.
ATTEMPTS = 4
MODES = ("minimize-latency", "fully-consistent", "at-least-as-fresh", "at-exact-snapshot")


@dataclass(frozen=True)
class Commit:
    """What one version is made of: whole tables are named, never listed."""

    version: int
    committed_at: float
    base: str | None
    deltas: tuple[str, ...]
    schema_text: str
    schema_version: int
    relation_versions: dict[str, int] = field(hash=False)


class Snapshot:
    """One immutable version: its schema and its edges."""

    def __init__(self, spark: SparkSession, commit: Commit):
        self.spark, self.commit, self.version = spark, commit, commit.version
        self.schema = Schema.of(commit.schema_text)

    @property
    def edges(self) -> DataFrame:
        """Edges that no later delta removes: a write adds only edges that aren't there and removes only ones that are."""
        empty = self.spark.createDataFrame([], EDGE_SCHEMA)
        base = self.spark.read.schema(EDGE_SCHEMA).parquet(self.commit.base) if self.commit.base else empty
        if not self.commit.deltas:
            return base
        changes = self.spark.read.schema(f"{EDGE_SCHEMA}, version long, added boolean").parquet(*self.commit.deltas)
        there = changes.where("added").select(*EDGE, "version")
        if self.commit.base:
            there = there.union(base.withColumn("version", F.lit(0).cast("long")))
        gone = changes.where("NOT added").select(*[F.col(c).alias(f"gone_{c}") for c in (*EDGE, "version")])
        same = reduce(Column.__and__, [F.col(c) == F.col(f"gone_{c}") for c in EDGE])
        return there.join(gone, same & (F.col("gone_version") > F.col("version")), "left_anti").select(*EDGE)

    def frontier(self, root: tuple[str, str]) -> tuple[int, int]:
        """Versions of the schema and of the newest relation that a permission reads; equal frontiers mean equal grants."""
        needed = {relation_id(r) for r in self.schema.parsed.relations if (r.resource_type, r.name) in self.schema.relation_dependencies(root)}
        return self.commit.schema_version, max((self.commit.relation_versions.get(i, 0) for i in needed), default=0)


class Store:
    """Edges and schemas below a folder that Spark reaches.

    A commit is a file named after its version, put in place by a rename that fails where
    the file is there: of two writers of one version the second fails with
    ``schema/concurrent-write``. Writes of edges are then judged anew against the new
    version, up to ATTEMPTS times. This holds for file systems whose rename is atomic
    and doesn't replace (HDFS, local ones); on an object store that copies, one writer
    at a time must be made sure of from outside.
    """

    def __init__(self, spark: SparkSession, root: str, key: bytes = b"latchwork", source: str = "default"):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source
        self.signer = Signer(key, "snapshot", seconds=24 * 3600)
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *p: path("/".join([self.root, *p]))
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: Commit | None = None
        if not self._fs.exists(self._path("commits")):
            self._fs.mkdirs(self._path("commits"))

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(self._path("commits")) if f.getPath().getName().endswith(".json"))

    def commit_of(self, version: int) -> Commit:
        if version == 0:
            return Commit(0, 0.0, None, (), "", 0, {})
        where = self._path("commits", f"{version:012d}.json")
        if not self._fs.exists(where):
            raise EngineError("consistency/exact-snapshot-unavailable", f"version {version} isn't kept", version=version)
        stream = self._fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Commit(**raw | {"deltas": tuple(raw["deltas"])})

    def current(self) -> Commit:
        versions = self.versions()
        self._known = self.commit_of(versions[-1] if versions else 0)
        return self._known

    def snapshot(self, mode: str = "minimize-latency", token: str | None = None, timeout: float = 5.0) -> Snapshot:
        """Pins a version: the last one seen here, the newest, one at least as new as the token's (waiting for it), or exactly the token's."""
        if mode not in MODES:
            raise EngineError("unsupported-consistency", f"{mode} isn't one of {MODES}", mode=mode)
        if mode in MODES[2:] and token is None:
            raise EngineError("consistency/missing-token", f"{mode} needs a token")
        if mode == "minimize-latency":
            return Snapshot(self.spark, self._known or self.current())
        if mode == "fully-consistent":
            return Snapshot(self.spark, self.current())
        wanted = self.signer.read(token, {"source": self.source})["version"]
        if mode == "at-exact-snapshot":
            return Snapshot(self.spark, self.commit_of(wanted))
        until = time.monotonic() + timeout
        while True:
            commit = self.current()
            if commit.version >= wanted:
                return Snapshot(self.spark, commit)
            if time.monotonic() >= until:
                raise EngineError("consistency/freshness-timeout", f"version {wanted} didn't come up", version=wanted)
            time.sleep(0.05)

    def token(self, version: int) -> str:
        return self.signer.issue({"version": version}, {"source": self.source})

    def token_at_least_seconds_ago(self, seconds: float) -> str:
        """Token of the first version committed within the last ``seconds``; of the current one if there is none."""
        since = time.time() - seconds
        versions = self.versions()
        young = [v for v in versions if self.commit_of(v).committed_at >= since]
        return self.token(min(young) if young else (versions[-1] if versions else 0))

    def _write(self, commit: Commit) -> Commit:
        where = self._path("commits", f"{commit.version:012d}.json")
        body = json.dumps(commit.__dict__ | {"deltas": list(commit.deltas)}).encode()
        held = self._path("commits", f".{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(body)
        out.close()
        # A rename onto a file that is there fails on HDFS; the check before it covers stores that replace.
        if self._fs.exists(where) or not self._fs.rename(held, where):
            self._fs.delete(held, False)
            raise EngineError("schema/concurrent-write", f"version {commit.version} was written by another", version=commit.version)
        self._known = commit
        return commit

    def _next(self, old: Commit, **changes) -> Commit:
        return Commit(**(old.__dict__ | {"version": old.version + 1, "committed_at": time.time()} | changes))

    # Schemas

    def write_schema(self, text: str, allow_empty: bool = False) -> dict:
        """Replaces the schema; returns additions, retractions and what stays. The same schema again writes no version."""
        old = self.current()
        new, before = Schema.of(text), Schema.of(old.schema_text)
        if not new.parsed.definitions and before.parsed.definitions and not allow_empty:
            raise EngineError("schema/empty-schema-guard", "an empty schema would remove every definition")
        delta = difference(before, new)
        gone = delta["relations"]["retractions"]
        if gone and old.version:
            used = Snapshot(self.spark, old).edges.groupBy("resource_type", "relation", "subject_type").count()
            rows = self.spark.createDataFrame([(r.resource_type, r.name, r.subject_type) for r in gone], "resource_type string, relation string, subject_type string")
            for r in used.join(F.broadcast(rows), ["resource_type", "relation", "subject_type"]).collect():  # at most the retracted relations
                raise EngineError("schema/relation-in-use", f"{r.resource_type}.{r.relation} has {r['count']} edges", count=r["count"], relation=r.relation)
        if any(delta[k][c] for k in delta for c in ("additions", "retractions")):
            self._write(self._next(old, schema_text=text, schema_version=old.version + 1))
        return delta

    # Edges

    def write_relationships(self, updates: DataFrame) -> str:
        """Applies updates (op and the edge's columns) as one version, judged against the version before; returns its token.

        create fails if the edge is there, touch adds it if it isn't, delete removes it if it is.
        The same update twice counts once; different operations on one edge are an error.
        """
        rows = updates.select(F.coalesce("op", F.lit("null")).alias("op"), *[F.col(c).cast("string").alias(c) for c in EDGE])
        for attempt in range(ATTEMPTS):
            try:
                return self.token(self._judged(rows).version)
            except EngineError as e:
                if e.code != "schema/concurrent-write" or attempt == ATTEMPTS - 1:
                    raise

    def _judged(self, rows: DataFrame) -> Commit:
        """One pass over the updates writes what they change, and those with a problem; if there are any of these, they are an error and nothing is committed.

        Updates meet each other and the edges that are there by sorts on the edge alone,
        after the shuffle, so no task gathers the rows of its input in a table of groups.
        """
        old = self.current()
        snapshot = Snapshot(self.spark, old)
        kinds = ["subject_type", "relation", "resource_type"]
        legal = [(st, rel, rt) for (rt, rel), types in snapshot.schema.relations.items() for st in types]
        named = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).eqNullSafe(v) for c, v in zip(kinds, t, strict=True)]) for t in legal], F.lit(False))
        empty = F.coalesce(F.col("subject_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("resource_id"), F.lit("")).eqNullSafe("")
        before = F.lag("op").over(Window.partitionBy(*EDGE).orderBy("op"))
        rows = rows.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("op")))  # the same update twice counts once
        if old.base or old.deltas:
            rows = rows.join(snapshot.edges.withColumn("there", F.lit(True)), list(EDGE), "left")
        else:
            rows = rows.withColumn("there", F.lit(None).cast("boolean"))
        problem = F.when(~F.col("op").isin(*OPERATIONS), "op").when(~named, "named").when(empty, "empty").when(F.col("before").isNotNull(), "batch").when((F.col("op") == "create") & F.col("there"), "clash")
        added = F.when((F.col("op") != "delete") & F.col("there").isNull(), True).when((F.col("op") == "delete") & F.col("there"), False)
        rows = rows.select("op", *EDGE, problem.alias("problem"), added.alias("added")).where("problem IS NOT NULL OR added IS NOT NULL")
        return self._apply(old, rows, snapshot.schema)

    @staticmethod
    def _refuse(wrong: DataFrame, schema: Schema) -> None:
        """Raises the first kind of problem that some updates have."""
        kinds = ["subject_type", "relation", "resource_type"]
        bad = wrong.groupBy("problem").agg(F.min("op").alias("op"), F.min(F.struct(*kinds)).alias("named"), F.min(F.struct("op", *EDGE)).alias("row")).collect()  # a row for each kind
        found = {r["problem"]: r for r in bad}
        if "op" in found:
            raise EngineError("unsupported-operation", f"{found['op']['op']} isn't one of {OPERATIONS}", operation=found["op"]["op"])
        if "named" in found:
            schema.require_relationship(*found["named"]["named"])
        if "empty" in found:
            raise EngineError("unknown-object", "an edge needs the ids of both its ends")
        if "batch" in found:
            raise EngineError("invalid-relationship-update-batch", "different operations on one edge")
        if "clash" in found:
            raise EngineError("relationship-conflict", f"{found['clash']['row'].asDict()} is there already")

    def _apply(self, old: Commit, changes: DataFrame, schema: Schema | None = None) -> Commit:
        """Commits the edges' columns and ``added`` as the next version. With a schema, rows with a ``problem`` are refused."""
        version = old.version + 1
        path = f"{self.root}/deltas/{version:012d}-{uuid.uuid4().hex}"
        judged = ("problem", "op") if schema else ()
        with ended_shuffles(self.spark):
            changes.select(*EDGE, F.lit(version).cast("long").alias("version"), "added", *judged).write.parquet(path)
        written = self.spark.read.schema(f"{EDGE_SCHEMA}, version long, added boolean, problem string, op string").parquet(path)
        if schema:
            wrong = written.where("problem IS NOT NULL")
            if not wrong.isEmpty():
                try:
                    self._refuse(wrong, schema)
                finally:
                    self._fs.delete(self._path(path.removeprefix(f"{self.root}/")), True)
        touched = written.select("resource_type", "relation", "subject_type").distinct().collect()
        if not touched:
            return old
        stamps = old.relation_versions | {f"relation:{r.resource_type}:{r.relation}:{r.subject_type}": version for r in touched}
        commit = self._next(old, deltas=(*old.deltas, path), relation_versions=stamps)
        if len(commit.deltas) >= COMPACT_AFTER:
            base = f"{self.root}/bases/{version:012d}-{uuid.uuid4().hex}"
            with ended_shuffles(self.spark):
                Snapshot(self.spark, commit).edges.orderBy("resource_type", "relation", "resource_id", "subject_id").write.parquet(base)
            commit = self._next(old, base=base, deltas=(), relation_versions=stamps)
        return self._write(commit)

    def delete_object(self, object_type: str, object_id: str) -> int:
        """Removes every edge that an object is an end of; returns twice their number, for both halves of each."""
        old = self.current()
        gone = Snapshot(self.spark, old).edges.where(
            ((F.col("subject_type") == object_type) & (F.col("subject_id") == object_id)) | ((F.col("resource_type") == object_type) & (F.col("resource_id") == object_id))
        )
        n = gone.count()
        if n:
            self._apply(old, gone.withColumn("added", F.lit(False)))
        return 2 * n
