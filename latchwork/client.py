"""The engine's public API: one client over a store, pinned snapshots, pages, limits on time."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions.tokens import Signer
from .operators import access, expand, integrity, paging, relationships
from .operators.grants import EDGE, Evaluation
from .sources.store import EDGE_SCHEMA, Snapshot, Store
from .sources.tables import discard, settle

OPTIONS = {"key": b"latchwork", "source": "default", "timeout_ms": 30_000, "cursor_seconds": 3600, "cached_permissions": 32, "most_grants": None}
LONGEST_MS = 3_600_000


class Cancellation:
    """A caller's means to stop reads: ``cancel`` ends the jobs of those that run under it and refuses those that start later."""

    def __init__(self):
        self.cancelled = threading.Event()
        self.stops: set[Callable[[], None]] = set()
        self.lock = threading.Lock()

    def cancel(self) -> None:
        with self.lock:
            self.cancelled.set()
            stops = list(self.stops)
        for stop in stops:
            stop()


class Client:
    """Checks, enumerations, counts, expansions, reads and writes.

    Reads take ``consistency`` (see ``Store.snapshot``) and ``token``; each is answered
    from one version. Options that aren't known are refused. ``most_grants`` limits what a
    recursive permission may reach before it is an error; None sets no limit.
    """

    def __init__(self, spark: SparkSession, root: str, **options):
        unknown = set(options) - set(OPTIONS)
        if unknown:
            raise EngineError("invalid-config", f"unknown options {sorted(unknown)}", options=sorted(unknown))
        self.options = OPTIONS | options
        if not 1 <= self.options["timeout_ms"] <= LONGEST_MS:
            raise EngineError("execution/invalid-contract", f"timeout_ms is 1 to {LONGEST_MS}")
        self.spark, self.store = spark, Store(spark, root, self.options["key"], self.options["source"])
        if self.options["most_grants"] is not None and self.options["most_grants"] < 1:
            raise EngineError("execution/invalid-contract", "most_grants is at least 1")
        self.signer = Signer(self.options["key"], "cursor", self.options["cursor_seconds"])
        self._callers = threading.local()
        self._grants: dict[tuple, tuple[DataFrame, str]] = {}
        self.hits = self.misses = 0

    @contextmanager
    def cancelled_by(self, caller: Cancellation):
        """Reads of this thread inside the block end with an error once ``caller`` is cancelled."""
        before = getattr(self._callers, "now", None)
        self._callers.now = caller
        try:
            yield
        finally:
            self._callers.now = before

    @contextmanager
    def _limited(self, what: str):
        """Cancels the jobs that the block starts once its time is up or its caller has cancelled."""
        tag, over = f"latchwork-{uuid.uuid4().hex}", threading.Event()
        caller = getattr(self._callers, "now", None)

        def end() -> None:
            self.spark.sparkContext.cancelJobsWithTag(tag)

        def late() -> None:
            over.set()
            end()

        def cause() -> EngineError | None:
            if caller is not None and caller.cancelled.is_set():
                return EngineError("execution/cancelled", f"{what} was cancelled")
            return EngineError("execution/deadline-exceeded", f"{what} took more than {self.options['timeout_ms']} ms") if over.is_set() else None

        timer = threading.Timer(self.options["timeout_ms"] / 1000, late)
        self.spark.sparkContext.addJobTag(tag)
        if caller is not None:
            with caller.lock:
                caller.stops.add(end)
        timer.start()
        try:
            if caller is not None and caller.cancelled.is_set():
                raise cause()
            yield
            if (error := cause()) is not None:  # between two jobs
                raise error
        except Exception as e:
            error = cause()
            if error is not None and getattr(e, "code", None) != error.code:
                raise error from e
            raise
        finally:
            timer.cancel()
            if caller is not None:
                with caller.lock:
                    caller.stops.discard(end)
            self.spark.sparkContext.removeJobTag(tag)

    def snapshot(self, consistency: str = "minimize-latency", token: str | None = None) -> Snapshot:
        return self.store.snapshot(consistency, token, self.options["timeout_ms"] / 1000)

    # Permissions

    def check(self, subject_type: str, subject_id: str, permission: str, resource_type: str, resource_id: str, **consistency) -> bool:
        one = self.spark.createDataFrame([(subject_id, resource_id)], "subject_id string, resource_id string")
        with self._limited("check"):
            return self.check_many(one, subject_type, permission, resource_type, **consistency).first().allowed

    def check_many(self, demands: DataFrame, subject_type: str, permission: str, resource_type: str, **consistency) -> DataFrame:
        s = self.snapshot(**consistency)
        return access.check(s.schema, s.edges, demands, resource_type, permission, subject_type, self.options["most_grants"])

    def require(self, subject_type: str, subject_id: str, permission: str, resource_type: str, resource_id: str, **consistency) -> None:
        if not self.check(subject_type, subject_id, permission, resource_type, resource_id, **consistency):
            raise EngineError("unauthorized", f"{subject_type}:{subject_id} doesn't hold {permission} on {resource_type}:{resource_id}")

    def lookup_resources(self, subject_type: str, subject_id: str, permission: str, resource_type: str, consistency="minimize-latency", token=None, evaluation=None, **page) -> paging.Page:
        scope = {"op": "resources", "of": [subject_type, subject_id, permission, resource_type]}
        proof = lambda s: s.frontier((resource_type, permission))

        def holds(s: Snapshot, row: dict) -> bool:
            one = self.spark.createDataFrame([(subject_id, row["resource_id"])], "subject_id string, resource_id string")
            return access.check(s.schema, s.edges, one, resource_type, permission, subject_type, self.options["most_grants"]).first().allowed

        with self._limited("lookup_resources"):
            s, held = self._paged(scope, page, consistency, token, proof, holds)
            return paging.resources_page(s.schema, s.edges, resource_type, permission, subject_type, subject_id, self.signer, scope, evaluation, self.options["most_grants"], held=held, **page)

    def lookup_subjects(self, resource_type: str, resource_id: str, permission: str, subject_type: str, consistency="minimize-latency", token=None, **page) -> paging.Page:
        scope = {"op": "subjects", "of": [resource_type, resource_id, permission, subject_type]}
        proof = lambda s: s.frontier((resource_type, permission))

        def holds(s: Snapshot, row: dict) -> bool:
            one = self.spark.createDataFrame([(row["subject_id"], resource_id)], "subject_id string, resource_id string")
            return access.check(s.schema, s.edges, one, resource_type, permission, subject_type, self.options["most_grants"]).first().allowed

        with self._limited("lookup_subjects"):
            s, held = self._paged(scope, page, consistency, token, proof, holds)
            one = self.spark.createDataFrame([(resource_id,)], "resource_id string")
            rows = access.lookup_subjects(s.schema, s.edges, resource_type, permission, subject_type, one, self.options["most_grants"])
            return paging.assemble(rows, ("subject_id",), self.signer, scope, ("subject_id",), held=held, **page)

    def _paged(self, scope: dict, page: dict, consistency: str, token: str | None, proof: Callable[[Snapshot], tuple], holds: Callable[[Snapshot, dict], bool]) -> tuple[Snapshot, dict]:
        """The snapshot that a page is read from, and what its cursors say of it.

        A page after a cursor stays on the current version if nothing that the answer
        depends on has changed since (``proof``), and goes on in the cursor's own version
        otherwise. It is refused if that version is gone, or if the row at which the
        cursor stands isn't an answer any more now (``holds``).
        """
        unknown = set(page) - {"first", "after", "last", "before"}
        if unknown:
            raise EngineError("invalid-request", f"unknown keys {sorted(unknown)}")
        s = self.snapshot(consistency, token)
        cursor = page.get("after") if page.get("after") is not None else page.get("before")
        if cursor is not None:
            told = self.signer.read(cursor, scope)
            if told["proof"] != list(proof(s)):
                if not holds(s, told["row"]):
                    raise EngineError("pagination/stale-cursor", "the row at the cursor isn't an answer any more", reason="boundary-revoked")
                try:
                    s = Snapshot(self.spark, self.store.commit_of(told["version"]))
                except EngineError as e:
                    raise EngineError("pagination/stale-cursor", f"version {told['version']} isn't kept any more", reason="version-gone") from e
        return s, {"version": s.version, "proof": list(proof(s))}

    def count_resources(self, subject_type: str, subject_id: str, permission: str, resource_type: str, limit: int | None = None, **consistency) -> tuple[int, int, bool]:
        s = self.snapshot(**consistency)
        one = self.spark.createDataFrame([(subject_id,)], "subject_id string")
        with self._limited("count_resources"):
            return access.count_one(access.lookup_resources(s.schema, s.edges, resource_type, permission, subject_type, one, self.options["most_grants"]), limit)

    def count_subjects(self, resource_type: str, resource_id: str, permission: str, subject_type: str, limit: int | None = None, **consistency) -> tuple[int, int, bool]:
        s = self.snapshot(**consistency)
        one = self.spark.createDataFrame([(resource_id,)], "resource_id string")
        with self._limited("count_subjects"):
            return access.count_one(access.lookup_subjects(s.schema, s.edges, resource_type, permission, subject_type, one, self.options["most_grants"]), limit)

    def expand(self, resource_type: str, resource_id: str, name: str, **consistency) -> dict:
        s = self.snapshot(**consistency)
        root = self.spark.createDataFrame([(resource_id,)], "resource_id string")
        with self._limited("expand"):
            return expand.as_tree(*expand.expand(s.schema, s.edges, resource_type, name, root))

    def grants(self, resource_type: str, permission: str, **consistency) -> DataFrame:
        """All grants of a permission, kept as a table for as long as nothing that it depends on changes."""
        s = self.snapshot(**consistency)
        s.schema.require_permission(resource_type, permission)
        root = (resource_type, permission)
        key = (s.schema.fingerprint(root), *s.frontier(root))
        if key in self._grants:
            self.hits += 1
            self._grants[key] = self._grants.pop(key)  # most recent last
            return self._grants[key][0]
        self.misses += 1
        self._grants[key] = settle(Evaluation(s.schema, s.edges, most_rows=self.options["most_grants"]).grants(*root), "grants")
        if len(self._grants) > self.options["cached_permissions"]:
            discard(self.spark, self._grants.pop(next(iter(self._grants)))[1])
        return self._grants[key][0]

    def expire_cache(self) -> None:
        discard(self.spark, *[path for _, path in self._grants.values()])
        self._grants.clear()

    def cache_stats(self) -> dict[str, int]:
        return {"entries": len(self._grants), "hits": self.hits, "misses": self.misses}

    # Edges and schemas

    def read_relationships(self, consistency="minimize-latency", token=None, first=None, after=None, last=None, before=None, **filters) -> paging.Page:
        page = {"first": first, "after": after, "last": last, "before": before}
        scope = {"op": "relationships", "of": filters}

        def holds(s: Snapshot, row: dict) -> bool:
            here = s.edges
            for c in EDGE:
                here = here.where(F.col(c) == row[c])
            return not here.isEmpty()

        with self._limited("read_relationships"):
            s, held = self._paged(scope, page, consistency, token, lambda s: (s.version,), holds)
            rows = relationships.read(s.schema, s.edges, **filters)
            return paging.assemble(rows, ("spec", "major", "minor"), self.signer, scope, EDGE, held=held, **page)

    def write_relationships(self, updates: DataFrame | list[tuple]) -> str:
        """Updates as rows of (op, subject_type, subject_id, relation, resource_type, resource_id)."""
        if isinstance(updates, list):
            updates = self.spark.createDataFrame(updates, f"op string, {EDGE_SCHEMA}")
        return self.store.write_relationships(updates)

    def create_relationships(self, edges: list[tuple]) -> str:
        return self.write_relationships([("create", *e) for e in edges])

    def delete_relationships(self, edges: list[tuple] | paging.Page) -> str:
        rows = [tuple(r[c] for c in EDGE) for r in edges.data] if isinstance(edges, paging.Page) else edges
        return self.write_relationships([("delete", *e) for e in rows])

    def delete_object(self, object_type: str, object_id: str) -> int:
        return self.store.delete_object(object_type, object_id)

    def write_schema(self, text: str, allow_empty: bool = False) -> dict:
        return self.store.write_schema(text, allow_empty)

    def read_schema(self, **consistency) -> tuple[list[tuple], list[tuple]]:
        return self.snapshot(**consistency).schema.rows()

    def schema_status(self, **consistency) -> dict:
        """Version, digest and size of the schema that reads use, and whether the store has a newer one."""
        s = self.snapshot(**consistency)
        relations, permissions = s.schema.rows()
        text = hashlib.sha256(s.commit.schema_text.encode()).hexdigest()
        newest = self.store.commit_of(max(self.store.versions(), default=0)).schema_version
        return {"schema_version": s.commit.schema_version, "sha256": text, "relations": len(relations), "permissions": len(permissions), "current": newest == s.commit.schema_version}

    def current_token(self) -> str:
        return self.store.token(self.store.current().version)

    def relation_counts(self, **consistency) -> DataFrame:
        edges = self.snapshot(**consistency).edges
        return integrity.relation_counts(edges, edges).where(F.col("n") > 0)
