import threading
import time

import pytest

from latchwork.client import Cancellation, Client
from latchwork.errors import EngineError
from latchwork.functions.tokens import Signer, canonical
from latchwork.operators import integrity
from latchwork.sources.store import COMPACT_AFTER, EDGE_SCHEMA, Store
from latchwork.streaming.deltas import UPDATE_SCHEMA, changed_grants, ingest

TEXT = """
definition user {}
definition platform {
  relation super_admin: user
}
definition account {
  relation platform: platform
  relation owner: user
  permission admin = owner + platform->super_admin
  permission view = admin
}
definition server {
  relation account: account
  permission view = account->view
  permission reboot = account->admin
}
definition folder {
  relation owner: user
  relation parent: folder
  permission view = owner + parent->view
}
"""
EDGES = [
    ("user", "user-1", "owner", "account", "account-1"),
    ("user", "super-user", "super_admin", "platform", "platform-1"),
    ("platform", "platform-1", "platform", "account", "account-1"),
    ("account", "account-1", "account", "server", "server-1"),
    ("account", "account-1", "account", "server", "server-2"),
]


def code(f):
    with pytest.raises(EngineError) as e:
        f()
    return e.value.code


@pytest.fixture
def client(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/store")
    c.write_schema(TEXT)
    c.create_relationships(EDGES)
    return c


def test_checks_lookups_counts_and_errors(client):
    assert client.check("user", "user-1", "view", "server", "server-1") and client.check("user", "super-user", "reboot", "server", "server-2")
    assert not client.check("user", "user-2", "view", "server", "server-1") and not client.check("user", "user-1", "view", "server", "nothing")
    assert code(lambda: client.require("user", "user-2", "view", "server", "server-1")) == "unauthorized"
    assert [r["resource_id"] for r in client.lookup_resources("user", "user-1", "view", "server").data] == ["server-1", "server-2"]
    assert [r["subject_id"] for r in client.lookup_subjects("server", "server-1", "view", "user").data] == ["super-user", "user-1"]
    assert client.count_resources("user", "user-1", "view", "server") == (2, -1, False) and client.count_resources("user", "user-1", "view", "server", 1) == (1, 1, True)
    assert client.count_subjects("server", "server-1", "reboot", "user", 0) == (0, 0, True)
    assert code(lambda: client.check("user", "u", "owner", "account", "a")) == "unknown-relation-or-permission"
    assert code(lambda: client.check("user", "u", "view", "nothing", "a")) == "unknown-definition"
    assert client.expand("server", "server-1", "reboot")["intermediate"]["operation"] == "union"
    assert code(lambda: Client(client.spark, client.store.root, nothing=1)) == "invalid-config"


def test_pages_compose(client):
    client.create_relationships([("account", "account-1", "account", "server", f"server-{i:02}") for i in range(10, 21)])
    whole = [r["resource_id"] for r in client.lookup_resources("user", "user-1", "view", "server").data]
    assert len(whole) == len(set(whole)) == 13
    got, after = [], None
    while True:
        page = client.lookup_resources("user", "user-1", "view", "server", first=4, after=after)
        assert page.has_previous == (after is not None)
        got += [r["resource_id"] for r in page.data]
        after = page.end_cursor
        if not page.has_next:
            break
    assert got == whole
    last = client.lookup_resources("user", "user-1", "view", "server", last=3)
    assert [r["resource_id"] for r in last.data] == whole[-3:] and last.has_previous and not last.has_next
    back = client.lookup_resources("user", "user-1", "view", "server", last=4, before=last.start_cursor)
    assert [r["resource_id"] for r in back.data] == whole[-7:-3]
    assert code(lambda: client.lookup_resources("user", "user-2", "view", "server", first=4, after=after)) == "cursor/scope-mismatch"
    assert code(lambda: client.lookup_resources("user", "user-1", "view", "server", first=4, after="x")) == "cursor/invalid"
    assert code(lambda: client.lookup_resources("user", "user-1", "view", "server", first=0)) == "pagination/invalid-page-size"
    assert code(lambda: client.lookup_resources("user", "user-1", "view", "server", first=1, last=1)) == "pagination/invalid-page"


def test_pages_survive_writes(client):
    client.create_relationships([("account", "account-1", "account", "server", f"server-{i:02}") for i in range(10, 16)])
    ask = lambda **page: client.lookup_resources("user", "user-1", "view", "server", **page)
    whole = [r["resource_id"] for r in ask().data]
    one = ask(first=3)
    assert one.ordinal == 1
    # A write that the permission doesn't read: the page goes on in the current version.
    client.create_relationships([("user", "x", "owner", "folder", "f")])
    two = ask(first=3, after=one.end_cursor)
    assert [r["resource_id"] for r in two.data] == whole[3:6] and two.ordinal == 4
    # One that it reads: the page goes on in the version of its cursor.
    client.create_relationships([("account", "account-1", "account", "server", "server-0")])
    client.delete_relationships([("account", "account-1", "account", "server", whole[-1])])
    assert [r["resource_id"] for r in ask(first=9, after=two.end_cursor).data] == whole[6:]
    back = ask(last=2, before=two.start_cursor)
    assert [r["resource_id"] for r in back.data] == whole[1:3] and back.ordinal == 2
    # The row at the cursor is revoked: refused.
    client.delete_relationships([("account", "account-1", "account", "server", whole[5])])
    assert code(lambda: ask(first=3, after=two.end_cursor)) == "pagination/stale-cursor"
    edges = client.read_relationships(resource_type="server", first=2)
    client.create_relationships([("user", "y", "owner", "folder", "f")])
    assert len(client.read_relationships(resource_type="server", first=9, after=edges.end_cursor).data) == 5
    client.delete_relationships([tuple(edges.data[-1].values())])
    assert code(lambda: client.read_relationships(resource_type="server", after=edges.end_cursor)) == "pagination/stale-cursor"
    assert client.schema_status()["relations"] == 6


def test_pages_follow_the_order_of_paths(client):
    ids = ["a", "a-b", "a.b", "a b", "a/b", "b"]
    client.create_relationships([("user", "p", "owner", "account", i) for i in ids] + [("account", i, "account", "server", f"s{n}") for n, i in enumerate(ids)])
    got, after = [], None
    while len(got) < 6:
        page = client.lookup_resources("user", "p", "view", "server", first=2, after=after)
        got, after = got + [r["resource_id"] for r in page.data], page.end_cursor
    assert [ids[int(s[1:])] for s in got] == sorted(ids)


def test_conflicting_writes_are_judged_again(client, monkeypatch):
    other = Store(client.spark, client.store.root)
    real, tried = client.store._write, []

    def late(commit):
        if not tried:
            tried.append(commit.version)
            other.write_relationships(client.spark.createDataFrame([("create", "user", "z", "owner", "account", "account-1")], UPDATE_SCHEMA))
        return real(commit)

    monkeypatch.setattr(client.store, "_write", late)
    client.create_relationships([("user", "w", "owner", "account", "account-1")])
    assert client.store.current().version == tried[0] + 1
    assert {r["subject_id"] for r in client.lookup_subjects("account", "account-1", "admin", "user").data} >= {"w", "z"}
    tried.clear()
    assert code(lambda: client.create_relationships([("user", "z", "owner", "account", "account-1")])) == "relationship-conflict"


def test_a_bad_update_behind_many_good_kinds(client):
    spark = client.spark
    good = spark.range(12_000).selectExpr("'touch' AS op", "'user' AS subject_type", "concat('u', id) AS subject_id", "'owner' AS relation", "'account' AS resource_type", "'a' AS resource_id")
    bad = spark.createDataFrame([("touch", "user", "u", "account", "server", "s")], UPDATE_SCHEMA)
    assert code(lambda: client.write_relationships(good.union(bad))) == "unknown-relation-or-permission"


def test_relationship_reads(client):
    page = client.read_relationships(resource_type="server", first=1)
    assert page.data[0]["resource_id"] == "server-1" and page.has_next
    assert client.read_relationships(resource_type="server", first=1, after=page.end_cursor).data[0]["resource_id"] == "server-2"
    assert client.read_relationships(subject_type="user", subject_id="nobody").data == []
    assert code(lambda: client.read_relationships(subject_id="user-1")) == "filters/missing-subject-type"
    assert code(lambda: client.read_relationships()) == "filters/missing-anchor"
    assert code(lambda: client.read_relationships(resource_prefix="x")) == "filters/unknown-filter"
    assert code(lambda: client.read_relationships(relation="nothing")) == "unknown-relation-or-permission"
    client.delete_relationships(client.read_relationships(subject_type="account"))
    assert client.read_relationships(subject_type="account").data == []


def test_write_semantics(client):
    edge = EDGES[0]
    before = client.store.current().version
    assert code(lambda: client.create_relationships([edge])) == "relationship-conflict"
    assert code(lambda: client.write_relationships([("touch", *edge), ("delete", *edge)])) == "invalid-relationship-update-batch"
    assert code(lambda: client.write_relationships([("upsert", *edge)])) == "unsupported-operation"
    assert code(lambda: client.write_relationships([("touch", "user", "", "owner", "account", "a")])) == "unknown-object"
    assert code(lambda: client.write_relationships([("touch", "user", "u", "account", "server", "s")])) == "unknown-relation-or-permission"
    client.write_relationships([("touch", *edge), ("touch", *edge)])  # nothing changes, no version
    client.write_relationships([("delete", "user", "nobody", "owner", "account", "account-9")])
    assert client.store.current().version == before
    assert client.delete_object("account", "account-1") == 8
    assert client.read_relationships(resource_type="account").data == []


def test_schema_writes(client):
    assert code(lambda: client.write_schema("")) == "schema/empty-schema-guard"
    assert code(lambda: client.write_schema(TEXT.replace("  relation account: account\n", "  relation account: account\n  relation extra: user\n").replace("relation owner: user\n  permission admin = owner + platform", "permission admin = platform"))) == "schema/relation-in-use"
    version = client.store.current().version
    client.write_schema(TEXT)
    assert client.store.current().version == version
    delta = client.write_schema(TEXT.replace("permission view = account->view", "permission view = account->view\n  permission see = view"))
    assert len(delta["permissions"]["additions"]) == 1 and not delta["relations"]["additions"]


def test_snapshots_tokens_and_compaction(client, spark):
    old = client.current_token()
    for i in range(COMPACT_AFTER + 2):
        client.create_relationships([("user", f"u{i}", "owner", "account", "account-1")])
    assert client.store.current().base is not None
    assert client.count_subjects("server", "server-1", "view", "user") == (2 + COMPACT_AFTER + 2, -1, False)
    assert client.count_subjects("server", "server-1", "view", "user", consistency="at-exact-snapshot", token=old) == (2, -1, False)
    other = Store(spark, client.store.root)
    assert other.snapshot("at-least-as-fresh", client.current_token()).version == client.store.current().version
    assert code(lambda: other.snapshot("at-least-as-fresh", other.token(10**6), timeout=0.2)) == "consistency/freshness-timeout"
    assert code(lambda: other.snapshot("at-exact-snapshot", other.token(10**6))) == "consistency/exact-snapshot-unavailable"
    assert code(lambda: other.snapshot("sometimes")) == "unsupported-consistency"
    assert code(lambda: Store(spark, client.store.root, source="b").snapshot("at-exact-snapshot", old)) == "snapshot/scope-mismatch"
    first = other.token_at_least_seconds_ago(3600)
    assert other.snapshot("at-exact-snapshot", first).version == 1
    commit = other.commit_of(3)
    assert code(lambda: other._write(commit)) == "schema/concurrent-write"


def test_cached_grants_follow_their_relations(client):
    a = client.grants("server", "view")
    client.create_relationships([("user", "x", "owner", "folder", "f")])  # not one of its relations
    assert client.grants("server", "view") is a and client.cache_stats() == {"entries": 1, "hits": 1, "misses": 1}
    client.create_relationships([("user", "x", "owner", "account", "account-1")])
    assert client.grants("server", "view").count() == a.count() + 2
    client.expire_cache()
    assert client.cache_stats()["entries"] == 0


def test_recursive_pages_are_by_id(client):
    client.create_relationships([("user", "u", "owner", "folder", "f1"), ("folder", "f1", "parent", "folder", "f2"), ("folder", "f2", "parent", "folder", "f1"), ("folder", "f2", "parent", "folder", "f0")])
    assert [r["resource_id"] for r in client.lookup_resources("user", "u", "view", "folder", first=2).data] == ["f0", "f1"]
    assert code(lambda: client.lookup_resources("user", "u", "view", "folder", last=1)) == "pagination/complete-evaluation-required"
    assert [r["resource_id"] for r in client.lookup_resources("user", "u", "view", "folder", last=1, evaluation="complete-denotation").data] == ["f2"]


def test_deadline(client):
    quick = Client(client.spark, client.store.root, timeout_ms=1)
    assert code(lambda: quick.count_resources("user", "user-1", "view", "server")) == "execution/deadline-exceeded"


def test_cancellation_by_the_caller(client, monkeypatch):
    caller = Cancellation()
    with client.cancelled_by(caller):
        assert client.count_resources("user", "user-1", "view", "server") == (2, -1, False)
        # Cancelled while a job runs: it ends and doesn't take its 60 seconds.
        threading.Timer(2, caller.cancel).start()
        began = time.monotonic()

        def slow():
            with client._limited("slow"):
                client.spark.range(1).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L + id)").collect()

        assert code(slow) == "execution/cancelled" and time.monotonic() - began < 30
        assert code(lambda: client.check("user", "user-1", "view", "server", "server-1")) == "execution/cancelled"
    assert not caller.stops and client.count_resources("user", "user-1", "view", "server") == (2, -1, False)


def test_limit_on_what_recursion_reaches(client):
    client.create_relationships([("user", "u", "owner", "folder", "f0"), *[("folder", f"f{i}", "parent", "folder", f"f{i + 1}") for i in range(9)]])
    few, enough = (Client(client.spark, client.store.root, most_grants=n) for n in (9, 10))
    assert enough.count_resources("user", "u", "view", "folder") == (10, -1, False)
    assert code(lambda: few.count_resources("user", "u", "view", "folder")) == "traversal/limit-exceeded"
    assert code(lambda: few.lookup_resources("user", "u", "view", "folder", first=2)) == "traversal/limit-exceeded"
    assert code(lambda: Client(client.spark, client.store.root, most_grants=0)) == "execution/invalid-contract"


def test_tokens():
    s = Signer(b"k", "cursor", 10)
    t = s.issue({"a": 1}, {"b": 2}, now=100)
    assert s.read(t, {"b": 2}, now=109) == {"a": 1}
    assert code(lambda: s.read(t, {"b": 2}, now=110)) == "cursor/expired"
    assert code(lambda: Signer(b"other", "cursor").read(t, {"b": 2})) == "cursor/invalid"
    assert code(lambda: s.read(t[:-2] + "xx", {"b": 2}, now=100)) == "cursor/invalid"
    assert canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'.encode()
    assert code(lambda: canonical(object())) == "format/invalid"


def test_integrity(spark):
    edges = spark.createDataFrame(EDGES, EDGE_SCHEMA)
    f, r = edges.where("resource_id <> 'server-1'"), edges.where("resource_id <> 'server-2'")
    got = integrity.report(integrity.dangling(f, r), 1)
    assert got["total"] == 2 and got["by_half"] == {"forward": 1, "reverse": 1} and len(got["sample"]) == 1
    assert integrity.repaired(f, r).count() == 3
    assert code(lambda: integrity.report(integrity.dangling(f, r), -1)) == "integrity/invalid-options"


def test_stream_of_updates(client, spark, tmp_path):
    seen = []
    rows = [("create", "user", "s1", "owner", "account", "account-1"), ("touch", "user", "s2", "owner", "account", "account-1"), ("delete", *EDGES[0])]
    spark.createDataFrame(rows, UPDATE_SCHEMA).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(UPDATE_SCHEMA).json(f"{tmp_path}/in")
    before = client.snapshot().edges
    for _ in range(2):  # the second run finds nothing new
        ingest(client.store, stream, f"{tmp_path}/checkpoint", lambda v, batch: seen.append((v, batch.count()))).awaitTermination()
    assert len(seen) == 1 and seen[0][1] == 3
    s = client.snapshot("fully-consistent")
    moved = {(r.subject_id, r.change) for r in changed_grants(s.schema, before, s.edges, "server", "view").collect()}
    assert moved == {("s1", "gained"), ("s2", "gained"), ("user-1", "lost")}
    assert time.time() > s.commit.committed_at
