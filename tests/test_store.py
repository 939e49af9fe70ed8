from latchwork.operators.grants import EDGE
from latchwork.sources.store import Store

SCHEMA = "definition user {}\ndefinition doc {\n  relation owner: user\n}\n"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_writes_and_reads_build_no_groups_of_edges(spark, tmp_path, monkeypatch):
    store, seen = Store(spark, f"file://{tmp_path}/store"), []
    store.write_schema(SCHEMA)
    real = Store._apply
    monkeypatch.setattr(Store, "_apply", lambda self, old, changes, *more: (seen.append(changes), real(self, old, changes, *more))[1])

    def write(*updates):
        rows = [(op, "user", who, "owner", "doc", what) for op, who, what in updates]
        return store.write_relationships(spark.createDataFrame(rows, "op string, " + ", ".join(f"{c} string" for c in EDGE)))

    def held(token):
        edges = store.snapshot("at-exact-snapshot", token).edges
        assert "Aggregate" not in plan(edges)
        return sorted((r.subject_id, r.resource_id) for r in edges.collect())

    first = write(("create", "ann", "1"), ("create", "ann", "1"), ("touch", "bob", "1"), ("delete", "cy", "1"))
    second = write(("delete", "ann", "1"), ("touch", "bob", "1"))
    third = write(("create", "ann", "1"), ("delete", "bob", "1"))
    assert held(first) == [("ann", "1"), ("bob", "1")] and held(second) == [("bob", "1")] and held(third) == [("ann", "1")]
    assert len(seen) == 3 and not any("Aggregate" in plan(changes) for changes in seen)
    write(("touch", "ann", "1"))
    assert store.current().version == 4  # a write that changes nothing is no version
