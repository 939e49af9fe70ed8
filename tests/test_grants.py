import random

import pytest

from latchwork.errors import EngineError
from latchwork.operators import access, expand
from latchwork.operators.grants import Evaluation
from latchwork.plans.schema import Schema

from .naive import grants as naive

COLUMNS = "subject_type string, subject_id string, relation string, resource_type string, resource_id string"
FOLDERS = "definition user {}\ndefinition folder {\n relation owner: user\n relation parent: folder\n permission view = owner + parent->view\n permission edit = owner + parent->share\n permission share = edit + parent->view\n}\n"


def table(spark, edges):
    return spark.createDataFrame(edges, COLUMNS)


def held(df):
    return {tuple(r) for r in df.collect()}


def expected(schema, edges, rt, p):
    return {(r, st, s) for t, q, r, st, s in naive(schema, edges) if (t, q) == (rt, p)}


def random_case(seed):
    """Three types with random relations and permissions over them, and random edges."""
    rng = random.Random(seed)
    types = ["a", "b", "c"]
    text = "definition user {}\n"
    for t in types:
        text += f"definition {t} {{\n relation own: user\n relation up: {rng.choice(types)}\n relation side: {rng.choice(types)}\n"
        for p in ("p", "q"):
            parts = rng.sample(["own", "up->p", "side->q", "up->own", "side->own", "q" if p == "p" else "own"], rng.randint(1, 3))
            text += f" permission {p} = {' + '.join(parts)}\n"
        text += "}\n"
    schema = Schema.of(text)
    edges = set()
    for (t, rel), subjects in schema.relations.items():
        for _ in range(rng.randint(0, 6)):
            edges.add((subjects[0], f"{subjects[0]}{rng.randint(0, 3)}", rel, t, f"{t}{rng.randint(0, 3)}"))
    return schema, sorted(edges)


@pytest.mark.parametrize("seed", range(6))
def test_random_schemas_against_naive_evaluation(spark, seed):
    schema, edges = random_case(seed)
    if not edges:
        return
    df = table(spark, edges)
    for rt, p in sorted(schema.permissions):
        assert held(Evaluation(schema, df).grants(rt, p)) == expected(schema, edges, rt, p)


def test_long_chain_cycle_and_mutual_recursion(spark):
    schema = Schema.of(FOLDERS)
    edges = [("user", "u", "owner", "folder", "f0"), ("user", "m", "owner", "folder", "f60")] + [("folder", f"f{i}", "parent", "folder", f"f{i + 1}") for i in range(150)]
    run = Evaluation(schema, table(spark, edges))
    assert held(run.grants("folder", "view")) == expected(schema, edges, "folder", "view")
    assert run.rounds < 12  # path lengths double
    edges.append(("folder", "f150", "parent", "folder", "f0"))
    for p in ("view", "edit", "share"):
        assert held(Evaluation(schema, table(spark, edges)).grants("folder", p)) == expected(schema, edges, "folder", p)


def test_dense_graph_leaves_doubling(spark):
    schema = Schema.of(FOLDERS)
    edges = [("user", "u", "owner", "folder", "f0")] + [("folder", f"f{i}", "parent", "folder", f"f{j}") for i in range(30) for j in (i + 1, (i * 7) % 30, (i * 11 + 3) % 30) if j != i]
    edges = sorted(set(edges))
    assert held(Evaluation(schema, table(spark, edges)).grants("folder", "view")) == expected(schema, edges, "folder", "view")


def test_check_lookup_count(spark):
    schema = Schema.of(FOLDERS)
    df = table(spark, [("user", "u", "owner", "folder", "f0"), ("folder", "f0", "parent", "folder", "f1"), ("user", "v", "owner", "folder", "f9")])
    demands = spark.createDataFrame([("u", "f1"), ("u", "f9"), ("nobody", "f1"), ("u", "f1"), (None, "f1")], "subject_id string, resource_id string")
    got = sorted((str(r.subject_id), r.resource_id, r.allowed) for r in access.check(schema, df, demands, "folder", "view", "user").collect())
    assert got == sorted([("u", "f1", True), ("u", "f1", True), ("u", "f9", False), ("nobody", "f1", False), ("None", "f1", False)])
    pairs = access.lookup_resources(schema, df, "folder", "view", "user")
    assert access.count_one(pairs) == (3, -1, False) and access.count_one(pairs, 2) == (2, 2, True) and access.count_one(pairs, 0) == (0, 0, True)
    assert {(r.subject_id, r["count"], r.truncated) for r in access.count_by(pairs, "subject_id", 1).collect()} == {("u", 1, True), ("v", 1, False)}
    for bad in (lambda: access.count_one(pairs, -1), lambda: access.lookup_resources(schema, df, "folder", "owner", "user"), lambda: access.lookup_subjects(schema, df, "nothing", "view", "user")):
        with pytest.raises(EngineError):
            bad()
    none = table(spark, [("user", "x", "owner", "folder", "f")]).where("false")
    assert access.lookup_subjects(schema, none, "folder", "view", "user").isEmpty()
    assert Evaluation(schema, df).grants("folder", "unknown").isEmpty()


def test_expansion(spark):
    schema = Schema.of("definition user {}\ndefinition folder {\n relation viewer: user\n}\ndefinition doc {\n relation folder: folder\n permission view = folder->viewer\n}\n")
    df = table(spark, [("user", "tom", "viewer", "folder", "1"), ("user", "fred", "viewer", "folder", "1"), ("user", "sarah", "viewer", "folder", "2"), ("folder", "1", "folder", "doc", "d"), ("folder", "2", "folder", "doc", "d")])
    root = spark.createDataFrame([("d",)], "resource_id string")
    tree = expand.as_tree(*expand.expand(schema, df, "doc", "view", root))
    leaves = tree["intermediate"]["children"]
    assert [(n["object"]["id"], [s["id"] for s in n["leaf"]["subjects"]]) for n in leaves] == [("1", ["fred", "tom"]), ("2", ["sarah"])]
    cyclic = Schema.of(FOLDERS)
    loop = table(spark, [("folder", "a", "parent", "folder", "b"), ("folder", "b", "parent", "folder", "a")])
    with pytest.raises(EngineError) as e:
        expand.expand(cyclic, loop, "folder", "view", spark.createDataFrame([("a",)], "resource_id string"))
    assert e.value.code == "permission-tree/cycle-detected"


def test_leaves_count_into_the_limit_of_a_tree(spark, monkeypatch):
    schema = Schema.of("definition user {}\ndefinition doc {\n relation owner: user\n permission view = owner\n}\n")
    df = table(spark, [("user", f"u{i}", "owner", "doc", "d") for i in range(8)])
    nodes, leaves = expand.expand(schema, df, "doc", "view", spark.createDataFrame([("d",)], "resource_id string"))
    monkeypatch.setattr(expand, "MOST_NODES", 9)
    with pytest.raises(EngineError, match="permission-tree/limit-exceeded"):
        expand.as_tree(nodes, leaves)
    assert leaves.count() == 8
    monkeypatch.setattr(expand, "MOST_NODES", 10)
    assert len(expand.as_tree(nodes, leaves)["intermediate"]["children"][0]["leaf"]["subjects"]) == 8
