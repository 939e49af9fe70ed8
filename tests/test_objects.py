import pytest

from latchwork.errors import EngineError
from latchwork.operators import access, objects
from latchwork.operators.grants import Evaluation

from .test_grants import COLUMNS, FOLDERS, random_case, table
from latchwork.plans.schema import Schema

EDGES = [("user", "u", "owner", "doc", "d1"), ("user", "v", "owner", "doc", "d2"), ("doc", "d1", "parent", "doc", "d2")]


def test_dictionary_encode_decode(spark):
    edges = spark.createDataFrame(EDGES, COLUMNS)
    first = objects.dictionary(edges, rows_a_part=2).persist()
    ids = {(r.type, r.id): r.eid for r in first.collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4]
    more = objects.dictionary(edges.union(spark.createDataFrame([("user", "w", "owner", "doc", "d3")], COLUMNS)), first)
    again = {(r.type, r.id): r.eid for r in more.collect()}
    assert again.items() >= ids.items() and sorted(again.values()) == [1, 2, 3, 4, 5, 6]
    coded = objects.encode(edges, first)
    assert coded.count() == 3
    back = objects.decode(coded.where("subject_type = 'user'"), first, "subject_id", "user")
    assert {r.subject_id for r in back.collect()} == {"u", "v"}
    unknown = spark.createDataFrame([(99,)], "subject_id long")
    assert objects.decode(unknown, first, "subject_id", "user", required=False).first().subject_id is None
    with pytest.raises(EngineError):
        objects.decode(unknown, first, "subject_id", "user")


def test_retraction_takes_components(spark):
    edges = spark.createDataFrame(EDGES, COLUMNS)
    parts = spark.createDataFrame([("doc", "d1", "page", "p1"), ("page", "p1", "doc", "d2"), ("doc", "d2", "doc", "d1")], "owner_type string, owner_id string, type string, id string")
    roots = spark.createDataFrame([("doc", "d1")], "type string, id string")
    closure = {(r.type, r.id) for r in objects.component_closure(parts, roots).collect()}
    assert closure == {("doc", "d1"), ("page", "p1"), ("doc", "d2")}
    kept, left, touched = objects.retract(edges, objects.dictionary(edges), parts, roots)
    assert kept.count() == 0 and {r.id for r in left.collect()} == {"u", "v"} and touched.count() == 2


def test_migration(spark):
    edges = spark.createDataFrame(EDGES + EDGES[:1], COLUMNS)
    forward, reverse = objects.to_halves(edges)
    assert objects.migration_gaps(edges, forward, reverse).count() == 0
    assert [r.half for r in objects.migration_gaps(edges, forward, reverse.where("resource_id = 'd1'")).distinct().collect()] == ["reverse", "reverse"]


@pytest.mark.parametrize("seed", range(4))
def test_demand_gives_what_all_grants_give(spark, seed):
    schema, edges = random_case(seed + 20)
    if not edges:
        return
    df = table(spark, edges)
    for rt, p in sorted(schema.permissions):
        wanted = spark.createDataFrame([(f"{rt}0",), (f"{rt}2",), (f"{rt}2",), ("nothing",)], "resource_id string")
        whole = {tuple(r) for r in Evaluation(schema, df).grants(rt, p).where("resource_id LIKE '%0' OR resource_id LIKE '%2'").collect()}
        assert {tuple(r) for r in Evaluation(schema, df).demanded(rt, p, wanted).collect()} == whole


def test_demand_in_a_cycle(spark):
    schema = Schema.of(FOLDERS)
    edges = [("user", "u", "owner", "folder", "a"), ("user", "w", "owner", "folder", "z")] + [("folder", x, "parent", "folder", y) for x, y in ("ab", "bc", "ca", "zy")]
    one = spark.createDataFrame([("c",)], "resource_id string")
    assert [tuple(r) for r in access.lookup_subjects(schema, table(spark, edges), "folder", "view", "user", one).collect()] == [("c", "u")]
