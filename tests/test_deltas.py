from latchwork.operators import grants
from latchwork.operators.grants import Evaluation
from latchwork.plans.schema import Schema
from latchwork.streaming import deltas

from .naive import grants as naive

COLUMNS = "subject_type string, subject_id string, relation string, resource_type string, resource_id string"
SCHEMA = "definition user {}\ndefinition org {\n relation admin: user\n permission manage = admin\n}\ndefinition doc {\n relation org: org\n relation owner: user\n permission view = owner + org->manage\n}\n"


def test_changed_grants_read_edges_once_and_carry_no_resource_down(spark, monkeypatch):
    schema = Schema.of(SCHEMA)
    old = [("user", "ann", "admin", "org", "o"), ("org", "o", "org", "doc", "1"), ("org", "o", "org", "doc", "2"), ("user", "bob", "owner", "doc", "2"), ("user", "bob", "owner", "doc", "2")]
    new = [e for e in old if e[4] != "2"] + [("org", "o", "org", "doc", "3"), ("user", "bob", "owner", "doc", "3"), ("user", "cy", "owner", "doc", "1")]
    tables, real = [], deltas.settle
    monkeypatch.setattr(deltas, "settle", lambda df, name: (tables.append((name, out := real(df, name))), out)[1])
    monkeypatch.setattr(Evaluation, "_ends", lambda *a: 1 / 0)
    got = {tuple(r) for r in deltas.changed_grants(schema, spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS), "doc", "view").collect()}
    held = [{(r, st, s) for t, p, r, st, s in naive(schema, edges) if (t, p) == ("doc", "view")} for edges in (old, new)]
    assert got == {(*g, "gained") for g in held[1] - held[0]} | {(*g, "lost") for g in held[0] - held[1]}
    both = dict(tables)["compared"][0]
    assert both.count() == len(set(old) | set(new)) and grants.EDGE == tuple(both.columns[:5])
