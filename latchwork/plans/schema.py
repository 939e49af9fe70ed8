"""A checked schema: relations, resolved permissions, name checks and differences."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from ..errors import EngineError
from .dsl import Branch, Parsed, Relation, parse

RULE_KINDS = ("direct", "self", "arrow_relation", "arrow_permission")


@dataclass(frozen=True)
class Rule:
    """One way to a grant of (resource_type, permission); ordinal is its place in the canonical order."""

    ordinal: int
    kind: str
    resource_type: str
    permission: str
    via: str | None
    target: str


def relation_id(r: Relation) -> str:
    return f"relation:{r.resource_type}:{r.name}:{r.subject_type}"


def permission_id(b: Branch) -> str:
    return f"permission:{b.resource_type}:{b.permission}:{b.via or 'self'}:{b.target_kind}:{b.target}"


class Schema:
    """Relations and permissions by name, and the rules that make permissions.

    A definition without declarations is known only where it is a subject type.
    """

    def __init__(self, parsed: Parsed):
        self.parsed = parsed
        self.relations: dict[tuple[str, str], list[str]] = {}
        for r in parsed.relations:
            self.relations.setdefault((r.resource_type, r.name), []).append(r.subject_type)
        names = {(b.resource_type, b.permission) for b in parsed.branches}
        for r in parsed.relations:
            if r.subject_type not in parsed.definitions:
                raise EngineError("schema/invalid-reference", f"{r.resource_type}.{r.name}: {r.subject_type} isn't defined", relation=r.name, subject_type=r.subject_type)
        self.branches = [replace(b, target_kind=self._kind(b, names)) for b in parsed.branches]
        self.permissions: dict[tuple[str, str], list[Rule]] = {}
        for i, b in enumerate(sorted(self.branches, key=lambda b: (b.resource_type, b.permission, b.via or "", b.target_kind, b.target))):
            kind = {(True, "relation"): "direct", (True, "permission"): "self", (False, "relation"): "arrow_relation", (False, "permission"): "arrow_permission"}[(b.via is None, b.target_kind)]
            self.permissions.setdefault((b.resource_type, b.permission), []).append(Rule(i, kind, b.resource_type, b.permission, b.via, b.target))
        self.types = {r.subject_type for r in parsed.relations} | {r.resource_type for r in parsed.relations} | {b.resource_type for b in parsed.branches}

    @classmethod
    def of(cls, text: str) -> Schema:
        return cls(parse(text))

    def _kind(self, b: Branch, names: set) -> str:
        where = f"{b.resource_type}.{b.permission}"
        if b.via is None:
            if (b.resource_type, b.target) in self.relations:
                return "relation"
            if (b.resource_type, b.target) in names:
                return "permission"
            raise EngineError("schema/invalid-reference", f"{where}: {b.target} is neither a relation nor a permission of {b.resource_type}", permission=where, target=b.target)
        if (b.resource_type, b.via) not in self.relations:
            raise EngineError("schema/invalid-reference", f"{where}: {b.via} isn't a relation of {b.resource_type}", permission=where, target=b.via)
        kinds = set()
        for t in self.relations[(b.resource_type, b.via)]:
            kind = "relation" if (t, b.target) in self.relations else "permission" if (t, b.target) in names else None
            if kind is None:
                raise EngineError("schema/invalid-reference", f"{where}: {t} has no {b.target}", permission=where, subject_type=t, target=b.target)
            kinds.add(kind)
        if len(kinds) > 1:
            raise EngineError("schema/mixed-arrow-target", f"{where}: {b.target} is a relation of one type and a permission of another", permission=where)
        return kinds.pop()

    # Names in requests

    def require_type(self, name: str) -> None:
        if name not in self.types:
            raise EngineError("unknown-definition", f"{name} isn't defined", definition=name)

    def require_permission(self, resource_type: str, permission: str) -> None:
        self.require_type(resource_type)
        if (resource_type, permission) not in self.permissions:
            raise EngineError("unknown-relation-or-permission", f"{resource_type} has no permission {permission}", definition=resource_type, name=permission)

    def require_expandable(self, resource_type: str, name: str) -> None:
        self.require_type(resource_type)
        if (resource_type, name) not in self.permissions and (resource_type, name) not in self.relations:
            raise EngineError("unknown-relation-or-permission", f"{resource_type} has no {name}", definition=resource_type, name=name)

    def require_relationship(self, subject_type: str, relation: str, resource_type: str) -> None:
        self.require_type(subject_type)
        self.require_type(resource_type)
        if subject_type not in self.relations.get((resource_type, relation), ()):
            raise EngineError("unknown-relation-or-permission", f"{resource_type}.{relation} takes no {subject_type}", definition=resource_type, name=relation)

    # The rule graph

    def targets(self, rule: Rule) -> list[tuple[str, str]]:
        """The permissions that a rule reads."""
        if rule.kind == "self":
            return [(rule.resource_type, rule.target)]
        if rule.kind == "arrow_permission":
            return [(t, rule.target) for t in self.relations[(rule.resource_type, rule.via)]]
        return []

    def reachable(self, *roots: tuple[str, str]) -> set[tuple[str, str]]:
        seen, work = set(), list(roots)
        while work:
            node = work.pop()
            if node not in seen:
                seen.add(node)
                work += [t for r in self.permissions.get(node, ()) for t in self.targets(r)]
        return seen

    def components(self, *roots: tuple[str, str]) -> list[tuple[list[tuple[str, str]], bool]]:
        """Strongly connected permissions that the roots reach, those read first; and whether each is recursive."""
        closure = {n: self.reachable(n) for n in self.reachable(*roots)}
        out, done = [], set()
        for node in sorted(closure, key=lambda n: (len(closure[n]), n)):
            if node in done:
                continue
            group = sorted(m for m in closure[node] if node in closure[m])
            done |= set(group)
            loops = any(t in group for m in group for r in self.permissions.get(m, ()) for t in self.targets(r))
            out.append((group, loops))
        return out

    def is_recursive(self, root: tuple[str, str]) -> bool:
        return any(loops for _, loops in self.components(root))

    def subject_types(self, root: tuple[str, str]) -> set[str]:
        """Types that can hold a permission; a rule that leads to none of those asked for need not be run."""
        out: set[str] = set()
        for node in self.reachable(root):
            for rule in self.permissions.get(node, ()):
                if rule.kind == "direct":
                    out |= set(self.relations[(rule.resource_type, rule.target)])
                elif rule.kind == "arrow_relation":
                    for t in self.relations[(rule.resource_type, rule.via)]:
                        out |= set(self.relations[(t, rule.target)])
        return out

    def relation_dependencies(self, root: tuple[str, str]) -> set[tuple[str, str]]:
        """(resource_type, relation) pairs that a permission's evaluation reads."""
        out = set()
        for node in self.reachable(root):
            for rule in self.permissions.get(node, ()):
                if rule.kind == "direct":
                    out.add((rule.resource_type, rule.target))
                elif rule.via:
                    out.add((rule.resource_type, rule.via))
                    if rule.kind == "arrow_relation":
                        out |= {(t, rule.target) for t in self.relations[(rule.resource_type, rule.via)]}
        return out

    def fingerprint(self, root: tuple[str, str]) -> str:
        rules = sorted([r.ordinal, r.kind, r.resource_type, r.permission, r.via or "", r.target] for n in self.reachable(root) for r in self.permissions.get(n, ()))
        return hashlib.sha256(json.dumps([list(root), rules], sort_keys=True).encode()).hexdigest()

    def rows(self) -> tuple[list[tuple], list[tuple]]:
        """Relation and permission definitions as rows of the catalogue tables."""
        relations = [(relation_id(r), r.resource_type, r.name, r.subject_type) for r in self.parsed.relations]
        permissions = [(permission_id(b), b.resource_type, b.permission, b.via or "self", b.target_kind, b.target) for b in self.branches]
        return relations, permissions


def difference(old: Schema | None, new: Schema) -> dict[str, dict[str, set]]:
    """Additions, retractions and what stays, of relations and permissions."""
    out = {}
    for name, get in (("relations", lambda s: set(s.parsed.relations)), ("permissions", lambda s: set(s.branches))):
        before, after = get(old) if old else set(), get(new)
        out[name] = {"additions": after - before, "retractions": before - after, "unchanged": before & after}
    return out
