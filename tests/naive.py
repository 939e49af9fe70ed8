"""Independent evaluation of small schemas: all grants, by applying every rule until nothing changes."""


def grants(schema, edges):
    """{(resource_type, permission, resource_id, subject_type, subject_id)} from edge tuples (subject_type, subject_id, relation, resource_type, resource_id)."""
    held = set()
    while True:
        new = set()
        for b in schema.branches:
            for st, s, rel, rt, r in edges:
                if rt != b.resource_type:
                    continue
                if b.via is None and b.target_kind == "relation" and rel == b.target:
                    new.add((rt, b.permission, r, st, s))
                elif b.via == rel and b.target_kind == "relation":
                    new |= {(rt, b.permission, r, st2, s2) for st2, s2, rel2, rt2, r2 in edges if (rt2, r2, rel2) == (st, s, b.target)}
                elif b.via == rel:
                    new |= {(rt, b.permission, r, st2, s2) for t, p, o, st2, s2 in held if (t, p, o) == (st, b.target, s)}
            if b.via is None and b.target_kind == "permission":
                new |= {(t, b.permission, o, st, s) for t, p, o, st, s in held if (t, p) == (b.resource_type, b.target)}
        if new <= held:
            return held
        held |= new
