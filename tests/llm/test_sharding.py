import hashlib
import random
import zlib

import pytest

from latchwork.llm import sharding
from latchwork.llm.sharding import Ordered, greedy, shard_by_bytes, smallest_capacity

from .conftest import corpus


def brute(sizes, shards):
    def fits(c):
        n, a = 1, 0
        for s in sizes:
            if a + s > c:
                n, a = n + 1, 0
            a += s
        return n <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("limit", [500_000, 2])
def test_smallest_capacity(monkeypatch, limit):
    monkeypatch.setattr(sharding, "DRIVER_GROUPS", limit)
    rng = random.Random(5)
    for _ in range(60):
        groups = [(f"{k:03}", rng.choice([1, 2, 5, 30, 90])) for k in range(rng.randint(1, 40))]
        cut = sorted(rng.sample(range(len(groups) + 1), min(3, len(groups))))
        blocks = [groups[a:b] for a, b in zip([0, *cut], [*cut, len(groups)], strict=True)]
        order = Ordered([sum(s for _, s in b) for b in blocks], lambda some, blocks=blocks: {i: blocks[i] for i in some})
        shards = rng.randint(1, 6)
        capacity, cuts = smallest_capacity(order, shards, max(s for _, s in groups))
        assert capacity == brute([s for _, s in groups], shards) and len(cuts) < shards
        assert greedy(order, shards, capacity - 1) is None or capacity == max(s for _, s in groups)


def check(rows, got, shards):
    text = [(i, t or "") for i, t in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in text)
    loads = {}
    for r in got:
        loads.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in loads.values())
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    groups = {}
    for _, t in text:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
    sizes = [groups[t] for t in sorted(groups, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    assert max(sum(r.size for r in x) for x in loads.values()) == brute(sizes, shards)


def test_against_brute_force(docs_of):
    rows = corpus() + [(None, "x"), (None, "x"), (3, "x")]
    check(rows, shard_by_bytes(docs_of(rows), 16).collect(), 16)
    texts = dict(rows)
    place = {}
    for r in shard_by_bytes(docs_of(corpus()), 5).collect():
        assert place.setdefault(texts[r.doc_id] or "", r.shard) == r.shard


def test_hot_group_few_groups_and_no_rows(docs_of):
    rows = [(i, "same text") for i in range(40)] + [(100 + i, f"text {i}") for i in range(20)]
    check(rows, shard_by_bytes(docs_of(rows), 4).collect(), 4)
    check(rows[:2], shard_by_bytes(docs_of(rows[:2]), 4).collect(), 4)
    assert shard_by_bytes(docs_of(rows).where("false"), 4).count() == 0


@pytest.mark.parametrize("limit", [500_000, 2])
def test_hot_groups_leave_no_shard_empty(monkeypatch, limit):
    monkeypatch.setattr(sharding, "DRIVER_GROUPS", limit)
    rng = random.Random(7)
    for hot in ([300], [700], [501], [0], [999], [200, 201, 640], list(range(30, 990, 64))[:9]):
        groups = [(f"{k:04}", rng.randint(50, 150)) for k in range(1000)]
        rest = sum(s for k, (_, s) in enumerate(groups) if k not in hot)
        for k in hot:  # together a third, or nine of a sixteenth and more each
            groups[k] = (groups[k][0], rest // 2 // len(hot) if len(hot) < 9 else rest // 4)
        blocks = [groups[b : b + 50] for b in range(0, 1000, 50)]
        order = Ordered([sum(s for _, s in b) for b in blocks], lambda some, blocks=blocks: {i: blocks[i] for i in some})
        largest = max(s for _, s in groups)
        capacity, cuts = smallest_capacity(order, 16, largest)
        loads, names = [0] * 16, [[] for _ in range(16)]
        for k, (digest, size) in enumerate(groups):
            i = sum(digest >= c for c in cuts)
            loads[i] += size
            names[i].append(k)
        assert capacity == max(loads) == brute([s for _, s in groups], 16)
        assert min(loads) > 0
        if len(hot) == 1:
            others = [x for x, n in zip(loads, names, strict=True) if n != hot]
            even = rest / 15
            assert len(others) == 15 and max(others) < 1.2 * even and min(others) > 0.7 * even


def test_hot_group_of_a_third(docs_of):
    rows = [(i, "the same text") for i in range(200)] + [(1000 + i, f"text number {i}") for i in range(400)]
    got = shard_by_bytes(docs_of(rows), 16).collect()
    check(rows, got, 16)
    loads, hot = {}, {r.shard for r in got if r.doc_id < 1000}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(loads) == 16 and len(hot) == 1 and loads[min(hot)] == 200 * 14
    others = [n for s, n in loads.items() if s not in hot]
    assert max(others) < 1.3 * sum(others) / 15 and min(others) > 0.6 * sum(others) / 15
