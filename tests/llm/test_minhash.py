import random

import pytest

from latchwork.errors import EngineError
from latchwork.llm import minhash
from latchwork.llm.minhash import components, near_duplicates

from .conftest import corpus


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(least.get(root(a), i), i)
    return sorted((i, len(s), least[root(a)], i == least[root(a)]) for a, (i, s) in enumerate(sets))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(docs_of, k):
    rows = corpus(2, 80)
    assert found(near_duplicates(docs_of(rows), words=k)) == brute(rows, k)


@pytest.mark.parametrize("chunk", [400_000, 2_000])
def test_large_group_around_one_source_in_parts(docs_of, monkeypatch, chunk):
    """Near copies of one source that mostly don't link with each other, copies of copies, and texts that share half."""
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", chunk)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    source = [word() for _ in range(120)]

    def changed(w, n):
        w = list(w)
        for p in rng.sample(range(len(w)), n):
            w[p] = word()
        return w

    rows = [(500, " ".join(source))]
    near = [changed(source, rng.choice([1, 2, 3, 4])) for _ in range(80)]
    rows += [(i, " ".join(w)) for i, w in enumerate(near)]
    rows += [(600 + i, " ".join(changed(near[i], 3))) for i in range(30)]
    rows += [(700 + i, " ".join(source[:70] + [word() for _ in range(50)])) for i in range(40)]
    assert found(near_duplicates(docs_of(rows), words=4)) == brute(rows, 4)


def test_null_ids_repeats_and_empty(docs_of):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (4, "z y"), (4, "z y"), (5, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_of(rows), words=4).collect())
    assert got == [("3", 3, None, False), ("4", 1, 4, True), ("4", 1, 4, True), ("5", 0, 5, True), ("None", 3, None, True)]
    assert near_duplicates(docs_of(rows).where("false")).count() == 0


def test_rows_that_share_an_id(docs_of):
    words = [f"w{k}" for k in range(40)]
    rows = [(4, None), (4, " ".join(words)), (9, None), (9, " ".join([*words[:39], "x"])), (9, ""), (12, "other words stand here alone")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), words=4).collect()}
    assert got == {(4, 0, 4), (4, 37, 4), (9, 0, 9), (9, 37, 4), (12, 2, 12)}


def test_components_of_long_chains(spark):
    rng = random.Random(7)
    order = list(range(200))
    rng.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(199) if i not in (50, 120)] + [(order[0], order[0])]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for part in (order[:51], order[51:121], order[121:]):
        assert {got.get(i, i) for i in part} == {min(part)} and min(part) not in got


def test_unsettled_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(EngineError, match="traversal/limit-exceeded"):
        components(chain, most_rounds=2)
    assert {r.component for r in components(chain).collect()} == {0}
