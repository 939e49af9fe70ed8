import random
import re

import pytest

from latchwork.llm import decontam
from latchwork.llm.decontam import find_overlaps, keep_clean

from .conftest import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    out = []
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(item or "")
        out.append((str(i), len(w), sorted(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("limits", [(500_000, 1_000_000), (0, 0)])
def test_against_brute_force(spark, docs_of, monkeypatch, limits):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", limits[1])
    rng = random.Random(4)
    rows = corpus()
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = []
    for k in range(25):
        w = rng.choice(texts).split()
        a = rng.randrange(len(w) - 12)
        items.append((f"i{k}", " ".join(w[a : a + rng.choice([3, 5, 9, 10, 11, 12])]).upper()))
    items += [("none", None), ("empty", ""), ("marks", "!!"), (None, "one"), ("run", "changed"), ("i1", items[0][1]), ("long", " ".join(texts[0].split()[:25]))]
    rows += [(None, items[0][1]), (7, "Ünï-codé " * 12), (7, "Ünï-codé " * 12), (8, "\0a\0b")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, words int")
    found = find_overlaps(docs_of(rows), bench).collect()
    assert sorted((str(r.doc_id), len(r.words), sorted(r.hit), list(r.items)) for r in found) == brute(rows, items)
    clean = [r for r in brute(rows, items) if not r[2]]
    kept = keep_clean(docs_of(rows), bench)  # its other columns clash with names inside
    assert kept.columns == docs_of(rows).columns and kept.count() == len(clean)


def test_one_word_many_times(spark, docs_of):
    rows = [(1, "a " * 500), (2, "a " * 9), (3, "b a " * 50)]
    items = [("x", "a " * 12), ("y", "a b a b a b a b a b a"), ("z", "a a")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sorted((str(r.doc_id), len(r.words), sorted(r.hit), list(r.items)) for r in find_overlaps(docs_of(rows), bench).collect()) == brute(rows, items)


def test_a_repetitive_text_and_item(spark, docs_of):
    rng = random.Random(6)
    phrase = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(phrase * 60)), (2, " ".join(rng.sample(phrase * 50, 900))), (3, " ".join(phrase[3:12]))]
    items = [("x", " ".join(phrase * 8)), ("y", " ".join(phrase[5:16]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sorted((str(r.doc_id), len(r.words), sorted(r.hit), list(r.items)) for r in find_overlaps(docs_of(rows), bench).collect()) == brute(rows, items)


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([("x", "a b c")], "item_id string, text string")
    docs = docs_of([(1, "a b c")])
    assert find_overlaps(docs.where("false"), bench).count() == 0
    assert [len(r.hit) for r in find_overlaps(docs, bench.where("false")).collect()] == [0]
