import hashlib
import random

import pytest

from latchwork.llm import suffix_dedup
from latchwork.llm.suffix_dedup import remove_repeats

from .conftest import corpus


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.setdefault(i, []).append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize(("chunk", "flush"), [(1 << 20, 10**6), (700, 50)])
def test_against_brute_force(docs_of, monkeypatch, chunk, flush):
    for name, value in (("CHUNK", chunk), ("FLUSH", flush), ("BLOCK_FLUSH", flush), ("WINDOW_FLUSH", flush)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus()
    assert found(remove_repeats(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("flush", [10**6, 40])
def test_common_phrases_of_every_length(docs_of, monkeypatch, flush):
    """Phrases on both sides of the depths of the passes, each between words of its own in many texts."""
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "BLOCK_FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "WINDOW_FLUSH", flush)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases = [letters(n) for n in (31, 32, 40, 68, 69, 70, 85, 99, 100, 101, 130, 180)]
    rows = [(i, letters(rng.randint(0, 90)) + phrases[i % 12] + letters(rng.randint(0, 90))) for i in range(150)]
    rng.shuffle(rows)
    assert found(remove_repeats(docs_of(rows))) == brute(rows)


def test_repeated_rows_null_ids_and_runs(docs_of):
    rows = [(5, "ab" * 200), (5, "ab" * 200), (5, "xyz" * 60), (None, "xyz" * 70), (7, "q" * 99), (8, "q" * 100), (9, "q" * 101)]
    assert found(remove_repeats(docs_of(rows))) == brute(rows)


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([(1, "x")]).where("false")).count() == 0
