import os
import random
import time

import numpy as np
import pytest

from latchwork.llm import pieces
from latchwork.llm.pieces import MODEL, Pieces, encode_texts

from .conftest import corpus

pytestmark = pytest.mark.skipif(not os.path.isfile(MODEL), reason="no model file")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


def awkward(n=600):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "e", "\n", "\t", "▁", "<0x41>", "é", "中", "😀", "\0", "the", "in", "ing.", ",,,,", "----", "====", "1234", "</s>", "<unk>", "http://", "ſ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "   ", "x" * 5000, "the" * 100, "=" * 777, " " * 300, "▁x ▁", "\0", "\0\0 a"]


def test_ids_are_those_of_the_library(library):
    texts = awkward()
    own = Pieces(MODEL)
    for _ in range(2):  # the second time all segments are known
        assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)
    assert [own.decode(x) for x in own.encode(texts)] == [t.replace("▁", " ") for t in texts]


def test_forgetting_segments_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 50)
    own, texts = Pieces(MODEL), awkward(100)
    assert [x.tolist() for t in texts for x in own.encode([t])] == library.encode(texts)


def test_edges_are_all_occurrences():
    own = Pieces(MODEL)
    text = b" the internationalization of  things \xc3\xa9t\xc3\xa9"
    start, length, piece = own.edges(np.frombuffer(text + b"\0", np.uint8))
    got = {(int(a), own.pieces[p]) for a, p in zip(start, piece, strict=True)}
    want = {(i, p) for p in own.pieces for i in range(len(text)) if text.startswith(p, i)}
    assert got == want and (np.diff(start * own.unit + length) > 0).all()


@pytest.mark.parametrize("long_run", [1, 4, 10**6])
def test_heap_and_rounds_agree(library, monkeypatch, long_run):
    monkeypatch.setattr(pieces, "LONG_RUN", long_run)
    texts = awkward(200)
    assert [x.tolist() for x in Pieces(MODEL).encode(texts)] == library.encode(texts)


def test_a_million_characters_without_a_space(library):
    rng = random.Random(2)
    for letters in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "的一是不了人我在有他这为之大来以个中上们", "etaoin"):
        text = "".join(rng.choice(letters) for _ in range(1_000_000 if letters[0] == "a" else 60_000))
        began = time.perf_counter()
        ids = Pieces(MODEL).encode([text])[0]
        assert time.perf_counter() - began < 60
        for i in range(0, len(text), 250_000):  # the library too takes long for the whole
            part = text[i : i + 20_000]
            assert Pieces(MODEL).encode([part])[0].tolist() == library.encode(part)
        assert Pieces(MODEL).decode(ids) == text


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(fields):
    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


@pytest.mark.parametrize("change", [(2, 3, 1), (2, 35, 0), (3, 1, b"nmt_nfkc"), (3, 3, 0), (3, 4, 1), (3, 2, b"rules")])
def test_other_models_are_refused(library, change):
    proto = library.serialized_model_proto()
    pieces.require_supported(proto)
    part, number, value = change
    parts = dict(pieces._fields(proto))
    altered = {**dict(pieces._fields(parts[part])), number: value}
    rest = {k: v for k, v in altered.items() if isinstance(v, int) or k in (1, 2)}
    with pytest.raises(ValueError, match="needs"):
        pieces.require_supported(message([*((k, v) for k, v in parts.items() if k in (2, 3) and k != part), (part, message(rest.items()))]))


def test_operator(docs_of, library):
    rows = corpus() + [(None, "x"), (1, None)]
    out = encode_texts(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in out) == sorted((str(i), library.encode(t or ""), t or "") for i, t in rows)
    assert encode_texts(docs_of(rows).where("false")).count() == 0
