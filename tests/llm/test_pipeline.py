"""The stages one after the other on a small corpus, each against brute force on its own input."""

import zlib

import corpus_pipeline
from latchwork.llm import toxicity
from latchwork.llm.pieces import MODEL, Pieces

from .conftest import corpus
from .test_decontam import brute as overlaps
from .test_minhash import brute as groups
from .test_spans import base
from .test_toxicity import labelled


def test_stages(spark, tmp_path):
    toxic, labels = labelled(spark, 80)
    rows = [(i + 1000, t) for i, t in toxic] + corpus(9, 60) + [(2001, "mail ann@mail.com now please"), (2002, "mail bob@mail.com")]
    labels = labels.selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic")
    item = next(t for i, t in rows if i == 0)
    bench = [("b1", " ".join(item.split()[11:31]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    kept = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = [(r.doc_id, getattr(r, "text", None)) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert now.columns == list(corpus_pipeline.COLUMNS)
    model = toxicity.fit(docs, labels)
    assert sorted(kept["near_dedup"]) == sorted((i, t) for i, t in rows if model.score(toxicity.words_of(t or "")) < toxicity.CUT)
    assert any(i >= 1000 and (i - 1000) % 4 == 0 and zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in set(rows) - set(kept["near_dedup"]))
    first = {i for i, _, _, keep in groups(kept["near_dedup"], 5) if keep}
    assert sorted(kept["decontamination"], key=str) == sorted(((i, t) for i, t in kept["near_dedup"] if i in first), key=str)
    clean = {i for i, _, hit, _ in overlaps(kept["decontamination"], bench) if not hit}
    assert sorted(kept["pii"], key=str) == sorted(((i, t) for i, t in kept["decontamination"] if str(i) in clean), key=str)
    redacted = dict(kept["sentencepiece"])
    assert redacted[2001] == "mail [EMAIL] now please"
    assert all(redacted[i] == t for i, t in kept["pii"] if not base(t))
    own = Pieces(MODEL)
    out = {r.doc_id: r for r in now.collect()}
    assert set(out) == set(redacted) and all(own.decode(out[i].ids) == (t or "") and out[i].round_trip for i, t in redacted.items() if t)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((i, r.n_tokens) for i, r in out.items())


def test_each_stage_on_awkward_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing further columns; and an empty table."""
    _, labels = labelled(spark, 80)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "these are ten words of the item that stands here now")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = "some plain words about rivers hills and towns far away"
    rows = [(None, "a text without any id"), (1, None), (2, ""), (3, words), (3, words), (4, "x" * 200_000), (5, " ".join(f"w{i}" for i in range(30_000))), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2.0, ["y"]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, TEXT string, score double, found array<string>")
    want = sorted(rows, key=str)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.where("false"), str(tmp_path))
        assert none.isEmpty() and none.columns == out.columns
        if name == "sentencepiece":
            got = out.collect()
            assert sorted((str(r.doc_id), bool(r.n_tokens)) for r in got) == sorted((str(i), bool(t)) for i, t in rows)
        else:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want, name
