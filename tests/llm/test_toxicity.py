import math
import random
import zlib

import numpy as np

from latchwork.llm.common import pick
from latchwork.llm import toxicity
from latchwork.llm.toxicity import features_of, fit, held_out, score_rows, training_texts, words_of

from .conftest import frame


def labelled(spark, n=300, seed=3):
    rng = random.Random(seed)
    fill = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.sample(fill, 20) + ([rng.choice(["idiotic", "vile"]), "women"] if toxic else rng.choice([["men"], []]))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows)
    model = fit(docs, labels)
    scores = {r.doc_id: r.score for r in score_rows(pick(docs, "doc_id", "text"), model).collect()}
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scores[i] >= 0.7) == (i % 4 == 0) for i in out) / len(out) > 0.95
    # 'women' comes with toxic texts only, yet swapping it with 'men' hardly moves a score.
    a, b = model.score(words_of("women waa wba")), model.score(words_of("men waa wba"))
    assert abs(a - b) < 0.1 and a < 0.7


def test_training_leaves_held_out_rows_and_nulls_alone(spark):
    rows, labels = labelled(spark, 60)
    rows += [(60, None), (61, ""), (None, "idiotic vile")]
    labels = labels.union(spark.createDataFrame([(60, 1, 1), (61, None, 0), (62, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int"))
    texts = {r.text for r in training_texts(frame(spark, rows), labels).collect()}
    assert texts == {t for i, t in rows if i is not None and i < 62 and t is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    docs = frame(spark, rows)
    assert docs.where(held_out(docs.doc_id)).count() == sum(i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows)


def test_no_labels_and_empty_tables(spark):
    rows, labels = labelled(spark, 12)
    none = fit(frame(spark, rows), labels.where("false"))
    assert none.score({"idiotic"}) == 0.5
    scored = score_rows(pick(frame(spark, [(1, None), (2, ""), (2, ""), (None, "x" * 50_000)]), "doc_id", "text"), none)
    assert sorted((str(r.doc_id), r.score) for r in scored.collect()) == [("1", 0.5), ("2", 0.5), ("2", 0.5), ("None", 0.5)]
    assert score_rows(pick(frame(spark, rows), "doc_id", "text").where("false"), none).count() == 0


def brute_loss(model, texts, groups):
    """The whole loss from texts and weights, one text after the other."""
    swap = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    mentions = sorted(swap)

    def z(words):
        return model.bias + sum(model.weights.get(f, 0.0) for f in features_of(words))

    total = 0.0
    for text, toxic in texts:
        words = words_of(text)
        p = 1 / (1 + math.exp(-z(words)))
        total += -math.log(p) * toxicity.TOXIC_WEIGHT if toxic else -math.log(1 - p)
        if not words & set(swap):
            words = words | {mentions[zlib.crc32(" ".join(sorted(words)).encode()) % len(mentions)]}
        total += toxicity.FAIR * (z(words) - z({swap.get(w, w) for w in words})) ** 2
    return (total + toxicity.RIDGE / 2 * sum(w * w for w in model.weights.values())) / len(texts)


def test_loss_and_slope_against_brute_force(spark):
    rows, labels = labelled(spark, 150)
    groups = (("women", "men"), ("waa", "wbb", "womxn"))
    docs = frame(spark, rows)
    texts = [(r.text, r.toxic) for r in training_texts(docs, labels).collect()]
    model = fit(docs, labels, groups=groups)
    # The features are those that are frequent and telling enough, and no others.
    n, n_toxic = len(texts), sum(y for _, y in texts)
    count = {}
    for text, y in texts:
        for f in features_of(words_of(text)):
            count.setdefault(f, [0, 0])[y] += 1

    def telling(o, t):
        odds = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((o + 0.5) / (n - n_toxic - o + 0.5))
        return o + t >= toxicity.LEAST_TEXTS and abs(odds) / math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)) >= toxicity.LEAST_Z

    names = sorted(f for f, (o, t) in count.items() if telling(o, t))
    assert set(model.weights) <= set(names) and {"women", "men"} & set(names)
    # The slope is the derivative of the loss, by differences.
    place = {f: i for i, f in enumerate(names)}
    swap = toxicity.swaps(groups)
    pack = lambda fs: np.array([place[f] for f in fs if f in place], np.int32).tobytes()
    sides = [toxicity.counterfactual(words_of(t), swap, sorted(swap)) for t, _ in texts]
    x = toxicity.Sparse.of([pack(features_of(words_of(t))) for t, _ in texts], [b""] * n, len(names))
    moved = toxicity.Sparse.of([pack(set(features_of(a)) - set(features_of(b))) for a, b in sides], [pack(set(features_of(b)) - set(features_of(a))) for a, b in sides], len(names))
    w, b = np.random.default_rng(1).normal(size=len(names)), 0.3
    slope = toxicity._slope(w, b, x, np.array([y for _, y in texts], float), moved)
    at = lambda v, c: brute_loss(toxicity.Model(dict(zip(names, v, strict=True)), c), texts, groups)
    for i in range(len(names)):
        step = np.eye(len(names))[i] * 1e-5
        assert abs((at(w + step, b) - at(w - step, b)) / 2e-5 - slope[i]) < 1e-4
    assert abs((at(w, b + 1e-5) - at(w, b - 1e-5)) / 2e-5 - slope[-1]) < 1e-4
    # The fit is close to a minimum, and the penalty costs less than without the swaps.
    best = brute_loss(model, texts, groups)
    for f in model.weights:
        for d in (-0.05, 0.05):
            assert brute_loss(toxicity.Model({**model.weights, f: model.weights[f] + d}, model.bias), texts, groups) > best - 1e-3


def test_mentions_are_put_in_where_a_text_has_none():
    swap = toxicity.swaps((("a", "b", "c"),))
    assert toxicity.counterfactual({"a", "x"}, swap, ["a", "b", "c"]) == ({"a", "x"}, {"b", "x"})
    one, other = toxicity.counterfactual({"x"}, swap, ["a", "b", "c"])
    assert len(one) == 2 and one != other and one - {"x"} <= {"a", "b", "c"}
    assert toxicity.counterfactual({"x"}, {}, []) == ({"x"}, {"x"})


def test_a_column_named_score_gives_way(spark):
    table = spark.createDataFrame([(1, "vile", 5.0, 6, 7)], "doc_id long, text string, Score double, TEXT int, words int")
    row = score_rows(table, toxicity.Model({"vile": 2.0}, -1.0))
    assert row.columns == ["doc_id", "text", "TEXT", "words", "score"]
    assert abs(row.collect()[0][4] - 1 / (1 + math.exp(-1))) < 1e-12


def test_scores_do_not_depend_on_order():
    model = toxicity.Model({"vile": 2.0, "^vil": 1.0, "^vil#2": 0.5}, -1.0)
    assert model.score({"vile", "vilest"}) == model.score({"vilest", "vile"}) > model.score({"vile"}) > model.score(set())
