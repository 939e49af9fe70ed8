import random

import pytest

ROWS = "doc_id long, text string, TEXT string, key long, id string, n int, size int, words int, kind string"


def frame(spark, rows):
    """Documents with further columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "other", 1, "x", 2, 3, 4, "k") for i, t in rows], ROWS)


@pytest.fixture
def docs_of(spark):
    return lambda rows: frame(spark, rows)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, a shared passage, nulls, empty, short and one very long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(40)
    rows = [(i, text(rng.randint(3, 90))) for i in range(n)]
    for i in range(0, n, 5):
        rows[i] = (i, f"{text(10)} {passage} {text(rng.randint(0, 20))}")
    for i in range(3, n, 7):
        rows[i] = (i, rows[i - 3][1])
    for i in range(4, n, 9):
        w = rows[i - 2][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows[i] = (i, " ".join(w))
    rows += [(n, None), (n + 1, ""), (n + 2, "   \t\n"), (n + 3, "one"), (n + 4, "é" * 200 + " ñandú " + "ö" * 90), (n + 5, "A" * 350), (n + 6, text(4000)), (n + 7, "Two WORDS")]
    rng.shuffle(rows)
    return rows
