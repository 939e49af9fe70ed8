"""Toxicity: a word classifier whose scores may not move when identity terms are swapped."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, discard, pick, settle

#: Labelled texts that the classifier is fitted on at most, sampled texts that a feature must occur in, and deviations by which its log odds must differ from none.
SAMPLE, LEAST_TEXTS, LEAST_Z = 20_000, 3, 2.5
#: Lengths of the word beginnings that count as features, and how many different words must share one for its further features.
BEGINNINGS, SHARED = (3, 5, 7), (1, 2, 4)
#: Words whose beginnings a Python worker keeps.
KEPT_WORDS = 100_000
#: Texts whose features a task holds at once.
FEATURE_ROWS = 64
#: Weight of a toxic text among the others, of the squared weights (for all texts together) and of the squared score changes under swaps (for each).
TOXIC_WEIGHT, RIDGE, FAIR = 4.0, 0.25, 10.0
CUT = 0.7

# Identity terms in four languages; those of a line stand for each other.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mothers", "fathers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "mormon"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "mormons"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "citizens", "refugees"), ("african", "european", "american", "mexican", "chinese", "indian", "turkish", "polish"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("mütter", "väter"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("schwarze", "weiße", "asiaten"), ("schwule", "lesben", "heterosexuelle"),
    ("einwanderer", "bürger", "flüchtlinge"), ("afrikaner", "europäer", "amerikaner", "türken", "polen", "chinesen"), ("alte", "junge"), ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("mères", "pères"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "asiatiques"), ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("immigrés", "citoyens", "réfugiés"), ("africains", "européens", "américains", "turcs", "polonais", "chinois"), ("vieux", "jeunes"), ("handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("madres", "padres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos"), ("homosexuales", "lesbianas", "heterosexuales"),
    ("inmigrantes", "ciudadanos", "refugiados"), ("africanos", "europeos", "americanos", "turcos", "polacos", "chinos"), ("viejos", "jóvenes"), ("discapacitados", "ciegos", "sordos"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _bases(word: str) -> list[str]:
    """The word itself, and its beginnings with a mark."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def features_of(words: set[str]) -> list[str]:
    """Words, beginnings, and beginnings that several different words share: 'clown', '^clo', '^clo#2'."""
    shared: dict[str, int] = {}
    for word in words:
        for base in _bases(word):
            shared[base] = shared.get(base, 0) + 1
    return sorted(base if least == 1 else f"{base}#{least}" for base, n in shared.items() for least in SHARED if n >= least)


@dataclass
class Model:
    """Weights of features, and the bias."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        known = {f.partition("#")[0] for f in self.weights}
        self.known = known
        self.steps = {base: [(least, w) for least in SHARED if (w := self.weights.get(base if least == 1 else f"{base}#{least}"))] for base in known}
        self.kept: dict[str, tuple[str, ...]] = {}

    def score(self, words: set[str]) -> float:
        shared: dict[str, int] = {}
        kept, known = self.kept, self.known
        for word in words:
            bases = kept.get(word)
            if bases is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                bases = kept[word] = tuple(b for b in _bases(word) if b in known)
            for base in bases:
                shared[base] = shared.get(base, 0) + 1
        z = self.bias + sum(w for base, n in sorted(shared.items()) for least, w in self.steps[base] if n >= least)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled texts that aren't held out, chosen by a hash of their ids; each different text and label once."""
    known = pick(labels, "doc_id", "toxic").dropna().where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The bound on the sample bounds what is broadcast: an id and a label of each text.
    return pick(docs, "doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """The term that takes each identity term's place: the next one of its group."""
    return {t: group[(i + 1) % len(group)] for group in groups for i, t in enumerate(group)}


def counterfactual(words: set[str], swap: dict[str, str], mentions: list[str]) -> tuple[set[str], set[str]]:
    """A sentence with identity terms, and the same with these swapped.

    Of a text without any, a neutral mention is made first: one of ``mentions``, by the
    checksum of its words, is put in. So every labelled sentence says that a group's
    name alone may not move its score, whether the corpus mentions that group or not.
    """
    if not words & swap.keys() and mentions:
        words = words | {mentions[zlib.crc32(" ".join(sorted(words)).encode()) % len(mentions)]}
    return words, {swap.get(w, w) for w in words}


def _feature_rows(groups: tuple[tuple[str, ...], ...]):
    """Features of each text, and those that its counterfactual loses and gains."""
    kind, swap = pa.list_(pa.string()), swaps(groups)
    mentions = sorted(swap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), FEATURE_ROWS):
                part = batch.slice(i, FEATURE_ROWS)
                texts = [words_of(t) for t in part.column(0).to_pylist()]
                sides = [tuple(set(features_of(w)) for w in counterfactual(t, swap, mentions)) for t in texts]
                columns = [[features_of(w) for w in texts], [sorted(a - b) for a, b in sides], [sorted(b - a) for a, b in sides]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c in columns), part.column(1)], ["features", "lost", "gained", "toxic"])

    return run


def _placed(features: list[str]):
    """The lists of features as bytes of 32-bit places; features without a place are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(features)}
        for batch in batches:
            lists = [[np.array([place[f] for f in x if f in place], np.int32).tobytes() for x in batch.column(k).to_pylist()] for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in lists), batch.column(3)], ["features", "lost", "gained", "toxic"])

    return run


@dataclass
class Sparse:
    """Rows of few values: the columns of each row one after the other."""

    columns: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, plus: list[bytes], minus: list[bytes], width: int) -> Sparse:
        """One row for each list of places: ones, and minus ones."""
        lists = [np.frombuffer(x, np.int32) for x in plus + minus]
        size = np.array([len(x) for x in lists], np.int64)
        which = np.repeat(np.arange(len(lists)), size)
        return cls(np.concatenate([*lists, np.zeros(0, np.int32)]), which % max(1, len(plus)), np.where(which < len(plus), 1.0, -1.0), (len(plus), width))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns] * self.values, self.shape[0])

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, e[self.rows] * self.values, self.shape[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """Fits the classifier on a bounded sample of the labelled texts.

    Features are the words and word beginnings that occur in LEAST_TEXTS of the sampled
    texts and whose log odds between the labels differ from none by LEAST_Z deviations;
    both hold at every size. Beside the logistic loss and a ridge, each sampled text
    adds the squared change of its score (before the logistic function) when the
    identity terms of ``groups`` in it are swapped, so mentions of a group carry no
    weight; see ``counterfactual``.

    With no labelled texts every score is 0.5. Rows without text, id or label teach
    nothing; repeated texts with one label count once; of labels that contradict each
    other for an id the greater holds. Other columns are ignored. The driver sees only
    the places of features in the bounded sample.
    """
    spark = docs.sparkSession
    texts = training_texts(docs, labels, sample)
    rows, path = settle(texts.mapInArrow(_feature_rows(groups), "features array<string>, lost array<string>, gained array<string>, toxic int"), "features")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        discard(spark, path)
        return Model({}, 0.0)
    counted = rows.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    other = F.col("n") - F.col("t")
    odds = F.log((F.col("t") + 0.5) / (n_toxic - F.col("t") + 0.5)) - F.log((other + 0.5) / (n - n_toxic - other + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (other + 0.5))
    telling = counted.where((F.col("n") >= LEAST_TEXTS) & (F.abs(odds / spread) >= LEAST_Z))
    features = sorted(r[0] for r in telling.select("feature").collect())
    placed = rows.mapInArrow(_placed(features), "features binary, lost binary, gained binary, toxic int").collect()
    discard(spark, path)
    placed.sort()  # the order of additions doesn't depend on how Spark dealt the rows
    x = Sparse.of([bytes(r[0]) for r in placed], [b""] * len(placed), len(features))
    pairs = [(bytes(r[1]), bytes(r[2])) for r in placed]
    moved = Sparse.of([a for a, _ in pairs], [b for _, b in pairs], len(features))
    weights, bias = _descend(x, np.array([r[3] for r in placed], float), moved)
    return Model({f: float(v) for f, v in zip(features, weights, strict=True) if v}, float(bias))


def _slope(w: np.ndarray, b: float, x: Sparse, y: np.ndarray, moved: Sparse) -> np.ndarray:
    """Derivatives of the loss by all weights and the bias."""
    error = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - y) * np.where(y > 0, TOXIC_WEIGHT, 1.0)
    slope = (x.back(error) + RIDGE * w) / len(y) + 2 * FAIR * moved.back(moved.times(w)) / len(y)
    return np.r_[slope, error.mean()]


def _descend(x: Sparse, y: np.ndarray, moved: Sparse, steps: int = 250, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """Adam on the regularised loss; ``moved``: what the swaps change in the features of each text."""
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        g = _slope(w, b, x, y, moved)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of every row of ``docs``, which has a column text, and its score.

    A score depends on the words of the whole text alone. Null and empty texts have no
    words, so the bias is their score; a very long text is read whole. Null doc_ids and
    repeated rows keep a row each. A column of ``docs`` with the name score, in any
    case, gives way to the score; other names are free, also twice.
    """
    bounded_batches(docs.sparkSession)
    places = [i for i, name in enumerate(docs.columns) if name.lower() != "score"]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in places])
    at = places.index(docs.columns.index("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(words_of(t or "")) for t in batch.column(at).to_pylist()]
            yield batch.append_column("score", pa.array(scores, pa.float64()))

    scored = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return scored.toDF(*[docs.columns[i] for i in places], "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_rows(pick(docs, "doc_id", "text"), fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
