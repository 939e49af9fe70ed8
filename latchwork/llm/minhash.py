"""Near-duplicate groups: min-max hashing, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from .common import bounded_batches, discard, pick, settle

U = np.uint64
#: Stands for a null doc_id.
NO_ID = -(2**63)
#: Hash functions, each giving a minimum and a maximum; BANDS bands of four of these values. Two sets of similarity 0.8 miss every band once in 20 million.
PERMUTATIONS, BANDS = 64, 32
#: Shingles that one task compares with each other at most.
CHUNK_SHINGLES = 60_000
#: Hubs with several parts or blocks (two numbers each) up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST_HUBS = 1_000_000
#: Shingles of texts hashed at once.
STEP_SHINGLES = 1 << 17

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


def word_hashes(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts that stand one after the other, and where each text's words begin.

    ``breaks``: which bytes stand between words; without it, white space.
    """
    space = breaks[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    first[inner] = ~space[inner]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    held = np.flatnonzero(~space)
    # A word's bytes have no space between them, so its place among the kept bytes gives each byte's place in the word.
    start = np.searchsorted(held, begin)
    length = np.diff(np.r_[start, len(held)])
    place = np.arange(len(held)) - np.repeat(start, length)
    power = _POWERS[place % 4096] + (place // 4096).astype(np.uint64)
    sums = np.add.reduceat(_BYTES[_LOWER[data[held]]] * power, start)
    return _mix(sums + length.astype(np.uint64)), np.searchsorted(begin, bounds)


def shingle_sets(texts: list[bytes] | pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and where each begins.

    A text with fewer words than ``size`` has its whole sequence as its one shingle, one without words has none.
    """
    column = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    words, at = word_hashes(data, bounds - bounds[0])
    n = len(words) - size + 1
    full = sum((words[k : k + n] * _PLACE[k] for k in range(1, size)), words[:n] * _PLACE[0]) if n > 0 else np.zeros(0, np.uint64)
    full = _mix(full)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            few = words[a:b]
            sets.append(_mix(np.array([(few * _PLACE[: b - a]).sum() + U(b - a)], np.uint64) ^ U(0x5DEECE66D)))
        else:
            sets.append(full[:0])
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else full[:0]), ends


def band_keys(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set that isn't empty: four of its minima and maxima make a band."""
    starts = ends[:-1]
    values = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        turned = hashes * _MULTIPLY[i] + _ADD[i]
        values[:, 2 * i] = np.minimum.reduceat(turned, starts)
        values[:, 2 * i + 1] = np.maximum.reduceat(turned, starts)
    rows = 2 * PERMUTATIONS // BANDS
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(rows):
        keys = _mix(keys * U(0x9E3779B97F4A7C15) + values[:, k::rows])
    return _mix(keys + np.arange(BANDS, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).cast(pa.binary())
            lengths = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64))
            i = 0
            while i < len(ids):  # a stretch of texts at a time, for bounded memory
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(lengths[i:]), 6 * STEP_SHINGLES)))
                hashes, ends = shingle_sets(text.slice(i, j - i), size)
                count = np.diff(ends)
                full = np.flatnonzero(count)
                sums = np.zeros((j - i, 2), np.uint64)
                keys = np.zeros((j - i, BANDS), np.uint64)
                if len(full):
                    starts = ends[full]
                    sums[full, 0] = np.add.reduceat(_mix(hashes + U(1)), starts)
                    sums[full, 1] = np.add.reduceat(_mix(hashes ^ U(0xABCDEF)), starts)
                    keys[full] = band_keys(hashes, np.r_[starts, len(hashes)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(count), *(pa.array(sums[:, k].view(np.int64)) for k in (0, 1)),
                     pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))],
                    ["id", "n_shingles", "low", "high", "bands"],
                )
                i = j

    return run


def _linked(common: np.ndarray, a: int | np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _crossed(hashes: np.ndarray, ends: np.ndarray, sought: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links of the sets ``sought`` with all sets, one for each group of equal ``label`` that they join; labels follow."""
    if not len(sought) or not len(hashes):
        return
    codes = np.unique(hashes, return_inverse=True)[1]
    counts = np.diff(ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(codes, kind="stable")
    begin = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    owner, held = owner[order], np.diff(begin)
    mark = np.zeros(len(held), bool)
    for u in sought:
        mine = codes[ends[u] : ends[u + 1]]
        # A linked set lacks so few of these shingles that it holds one of the rarest.
        spare = len(mine) - -(-percent * len(mine) // 100) + 1
        rare = mine[np.argsort(held[mine], kind="stable")[:spare]]
        lists = [owner[begin[c] : begin[c + 1]] for c in rare[held[rare] > 1]]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[(label[near] != label[u]) & _linked(np.minimum(counts[u], counts[near]), counts[u], counts[near], percent)]
        if not len(near):
            continue
        mark[mine] = True
        held_by = mark[np.concatenate([codes[ends[v] : ends[v + 1]] for v in near])]
        common = np.add.reduceat(held_by, np.r_[0, np.cumsum(counts[near])[:-1]], dtype=np.int64)
        mark[mine] = False
        apart = near[_linked(common, counts[u], counts[near], percent)]
        groups, first = np.unique(label[apart], return_index=True)
        if len(groups):
            yield from ((int(u), int(v)) for v in apart[first])
            label[np.isin(label, groups)] = label[u]


def _compare(size: int, percent: int):
    """Confirms links inside one part of a hub's members: role 0 is the hub, 1 a member, 2 a member to compare with all."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, roles = table["id"].to_numpy(), table["role"].to_numpy()
        text = pa.concat_arrays(table["text"].chunks).cast(pa.binary())
        hashes, ends = shingle_sets(text, size)
        counts = np.diff(ends)
        owner, label = np.repeat(np.arange(len(ids)), counts), np.arange(len(ids))
        links: list[tuple[int, int]] = []
        apart = roles == 2
        for h in np.flatnonzero(roles == 0):
            common = np.bincount(owner[np.isin(hashes, hashes[ends[h] : ends[h + 1]])], minlength=len(counts))
            close = (roles == 1) & (common > 0) & _linked(common, counts[h], counts, percent)
            apart |= (roles == 1) & ~close
            label[close] = label[h]
            links += [(int(h), int(m)) for m in np.flatnonzero(close)]
        links += _crossed(hashes, ends, np.flatnonzero(apart), label, percent)
        hub = table["hub"][0].as_py()
        left = np.flatnonzero(apart) if (roles == 0).any() else []
        return pa.table({
            "hub": pa.array([hub] * (len(links) + len(left)), pa.int64()),
            "a": pa.array([ids[i] for i, _ in links] + [ids[i] for i in left], pa.int64()),
            "b": pa.array([ids[j] for _, j in links] + [None] * len(left), pa.int64()),
        })

    return run


LINKS = "hub long, a long, b long"


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that each id of ``links`` (a, b) reaches; the smallest ids themselves have no row.

    Alternating stars: every node's neighbours move to its smallest neighbour, until no edge changes.
    Edges that still change after ``most_rounds`` are an error.
    """
    spark = links.sparkSession
    edges, path = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        old, (edges, new) = path, settle(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(spark, old)
        path = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise EngineError("traversal/limit-exceeded", f"components aren't settled after {most_rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def _small(hubs: DataFrame) -> DataFrame:
    """A settled table of hubs, marked for a broadcast as long as it is small."""
    return F.broadcast(hubs) if hubs.count() <= BROADCAST_HUBS else hubs.hint("merge")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of ``docs`` (doc_id, text) linked by shingle sets: 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach, its
    own included) and kept (doc_id = component_id). A set holds the distinct shingles of
    ``words`` lower-cased (A-Z) words.

    Null and empty texts, and those of white space only, have no shingles and link with
    nothing. A null doc_id counts as the smallest id and gives a null component_id.
    Rows that share a doc_id are one node. Repeated rows keep a row each. Further
    columns, of any name, are ignored. An empty table gives an empty result. A very long
    text is a part of its own where members are compared.

    Sets that are equal are one node from the start. The hub of a band's bucket is the
    member that meets most others over all bands, so that of a group of near copies it
    is their common source. Every member is compared with its hubs; those that aren't
    linked are compared with all other members of the hub, part by part, on full sets.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = pick(docs, "doc_id", "text")
    texts = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sketched, sketch_path = settle(texts.mapInArrow(_sketches(words), "id long, n_shingles long, low long, high long, bands array<long>"), "sketches")
    nodes = sketched.where("n_shingles > 0").groupBy("low", "high").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes, node_path = settle(nodes, "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    filed, filed_path = settle(rows.join(buckets, "key"), "filed")
    weights = filed.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = filed.join(weights, "node")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("hub"))
    stars = filed.select("key", "node", "n").join(hubs, "key").where("node <> hub").select("hub", "node", "n").distinct()
    stars, star_path = settle(stars, "stars")
    discard(spark, filed_path)

    parts, parts_path = settle(stars.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)).cast("int").alias("parts")), "parts")
    # Only hubs with several parts are looked up, so that a hot hub's members aren't dealt out by their hub.
    several = _small(parts.where("parts > 1"))
    placed = stars.join(several, "hub", "left").select("hub", F.col("node").alias("id"), F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("role"))
    central = parts.select("hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    # The ids grow with the corpus, so they are not broadcast: the texts of all members are picked out by one shuffle.
    members = stars.select(F.col("node").alias("id")).union(stars.select("hub")).distinct()
    told, told_path = settle(texts.join(members.hint("merge"), "id", "left_semi"), "members")
    tested = placed.union(central).join(told.hint("merge"), "id").select("hub", "part", "id", "role", "text")
    tested, tested_path = settle(tested.groupBy("hub", "part").applyInArrow(_compare(words, percent), LINKS), "tested")
    links = tested.where("b is not null").select("a", "b")
    # Members that their hub doesn't link, of hubs with several parts: each meets the other parts too, block by block.
    open_ = tested.where("b is null").select("hub", F.col("a").alias("id")).distinct().join(several, "hub")
    blocks = open_.join(stars.select("hub", F.col("node").alias("id"), "n"), ["hub", "id"])
    sums, sums_path = settle(blocks.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)).cast("int").alias("blocks")), "blocks")
    sums = _small(sums)
    blocks = blocks.join(sums, "hub").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    asking = blocks.select("hub", "id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2).alias("role"))
    asked = placed.join(sums, "hub").select("hub", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(1).alias("role"))
    cross = asking.union(asked).groupBy("hub", "id", "block", "part").agg(F.max("role").alias("role"))
    cross_text = cross.join(told.hint("merge"), "id").select("hub", "block", "part", "id", "role", "text")
    crossed, crossed_path = settle(cross_text.groupBy("hub", "block", "part").applyInArrow(_compare(words, percent), LINKS), "crossed")
    discard(spark, told_path, parts_path, sums_path)
    links = links.union(crossed.where("b is not null").select("a", "b"))
    named = components(links)
    ids = sketched.select("id", "n_shingles", "low", "high")
    of = nodes.select(F.col("low").alias("l"), F.col("high").alias("h"), "node")
    out = ids.join(of, (ids.low == of.l) & (ids.high == of.h) & (ids.n_shingles > 0), "left").join(named.select(F.col("id").alias("node"), "component"), "node", "left")
    component = F.coalesce("component", "node", "id")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("id")).alias("doc_id"), "n_shingles", back(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 4) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a
), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
