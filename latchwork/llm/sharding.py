"""Shards of nearly equal bytes, cut between groups of equal texts."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, pick, settle

#: Groups that one block of the order has on average.
BLOCK_GROUPS = 4096
#: Groups that the driver may hold while it searches; beyond it, only one block at a time.
DRIVER_GROUPS = 500_000
#: Parts of a shard, each numbered by one task, that the rows of a part stay below on average.
SLOT_ROWS = 100_000


@dataclass
class Ordered:
    """Group sizes in the order of their digests: sums by block, and the groups of a block when they are asked for."""

    sums: list[int]
    fetch: object  # block numbers -> {block: [(digest, size), ...] in order}
    most: list[int] = field(default_factory=list)  # the largest group of each block; its sum where nobody says
    held: dict = field(default_factory=dict)

    def __post_init__(self):
        self.most = self.most or self.sums
        self.before = [0]
        for s in self.sums:
            self.before.append(self.before[-1] + s)

    def at(self, place: int) -> int:
        """The block that holds the byte after a prefix sum."""
        return min(bisect.bisect_right(self.before, place), len(self.sums)) - 1

    def block(self, b: int) -> list:
        if b not in self.held:
            if sum(len(x) for x in self.held.values()) > DRIVER_GROUPS:
                self.held.clear()
            self.held |= {b: []} | self.fetch([b])
        return self.held[b]

    def hold(self, blocks: set[int]) -> None:
        """Fetches some blocks at once, if the driver may hold them besides those that it has."""
        missing = {b for b in blocks if 0 <= b < len(self.sums)} - set(self.held)
        if missing and (len(missing) + len(self.held)) * BLOCK_GROUPS <= DRIVER_GROUPS:
            self.held |= {b: [] for b in missing} | self.fetch(sorted(missing))

    def largest(self, begin: int, end: int) -> int:
        """No group between two cuts is larger."""
        found = 0
        for b in range(self.at(begin), self.at(end - 1) + 1):
            if self.most[b] <= found:
                continue
            if begin <= self.before[b] and self.before[b + 1] <= end:
                found = self.most[b]
                continue
            at = self.before[b]
            for _, size in self.block(b):
                if begin <= at < end:
                    found = max(found, size)
                at += size
        return found

    def cut(self, begin: int, capacity: int, end: int | None = None, exact: bool = True) -> tuple[int, bytes | None]:
        """The greedy step: the largest prefix sum within begin + capacity, or that of one group if it is larger, and the digest of the group after it.

        Without ``exact`` a block that isn't held is cut at its ends only.
        """
        end, most = self.before[-1] if end is None else end, begin + capacity
        if most >= end:
            return end, None
        b = self.at(most)
        if not exact and b not in self.held:
            at = self.before[b] if self.before[b] > begin else self.before[b + 1]
            return (end, None) if at >= end else (at, b"")
        at = self.before[b]
        for digest, size in self.block(b):
            if at >= end:
                return end, None
            if begin < at and at + size > most:
                return at, digest
            at += size
        if at <= most:
            raise AssertionError("a block's groups don't add up to its sum")
        return (end, None) if at >= end else (at, self.block(self.at(at))[0][0])


def walk(order: Ordered, shards: int, capacity: int, begin: int, end: int, exact: bool = True) -> list[tuple[int, bytes | None]]:
    """Ends of the shards between begin and end, each with the first digest after it; it stops at ``end`` or after ``shards`` of them."""
    at, out = begin, []
    while at < end and len(out) < shards:
        at, digest = order.cut(at, capacity, end, exact)
        out.append((at, digest))
    return out


def greedy(order: Ordered, shards: int, capacity: int) -> list[bytes] | None:
    """First digests of the second and later shards; None if the capacity needs more shards than there are."""
    ends = walk(order, shards, capacity, 0, order.before[-1])
    return [d for _, d in ends[:-1]] if ends and ends[-1][1] is None else None


def search(order: Ordered, shards: int, largest: int, begin: int, end: int) -> tuple[int, list[tuple[int, bytes | None]]]:
    """The smallest capacity with which the greedy cut fits the groups between begin and end, and its ends of shards.

    A group above the capacity is a shard of its own, so it doesn't raise the others.
    A larger capacity never needs more shards, so the search is a binary one.
    """

    def fits(capacity: int, exact: bool = True) -> bool:
        return walk(order, shards, capacity, begin, end, exact)[-1][0] == end

    even = -(-(end - begin) // shards)
    hi = even + largest  # always enough: each full shard then holds more than its even share
    if largest <= even:
        lo = even - 1
        windows = set()
        for j in range(1, shards):
            windows |= set(range(order.at(begin + max(0, j * (even - largest))), order.at(min(end, begin + j * hi)) + 1))
    else:
        # Cuts between blocks and inside those that are held give a first guess; the exact one lies about a block away.
        lo, guess = -1, hi
        while guess - lo > 1:
            mid = (lo + guess) // 2
            lo, guess = (lo, mid) if fits(mid, False) else (mid, guess)
        order.hold({b + d for at, _ in walk(order, shards, guess, begin, end, False) for b in [order.at(at)] for d in (-1, 0, 1)})
        step = max(1, max((s for b, s in enumerate(order.sums) if b not in order.held), default=1))
        if fits(guess):
            lo, hi = -1, guess
            while hi - step > lo and fits(hi - step):
                hi, step = hi - step, 2 * step
            lo = max(lo, hi - step)
        else:
            lo = guess
            while lo + step < hi and not fits(lo + step):
                lo, step = lo + step, 2 * step
            hi = min(hi, lo + step)
        first, last = (walk(order, shards, c, begin, end) for c in (max(lo, 0), hi))
        windows = {b for (a, _), (z, _) in zip(first, last, strict=False) for b in range(order.at(a), order.at(z) + 1)}
    order.hold(windows)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi, walk(order, shards, hi, begin, end)


def spread(order: Ordered, shards: int, largest: int, begin: int, end: int) -> tuple[int, list[tuple[int, bytes | None]]]:
    """``search``, and again with each run of shards between groups that are shards of their own, so that a run's shards are as even."""
    capacity, ends = search(order, shards, largest, begin, end)
    alone = [z - a > capacity for a, z in zip([begin, *(at for at, _ in ends)], [at for at, _ in ends], strict=False)]
    if not any(alone):
        return capacity, ends
    out, at, i = [], begin, 0
    while i < len(ends):
        j = i + 1
        while not alone[i] and j < len(ends) and not alone[j]:
            j += 1
        stop = ends[j - 1][0]
        if j - i > 1:
            out += spread(order, j - i, order.largest(at, stop), at, stop)[1][:-1]
        out.append(ends[j - 1])
        at, i = stop, j
    return capacity, out


def filled(order: Ordered, shards: int, ends: list[tuple[int, bytes | None]]) -> list[tuple[int, bytes | None]]:
    """Shards that the cut has left over halve the largest ones that hold more than one group."""
    ends, whole = list(ends), set()
    while len(ends) < shards:
        runs = [(z - a, a, z) for a, z in zip([0, *(at for at, _ in ends)], [at for at, _ in ends], strict=False) if a not in whole]
        if not runs:
            break
        size, a, z = max(runs)
        cut = order.cut(a, size // 2, z)
        if cut[1] is None:
            whole.add(a)
            continue
        after = order.cut(cut[0], 0, z)
        if after[1] is not None and abs(2 * (after[0] - a) - size) < abs(2 * (cut[0] - a) - size):
            cut = after
        ends = sorted([*ends, cut], key=lambda x: x[0])
    return ends


def smallest_capacity(order: Ordered, shards: int, largest: int) -> tuple[int, list[bytes]]:
    """The smallest size that the largest shard can have, and the first digests of the second and later shards."""
    total = order.before[-1]
    if largest * shards > total:
        order.hold({b for b, most in enumerate(order.most) if most * 4 * shards > total})
    capacity, ends = spread(order, shards, largest, 0, total)
    return max(capacity, largest), [d for _, d in filled(order, shards, ends)[:-1]]


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Puts every row of ``docs`` (doc_id, text) into one of ``shards`` shards of nearly equal bytes.

    Law ``bytes``: groups of equal texts stand in the order of their SHA-256 digests,
    a contiguous run of groups makes a shard, and the largest shard is as small as
    any such cut allows. A group of more than an even share is a shard of its own and
    larger than the others; these share the rest, as evenly as the runs of groups
    beside it allow: a short run between two such groups, or before the first, is a
    small shard. No shard is empty while there are as many groups as shards. Returns doc_id, size (UTF-8 bytes and 1), text_crc32, law,
    shard, slot (0 and up without gaps in each shard) and grown_shard (null under
    this law).

    Nulls and empty texts have no bytes: size 1, CRC-32 0, one group. Null doc_ids
    and repeated rows keep a row and a slot each. Fewer groups than shards leave the
    last shards empty; an empty table gives an empty result.

    The cut is a comparison with at most ``shards - 1`` digests, so rows are not
    joined with their groups and a hot group never meets in one task. The driver
    sees one sum and one maximum per block of groups, and the groups of blocks that a cut may fall in.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    # The texts are read once; what follows works on some sixty bytes a row.
    rows, rows_path = settle(rows, "rows")
    groups, path = settle(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    n, largest = groups.agg(F.count("*"), F.max("size")).first()
    blocks = max(1, -(-n // BLOCK_GROUPS))
    # Digests are spread evenly: their first 13 digits, taken as a number, give blocks in the order of digests.
    numbered = groups.withColumn("block", F.floor(F.conv(F.substring("digest", 1, 13), 16, 10).cast("long") / F.lit(2.0**52) * blocks).cast("int"))
    sums = {r[0]: (r[1], r[2]) for r in numbered.groupBy("block").agg(F.sum("size"), F.max("size")).collect()}

    def fetch(some: list[int]) -> dict:
        got: dict = {}
        for r in numbered.where(F.col("block").isin(some)).select("block", "digest", "size").toLocalIterator():
            got.setdefault(r[0], []).append((r[1], r[2]))
        return {b: sorted(x) for b, x in got.items()}

    order = Ordered([sums.get(b, (0, 0))[0] for b in range(blocks)], fetch, [sums.get(b, (0, 0))[1] for b in range(blocks)])
    cuts = smallest_capacity(order, shards, largest)[1] if n else []
    discard(spark, path)
    shard = sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    spread_ = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")), 1, 13)
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.conv(spread_, 16, 10).cast("long").alias("spread"))
    out = number_slots(placed, shards)
    discard(spark, rows_path)
    return out


def number_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Slots 0 and up in each shard in the order of ``spread`` (52 bits): parts of it are counted, then each numbers its rows after those before it."""
    placed, _ = settle(placed, "placed")
    rows = placed.count()
    parts = max(1, -(-rows // (SLOT_ROWS * shards)), min(16, rows // 1000))
    placed = placed.withColumn("part", F.floor(F.col("spread") / F.lit(2.0**52) * parts).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy("spread", "doc_id", "size", "text_crc32")
    return placed.withColumn("at", F.row_number().over(own)).join(before, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


#: Holds where no group of equal texts is larger than an even share, as in the driver's tables; hot groups are tested by brute force.
OP3_SQL = """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS digest, hex(encode(coalesce(text, ''))) AS h FROM documents
), texts AS (SELECT digest, any_value(h) AS h FROM d GROUP BY digest
), sums AS (
  SELECT digest, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc
  FROM texts, tab
), o AS (
  SELECT digest, sum(size) OVER (ORDER BY digest) AS upto, size
  FROM (SELECT digest, CAST(sum(length(h) // 2 + 1) AS BIGINT) AS size FROM d GROUP BY digest)
), w AS (
  SELECT CAST(max(upto) AS BIGINT) AS total, max(size) AS largest, list(CAST(upto AS BIGINT) ORDER BY upto) AS ends FROM o
), s(lo, hi, pos, k) AS (
  SELECT (total + 15) // 16 - 1, (total + 15) // 16 + largest, CAST(0 AS BIGINT), 0 FROM w
  UNION ALL
  SELECT CASE WHEN next < total AND k = 15 THEN mid ELSE lo END, CASE WHEN next = total THEN mid ELSE hi END,
         CASE WHEN next = total OR k = 15 THEN 0 ELSE next END, CASE WHEN next = total OR k = 15 THEN 0 ELSE k + 1 END
  FROM (SELECT s.*, total, (lo + hi) // 2 AS mid, list_max(list_filter(ends, lambda e: e <= pos + (lo + hi) // 2)) AS next FROM s, w WHERE hi - lo > 1)
), best AS (SELECT min(hi) AS capacity FROM s
), cuts(pos) AS (
  SELECT CAST(0 AS BIGINT)
  UNION ALL
  SELECT next FROM (SELECT list_max(list_filter(ends, lambda e: e <= pos + capacity)) AS next, total FROM cuts, w, best) WHERE next < total
), placed AS (
  SELECT digest, CAST((SELECT count(*) FROM cuts WHERE cuts.pos <= o.upto - o.size) - 1 AS INTEGER) AS shard FROM o
), r AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, shard,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS spread
  FROM d JOIN sums USING (digest) JOIN placed USING (digest)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY spread, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM r
"""
