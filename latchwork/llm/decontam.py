"""Benchmark decontamination: winnowed word-gram fingerprints, joined and extended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, pick, settle

#: ASCII characters that no word has; all others, letters and digits of any script, make words.
BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words of a window, and of a gram. Every window holds WINDOW - GRAM + 1 grams, and keeps the smallest hash.
WINDOW, GRAM = 10, 5
#: A packed fingerprint: hash above, position (in words) in the lower bits.
POSITION_BITS = 30
#: Fingerprints of the benchmark (some 20 MB), and keys of texts with hits (some 40 MB), up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_KEYS = 500_000, 1_000_000


def words_of(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(spaced, " ", -1), "")


def _packed(value: Column, at: Column) -> Column:
    return F.shiftleft(value, POSITION_BITS).bitwiseOR(at.cast("long"))


def _all_of(hashes: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: _packed(F.xxhash64(F.lit(size), F.slice(hashes, i + 1, size)), i))


def fingerprints(hashes: Column, short: list[int]) -> Column:
    """Packed fingerprints of a text's word hashes: the winnowed grams, and all grams of the ``short`` lengths.

    Of equal hashes in a window the leftmost is kept. Two texts that share a window of
    WINDOW words keep the same gram of it.
    """
    n, inner = F.size(hashes), WINDOW - GRAM + 1
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: _packed(F.xxhash64(*[F.get(hashes, i + k) for k in range(GRAM)]), i))
    half = inner // 2

    def least(values: Column, width: int, step: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(values) - (width - 1) * step - 1), lambda i: F.least(*[F.get(values, i + k * step) for k in range(width)]))

    # An expression stands in an array of one element, so that it is computed once and not anew for each use.
    once = lambda c, f: F.flatten(F.transform(F.array(c), f))
    minima = once(once(grams, lambda g: least(g, half, 1)), lambda h: least(h, 2, half))
    long = F.when(n >= WINDOW, F.array_distinct(minima))
    parts = [F.coalesce(long, F.array().cast("array<bigint>"))]
    for size in short:
        parts.append(F.when(n >= size, _all_of(hashes, size)).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _exploded(rows: DataFrame, short: list[int]) -> DataFrame:
    hashed = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    packed = hashed.select(*[c for c in hashed.columns if c != "hashes"], F.explode(fingerprints(F.col("hashes"), short)).alias("packed"))
    at = F.col("packed").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    return packed.select(*[c for c in packed.columns if c != "packed"], F.shiftright("packed", POSITION_BITS).alias("print"), at.alias("at"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Finds benchmark windows in every whole text of ``docs`` (doc_id, text).

    A window is WINDOW consecutive words of an item (item_id, text), or the whole item
    where it has fewer words. Returns doc_id, words, hit (the places of the words inside
    any occurrence of a window, each once, unordered) and items (the item_ids with
    occurring windows, as sorted strings).

    Null texts and texts without words hold nothing and match nothing. Null doc_ids and
    repeated rows keep a row each; a null item_id is the empty string. Further columns,
    of any name, are ignored. An empty benchmark or table of documents gives no hits or
    no rows. Very long texts are read whole and stay in one row; they grow by one
    fingerprint for some three words.
    """
    return _overlaps(pick(docs, "doc_id", "text"), "doc_id", benchmark)


def _overlaps(texts: DataFrame, keep: str, benchmark: DataFrame) -> DataFrame:
    """(keep, words, hit, items) of each row of ``texts`` (keep, text).

    Texts give few fingerprints, which meet those of the benchmark; hits are kept once
    for each different text, offset and item, and each is extended on the words
    themselves, so a chance hit of a hash never counts. Only texts with hits go through
    a shuffle, to meet these; all others end where they are read.
    """
    spark = texts.sparkSession
    items = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    items, items_path = settle(items.where(F.size("words") > 0).distinct().withColumn("number", F.monotonically_increasing_id()), "items")
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())
    texts = texts.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    long_items = _exploded(items.where(F.size("words") >= WINDOW).select("number", "words"), [])
    short_items = items.where(F.size("words") < WINDOW).select(
        "number",
        F.shiftright(_packed(F.xxhash64(F.size("words"), F.transform("words", lambda w: F.xxhash64(w))), F.lit(0)), POSITION_BITS).alias("print"),
        F.lit(0).alias("at"),
    )
    prints, prints_path = settle(long_items.unionByName(short_items), "prints")
    known = prints.select("number", "print", F.col("at").alias("item_at"))
    known = F.broadcast(known) if prints.count() <= BROADCAST_ROWS else known
    sought = _exploded(texts.select("key", words_of(F.col("text")).alias("words")), short)
    hits = sought.join(known, "print").select("key", "number", (F.col("at") - F.col("item_at")).alias("shift"))
    # An item's words are carried once for each text that it meets, with all its offsets there.
    per_item = hits.groupBy("key", "number").agg(F.collect_set("shift").alias("shifts")).join(items.withColumnRenamed("words", "item_words"), "number")
    per_text = per_item.groupBy(F.col("key").alias("their")).agg(F.collect_list(F.struct("item", "shifts", "item_words")).alias("hits"))
    # As a table of its own, so that Spark can split the copies of one text over several tasks of the join. It grows
    # with the corpus and takes far more memory than its files, so it isn't left to a broadcast by file size.
    per_text, _ = settle(per_text, "per_text")
    discard(spark, prints_path, items_path)
    parts = [texts]
    if per_text.count() <= BROADCAST_KEYS:
        keys = F.broadcast(per_text.select("their"))
        parts = [texts.join(keys, F.col("key") == F.col("their"), how) for how in ("left_semi", "left_anti")]
    met = parts[0].join(per_text.hint("merge"), F.col("key") == F.col("their"), "left").withColumn("words", words_of(F.col("text")))
    words, n = F.col("words"), F.size("words")

    def extended(h: Column) -> Column:
        size = F.least(F.size(h["item_words"]), F.lit(WINDOW))
        first = F.sequence(F.lit(0), F.size(h["item_words"]) - size)

        def starts(shift: Column) -> Column:
            inside = lambda q: (q + shift >= 0) & (q + shift + size <= n)
            same = lambda q: F.when(inside(q), F.slice(words, q + shift + 1, size) == F.slice(h["item_words"], q + 1, size)).otherwise(False)
            return F.transform(F.filter(first, same), lambda q: q + shift)

        every = F.array_distinct(F.flatten(F.transform(h["shifts"], starts)))
        return F.struct(h["item"].alias("item"), F.flatten(F.transform(every, lambda s: F.sequence(s, s + size - 1))).alias("hit"))

    proven = F.filter(F.transform("hits", extended), lambda h: F.size(h["hit"]) > 0)
    no_hit, no_item = F.array().cast("array<int>"), F.array().cast("array<string>")
    found = met.select(keep, "words", F.when(F.col("hits").isNotNull(), proven).alias("proven")).select(
        keep, "words",
        F.coalesce(F.array_distinct(F.flatten(F.transform("proven", lambda h: h["hit"]))), no_hit).alias("hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("proven", lambda h: h["item"]))), no_item).alias("items"),
    )
    if len(parts) > 1:
        found = found.union(parts[1].select(keep, words_of(F.col("text")).alias("words"), no_hit.alias("hit"), no_item.alias("items")))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the rows of ``docs`` (text and others, of any name, also twice) whose text holds no window of the benchmark.

    Null texts hold none and stay; repeated rows stay or go together; an empty table stays empty.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    texts = plain.select(F.struct("*").alias("row"), F.col(f"c{docs.columns.index('text')}").alias("text"))
    return _overlaps(texts, "row", benchmark).where(F.size("hit") == 0).select("row.*").toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (win) WHERE dw.n = bw.n
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
