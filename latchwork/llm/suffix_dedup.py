"""Repeated byte strings: a depth-limited radix order of suffixes, grouped pass by pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, discard, pick, settle

#: Bytes of the string that must repeat.
THRESHOLD = 100
#: Depth of the first pass. Each window of THRESHOLD bytes is ordered by the suffix at its anchor: the place of its smallest hash of FIRST bytes.
FIRST = 32
#: Windows of one block of the second pass: it orders THRESHOLD - BLOCK + 1 bytes.
BLOCK = 32
#: Windows of the third pass that a task compares before they are shuffled.
WINDOW_FLUSH = 200_000
#: Bytes that a task hashes at once.
CHUNK = 1 << 20
#: Anchors among which a task drops repeated contexts before they are shuffled.
FLUSH = 1_000_000

U = np.uint64
_TABLE = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (11, 12)]
_BASE = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of data[i : i + length] for each i: doubling lengths, added up to the wanted one."""
    with np.errstate(over="ignore"):
        power, run, size, out, done = _BASE[which], _TABLE[which][data], 1, None, 0
        while True:
            if length & size:
                if out is None:
                    out, done = run, size
                else:
                    n = len(data) - done - size + 1
                    out, done = out[:n] * power + run[done : done + n], done + size
                if done == length:
                    return _mix(out)
            n = len(data) - 2 * size + 1
            run, power, size = run[:n] * power + run[size : size + n], power * power, 2 * size


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: digits, context, check, anchor, first start, last start.

    ``valid``: which window starts count. digits: the first FIRST bytes of the suffix at
    the anchor, as big-endian numbers of eight bytes, so that their order is that of
    the bytes. Equal windows have the same digits at the same distance, and runs with
    equal digits, context and check (128 bits of hash) hold the same windows.
    """
    grams = _hashes(data, FIRST)
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & U(0xFFFFFFFF00000000)) | place
    at = (_sliding_least(packed, THRESHOLD - FIRST + 1) & U(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros((0, FIRST // 8), np.uint64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    at = at[starts]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.r_[0, cut]], starts[np.r_[cut, len(starts)] - 1]
    anchor = at[np.r_[0, cut]]
    digits = np.lib.stride_tricks.sliding_window_view(data, FIRST)[anchor].view(">u8").astype(np.uint64)
    context, check = (_context(_hashes(data, THRESHOLD, which), anchor, first, last) for which in (1, 0))
    return digits, context, check, anchor, first, last


def _context(windows: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of all bytes that the windows first..last hold, and of where the anchor stands; a run is shorter than a window."""
    where = (anchor - first).astype(np.uint64) * U(1 << 20) + (last - first).astype(np.uint64)
    return _mix(windows[first] * U(3) + _mix(windows[last] + U(5)) + _mix(where + U(77)))


def _pieces(text: np.ndarray, chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a text in which every window starts in exactly one."""
    for begin in range(0, max(1, len(text) - THRESHOLD + 1), chunk):
        yield begin, text[begin : begin + chunk + THRESHOLD - 1]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column text, and where each text begins; the last number is the end."""
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


#: A row of the first pass: place holds the anchor, how far before it the run starts, how long it is, and whether it is open for sure; a known interval has -1 there for its first start, its last one in context.
ANCHORS = "gram binary, context long, check long, doc long, n int, place long"
_BITS, _SURE = 12, 1 << 11
#: Rows of the second pass that a task compares before they are shuffled.
BLOCK_FLUSH = 50_000


def _sorted_out(gram: np.ndarray, context: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that a task holds: those to compare with other tasks' rows, those open for sure, and those repeated.

    ``gram`` and ``context`` have a row each, of numbers that are sorted from the first
    on. Of equal gram and context all but the first (by ``order``) are repeated. Of a
    gram with several contexts two go on to the comparison, which tells every other
    task that there are several; the rest is open without it. So a gram that a third
    of all texts hold brings two rows from each task.
    """
    by = np.lexsort((*order[::-1], *context.T[::-1], *gram.T[::-1]))
    gram, context = gram[by], context[by]
    same_gram = np.r_[False, (gram[1:] == gram[:-1]).all(axis=1)]
    again = same_gram & np.r_[False, (context[1:] == context[:-1]).all(axis=1)]
    fresh = by[~again]
    # A repeated row has the gram of the fresh one before it, so what is left of same_gram tells where grams begin.
    first = ~same_gram[~again]
    ends = first | np.r_[first[1:], True]
    return fresh[ends], fresh[~ends], by[again]


def _anchor_rows(chunk: int, most: int):
    """Rows of the first pass, from texts hashed ``chunk`` bytes at a time and compared ``most`` anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of windows; runs whose windows all occur earlier in what the task holds come as known intervals."""
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            digits, context, check, doc, n, anchor, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
            compared, sure, old = _sorted_out(digits, np.column_stack((context, check)), doc, n, anchor)
            place = (anchor << (2 * _BITS)) | ((anchor - first) << _BITS) | (last - first)
            yield _batch(digits[compared], context[compared], check[compared], doc[compared], n[compared], place[compared])
            if len(sure):
                yield _batch(_spread(doc[sure], anchor[sure]), context[sure], check[sure], doc[sure], n[sure], place[sure] | _SURE)
            if len(old):
                old = old[np.lexsort((first[old], n[old], doc[old]))]
                cut = np.flatnonzero((doc[old][1:] != doc[old][:-1]) | (n[old][1:] != n[old][:-1]) | (first[old][1:] > last[old][:-1] + THRESHOLD)) + 1
                a, b = old[np.r_[0, cut]], old[np.r_[cut, len(old)] - 1]
                yield _batch(_spread(doc[a], first[a]), last[b].astype(np.uint64), check[a], doc[a], n[a], -1 - first[a])

        for batch in batches:
            data, bounds = _texts(batch)
            docs, ns = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "n"))
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + chunk)) - 1)
                whole = data[bounds[i] : bounds[j]]
                for begin, piece in _pieces(whole, chunk) if j == i + 1 else [(0, whole)]:
                    if len(piece) < THRESHOLD:
                        continue
                    valid = np.ones(len(piece) - THRESHOLD + 1, bool)
                    ends = bounds[i + 1 : j] - bounds[i]
                    for e in ends:
                        valid[max(0, e - THRESHOLD + 1) : e] = False
                    digits, context, check, anchor, first, last = anchors(piece, valid)
                    own = np.searchsorted(ends, first, side="right")
                    shift = (bounds[i + own] - bounds[i]) - begin
                    held.append((digits, context, check, docs[i + own], ns[i + own], anchor - shift, first - shift, last - shift))
                    count += len(anchor)
                i = j
                if count >= most:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return run


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of rows that need no comparison, shorter than any gram: they go to all tasks alike."""
    return _mix(doc.astype(np.uint64) + _mix(at.astype(np.uint64)))[:, None]


def _bytes_of(numbers: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes, the first number first."""
    width = 8 * numbers.shape[1]
    ends = np.arange(len(numbers) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(numbers.astype(">u8").tobytes())])


def _batch(gram, context, check, doc, n, place) -> pa.RecordBatch:
    columns = [context.view(np.int64), check.view(np.int64), doc.astype(np.int64), n.astype(np.int32), place.astype(np.int64)]
    return pa.RecordBatch.from_arrays([_bytes_of(gram), *(pa.array(x) for x in columns)], [f.split()[0] for f in ANCHORS.split(", ")])


def _unpacked(rows: DataFrame) -> DataFrame:
    """The rows of the first pass with anchor, first and last; known intervals are later rows."""
    mask, length, known = (1 << _BITS) - 1, _SURE - 1, F.col("place") < 0
    anchor = F.shiftright("place", 2 * _BITS)
    first = F.when(known, -1 - F.col("place")).otherwise(anchor - F.shiftright("place", _BITS).bitwiseAND(F.lit(mask)))
    rows = rows.withColumn("known", known).withColumn("anchor", anchor.cast("int")).withColumn("first", first.cast("int"))
    last = F.when(F.col("known"), F.col("context")).otherwise(F.col("first") + F.col("place").bitwiseAND(F.lit(length)))
    return rows.withColumn("last", last.cast("int"))


def _blocks(anchor: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """Blocks of windows, numbered by their distance from the anchor, with the first and last start in each."""
    for b in range((anchor - last) // BLOCK, (anchor - first) // BLOCK + 1):
        yield b, max(first, anchor - b * BLOCK - BLOCK + 1), min(last, anchor - b * BLOCK)


BLOCKS = "gram binary, context binary, doc long, n int, anchor int, first int, last int, state int"
#: Bytes before those of a block's windows in its context: where the first stands, and how many there are.
_HEAD = 2


def _ranks(values: list[bytes]) -> np.ndarray:
    """The place of each value among the different ones in order, as a column."""
    at = {v: i for i, v in enumerate(sorted(set(values)))}
    return np.array([at[v] for v in values], np.int64)[:, None]


def _block_rows(most: int):
    """Rows of the second pass, compared ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the runs still open. gram: the bytes that all windows of the block hold, after its distance from the anchor; context: the bytes of its windows.

        state: 0 to compare with other tasks' blocks, 1 repeats a block of the same task, 2 open for sure.
        """
        types = [pa.binary(), pa.binary(), pa.int64(), *[pa.int32()] * 5]
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        out: list[list] = [[] for _ in range(7)]

        def flush() -> Iterator[pa.RecordBatch]:
            gram, context = out[:2]
            doc, n, anchor, first, last = (np.array(x, np.int64) for x in out[2:])
            compared, sure, old = _sorted_out(_ranks(gram), _ranks(context), doc, n, anchor)
            state = np.zeros(len(gram), np.int64)
            state[old], state[sure] = 1, 2
            for i, key in zip((away := np.r_[old, sure]).tolist(), _spread(doc[away], first[away])[:, 0].tolist(), strict=True):
                gram[i] = key.to_bytes(8, "big")
            for i in old.tolist():
                context[i] = b""
            columns = [gram, context, doc, n, anchor, first, last, state]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x, list) else pa.array(x).cast(t) for x, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            data, bounds = _texts(batch)
            docs, ns, runs = (batch.column(batch.schema.get_field_index(c)) for c in ("doc", "n", "runs"))
            for k in range(len(docs)):
                text, doc, n = data[bounds[k] : bounds[k + 1]], docs[k].as_py(), ns[k].as_py()
                for run in runs[k].as_py():
                    anchor = run["anchor"]
                    for b, first, last in _blocks(anchor, run["first"], run["last"]):
                        core = text[anchor - b * BLOCK : anchor - (b + 1) * BLOCK + 1 + THRESHOLD].tobytes()
                        held = text[first : last + THRESHOLD].tobytes()
                        for column, value in zip(out, (bytes([b]) + core, bytes([anchor - first, last - first]) + held, doc, n, anchor, first, last), strict=True):
                            column.append(value)
                if len(out[0]) >= most:
                    yield from flush()
                    out = [[] for _ in range(7)]
        if out[0]:
            yield from flush()

    return run


WINDOWS = "window binary, doc long, n int, first int, known boolean"


def _window_rows(most: int):
    """Rows of the third pass, compared ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of the blocks still open, by all its bytes; known: an earlier one stands among those that the task holds."""
        types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        held: list[dict] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in types]
            seen: set[bytes] = set()
            for row in sorted(held, key=lambda r: (r["doc"], r["n"], r["first"])):
                for i in range(row["last"] - row["first"] + 1):
                    window = row["context"][_HEAD + i : _HEAD + i + THRESHOLD]
                    known = window in seen
                    seen.add(window)
                    if known:  # a key of its own, shorter than any window
                        window = b"%d/%d/%d" % (row["doc"], row["n"], row["first"] + i)
                    for column, value in zip(out, (window, row["doc"], row["n"], row["first"] + i, known), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [f.split()[0] for f in WINDOWS.split(", ")])

        for batch in batches:
            rows = batch.to_pylist()
            held += rows
            count += sum(r["last"] - r["first"] + 1 for r in rows)
            if count >= most:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return run


def _radix_pass(rows: DataFrame, contexts: list[str], known: Column, sure: Column, place: str) -> DataFrame:
    """One pass over suffixes sorted by the bytes in gram: ``later`` rows repeat the windows of an earlier one, ``open`` ones share a gram with other windows."""
    group = Window.partitionBy("gram")
    same = group.orderBy(*contexts, "doc", "n", place)
    equal, mixed = F.lit(True), F.lit(False)
    for c in contexts:
        equal = equal & (F.lag(c).over(same) == F.col(c))
        mixed = mixed | (F.min(c).over(group) != F.max(c).over(group))
    seen = rows.withColumn("later", known | F.coalesce(equal, F.lit(False))).withColumn("mixed", mixed)
    return seen.withColumn("open", (F.col("mixed") | sure) & ~F.col("later")).where("later or open").drop("mixed")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = _texts(batch)
        docs, ns, cuts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "cuts"))
        out: list[list] = [[], [], [], [], []]
        for k in range(len(docs)):
            text = data[bounds[k] : bounds[k + 1]]
            depth = np.zeros(len(text) + 1, np.int32)
            for c in cuts[k].as_py() or ():
                depth[c["first"]] += 1
                depth[c["last"] + THRESHOLD] -= 1
            gone = np.cumsum(depth[:-1]) > 0
            spans = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            out[0].append(docs[k].as_py())
            out[1].append(len(text))
            out[2].append(int(gone.sum()))
            out[3].append([{"start": int(a), "end": int(b)} for a, b in spans.reshape(-1, 2)])
            out[4].append(text[~gone].tobytes())
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes each byte of ``docs`` (doc_id, text) that a string of THRESHOLD bytes covers which also starts earlier.

    Texts count as UTF-8 bytes; earlier means in a smaller doc_id, or before in the same
    text; matches never cross texts and are judged on the input. Returns doc_id,
    n_bytes, n_removed, spans (maximal removed runs, end exclusive) and kept (the
    remaining bytes, which may end inside a character).

    Null and empty texts, and those under THRESHOLD bytes, lose nothing. A null doc_id
    counts as the smallest. Rows with the same doc_id are documents of their own, in
    the order of their texts, so of repeated rows all but one are removed. Further
    columns, of any name, are ignored. An empty table gives an empty result. A very long
    text is hashed in stretches of CHUNK bytes, in one task.

    Suffixes are sorted only through THRESHOLD bytes, most significant digits first,
    by the bytes themselves. A window is filed under the suffix at its anchor, so that
    one suffix in some thirty is sorted and still each window is: pass 1 sorts them
    by FIRST bytes, pass 2 those left by 69, pass 3 by all THRESHOLD. After each pass
    a group whose windows are all equal is settled, a suffix alone in its group is
    dropped, and the rest goes on. Whether windows are equal is told in pass 1 by 128
    bits of hash besides the sorted bytes, in passes 2 and 3 by their bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, "doc_id", "text").withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = rows.withColumn("n", F.lit(0))
    else:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    keyed = rows.select("doc", "n", "text")

    found = keyed.where(F.length("text") >= THRESHOLD).mapInArrow(_anchor_rows(CHUNK, FLUSH), ANCHORS)
    one, path_one = settle(_unpacked(_radix_pass(found, ["context", "check"], F.col("place") < 0, (F.col("place") > 0) & (F.col("place").bitwiseAND(F.lit(_SURE)) > 0), "place")).select("doc", "n", "anchor", "first", "last", "later", "open"), "pass1")
    runs = one.where("open").groupBy("doc", "n").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    blocks = keyed.join(runs, ["doc", "n"]).mapInArrow(_block_rows(BLOCK_FLUSH), BLOCKS)
    two, path_two = settle(_radix_pass(blocks, ["context"], F.col("state") == 1, F.col("state") == 2, "anchor").drop("gram", "state"), "pass2")
    windows = two.where("open").select("doc", "n", "first", "last", "context").mapInArrow(_window_rows(WINDOW_FLUSH), WINDOWS)
    rank = Window.partitionBy("window").orderBy("doc", "n", "first")
    three = windows.withColumn("rank", F.row_number().over(rank)).where("rank > 1 OR known")
    cuts = one.where("later").select("doc", "n", "first", "last")
    cuts = cuts.union(two.where("later").select("doc", "n", "first", "last")).union(three.select("doc", "n", "first", F.col("first").alias("last")))
    cuts, path_three = settle(cuts.groupBy("doc", "n").agg(F.collect_list(F.struct("first", "last")).alias("cuts")), "cuts")
    discard(spark, path_one, path_two)
    return rows.join(cuts, ["doc", "n"], "left").select("doc_id", "n", "text", "cuts").mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM t WHERE n >= 100)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gaps AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM later
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN step IS NULL OR step > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM gaps
), spans AS (
  SELECT doc_id, span, min(i) AS b, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span
), per AS (
  SELECT doc_id, sum(e - b) AS removed, count(*) AS k FROM spans GROUP BY doc_id
), edges AS (
  SELECT t.doc_id, t.h, t.n, s.b AS upto, lag(s.e, 1, 0) OVER (PARTITION BY t.doc_id ORDER BY s.b) AS begin FROM t JOIN spans s USING (doc_id)
  UNION ALL
  SELECT t.doc_id, t.h, t.n, t.n, coalesce((SELECT max(e) FROM spans s WHERE s.doc_id = t.doc_id), 0) FROM t
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (upto - begin)), '' ORDER BY begin) AS h FROM edges GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans,
       sha256(unhex(kept.h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN per USING (doc_id)
"""
