"""SentencePiece encoding and decoding: suffix-array matching of all pieces against a batch, then relaxation."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, pick

#: The public model used by the query; a parameter everywhere else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose ids a Python worker keeps between batches, and characters of text in one step.
CACHE_SEGMENTS, STEP_CHARS = 400_000, 1 << 21
#: Symbols from which a run is merged with a heap of its own; shorter ones take one merge a round, all at once.
LONG_RUN = 96
_WORD = 8


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message: numbers, or bytes as they are."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at : at + size]
        at += size


def require_supported(proto: bytes) -> None:
    """Refuses a model whose ids this encoder wouldn't reproduce."""
    parts = dict(_fields(proto))  # of the repeated pieces only the last one is kept
    trainer, normalizer = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    # Field numbers of the public model format, and their defaults.
    for what, found, needed in (
        ("a BPE model", trainer.get(3, 1), 2),
        ("byte fallback", trainer.get(35, 0), 1),
        ("no suffix marks", trainer.get(24, 0), 0),
        ("the identity normaliser", normalizer.get(1, b""), b"identity"),
        ("no normaliser rules", normalizer.get(2, b""), b""),
        ("a space before the text", normalizer.get(3, 1), 1),
        ("white space as it is", normalizer.get(4, 1), 0),
        ("spaces as a mark", normalizer.get(5, 1), 1),
    ):
        if found != needed:
            raise ValueError(f"the encoder needs {what}; the model has {found!r}")


class Pieces:
    """A BPE model's pieces, and the encoder of segments that no piece crosses.

    A segment is a run of spaces with the characters up to the next one: no piece has a
    space after another character, so segments are encoded apart and once each.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        require_supported(model.serialized_model_proto())
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        found = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece has a space after another character")
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                found.append((piece.replace(SPACE, " ").encode(), i, model.get_score(i)))
        found.sort()
        self.pieces = [p for p, _, _ in found]
        self.ids = np.array([i for _, i, _ in found], np.int32)
        self.scores = np.array([s for _, _, s in found])
        self.lengths = np.array([len(p) for p in self.pieces])
        #: A start times this, plus a length, makes an edge's code.
        self.unit = int(self.lengths.max()) + 1
        self.words = -(-int(self.lengths.max()) // _WORD)
        padded = np.zeros((len(found), self.words * _WORD), np.uint8)
        for k, p in enumerate(self.pieces):
            padded[k, : len(p)] = np.frombuffer(p, np.uint8)
        self.low = padded.view(">u8").astype(np.uint64)
        filled = padded.copy()
        filled[np.arange(filled.shape[1])[None, :] >= self.lengths[:, None]] = 255
        self.high = filled.view(">u8").astype(np.uint64)
        self.known: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.known.clear()
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece (its place in ``pieces``) of every occurrence in ``data``, sorted by start and length.

        The suffix array holds the suffixes in the order of as many bytes as the longest
        piece has; eight bytes make a key. A binary search of each piece gives its range.
        """
        n = len(data)
        tail = np.r_[data, np.zeros(self.words * _WORD, np.uint8)].astype(np.uint64)
        first = np.zeros(n + (self.words - 1) * _WORD, np.uint64)
        for k in range(_WORD):
            first |= tail[k : k + len(first)] << np.uint64(8 * (_WORD - 1 - k))
        keys = [first[w * _WORD : w * _WORD + n] for w in range(self.words)]
        order = np.argsort(keys[0])
        rank = np.zeros(n, np.int64)  # of the words before the current one, in the order of the suffixes
        prior = np.zeros(len(self.pieces), np.int64)  # the same of each piece; -1: it doesn't occur
        where, what = [], []
        for w in range(self.words):
            if w:  # suffixes that begin like some longer piece are put in order by their next word
                sought = np.unique(prior[prior >= 0])
                at = np.minimum(np.searchsorted(sought, rank), max(0, len(sought) - 1))
                near = sought[at] == rank if len(sought) else np.zeros(len(rank), bool)
                order, rank = order[near], rank[near]
                by = np.lexsort((keys[w][order], rank))
                order, rank = order[by], rank[by]
            key = keys[w][order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])][: len(key)]
            begin = np.r_[np.flatnonzero(fresh), len(key)]
            if w:
                values = np.unique(key)
                size = len(values) + 1
                group = rank[begin[:-1]] * size + np.searchsorted(values, key[begin[:-1]])
                low, high = (np.searchsorted(values, x[:, w], side=side) for x, side in ((self.low, "left"), (self.high, "right")))
                low, high, exact = prior * size + low, prior * size + high, (high > low)
            else:
                group, low, high, exact = key[begin[:-1]], self.low[:, 0], self.high[:, 0], np.ones(len(prior), bool)
            here = np.flatnonzero((prior >= 0) & (self.lengths > w * _WORD) & (self.lengths <= (w + 1) * _WORD))
            lo = begin[np.searchsorted(group, low[here])]
            hi = begin[np.searchsorted(group, high[here], side="left" if w else "right")]
            hit = hi > lo
            here, lo, hi = here[hit], lo[hit], hi[hit]
            count = hi - lo
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            where.append(order[at])
            what.append(np.repeat(here, count))
            longer = np.flatnonzero((prior >= 0) & (self.lengths > (w + 1) * _WORD) & exact)
            at = np.searchsorted(group, low[longer])
            met = at < len(group)
            met[met] = group[at[met]] == low[longer[met]]
            prior[:] = -1
            prior[longer[met]] = at[met]
            rank = np.cumsum(fresh) - 1
        start, piece = np.concatenate(where), np.concatenate(what)
        code = start * self.unit + self.lengths[piece]
        by = np.argsort(code)
        return start[by], self.lengths[piece[by]], piece[by]

    def relax(self, data: np.ndarray, segment_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in ``data`` one after the other, and how many each has.

        Segments begin at ``segment_begin`` and end with a zero byte. Edges are relaxed by
        the model's own rule: of the edges that span two neighbouring symbols of a segment,
        the one of the best score, the leftmost of equal ones, makes them one, as long
        as there is any. No merge crosses a place that no edge spans, so segments fall
        into runs there first. Short runs are merged together, long ones with a heap
        each, so the time grows as n log n whatever the text.
        """
        start, length, piece = self.edges(data)
        codes = start * self.unit + length
        lead = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0))
        stop = np.flatnonzero(data == 0)
        owner = np.searchsorted(segment_begin, lead, side="right") - 1
        end = np.minimum(np.r_[lead[1:], len(data)], stop[owner])
        spanned = np.zeros(len(data) + 1, np.int64)
        np.add.at(spanned, start + 1, 1)
        np.add.at(spanned, start + length, -1)
        apart = np.r_[True, owner[1:] != owner[:-1]] | (np.cumsum(spanned)[lead] <= 0)
        run = np.cumsum(apart) - 1
        begin = np.r_[np.flatnonzero(apart), len(lead)]
        long = np.diff(begin) > LONG_RUN
        alive = self._in_rounds(lead, end, run, np.flatnonzero(~long[run]), codes, piece)
        for r in np.flatnonzero(long):
            a, b = int(begin[r]), int(begin[r + 1])
            lo, hi = (int(x) for x in np.searchsorted(codes, [lead[a] * self.unit, int(end[b - 1]) * self.unit]))
            alive[a:b] = self._by_heap(lead[a:b], end[a:b], codes[lo:hi], piece[lo:hi])
        kept = np.flatnonzero(alive)
        code = lead[kept] * self.unit + np.minimum(end[kept] - lead[kept], self.unit - 1)
        at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        known = codes[at] == code if len(codes) else np.zeros(len(kept), bool)
        # Symbols without a piece are single characters: their bytes stand for them.
        count = np.where(known, 1, end[kept] - lead[kept])
        out = np.empty(count.sum(), np.int32)
        first = np.cumsum(count) - count
        out[first[known]] = self.ids[piece[at[known]]]
        rest = np.flatnonzero(~known)
        for k in range(int(count[rest].max()) if len(rest) else 0):
            more = rest[count[rest] > k]
            out[first[more] + k] = self.byte_id[data[lead[kept[more]] + k]]
        return out, np.bincount(owner[kept], weights=count, minlength=len(segment_begin)).astype(np.int64)

    def _in_rounds(self, lead: np.ndarray, end: np.ndarray, run: np.ndarray, active: np.ndarray, codes: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merges the runs of ``active`` symbols, one edge in each of them a round; ``end`` follows. Returns which symbols are left."""
        m = len(lead)
        follow = np.arange(1, m + 1)
        follow[np.r_[run[1:] != run[:-1], True][:m]] = -1
        before = np.arange(-1, m - 1)
        before[np.r_[True, run[1:] != run[:-1]][:m]] = -1
        alive = np.ones(m, bool)
        best = np.full(m, -np.inf)

        def score(i: np.ndarray) -> None:
            best[i] = -np.inf
            i = i[follow[i] >= 0]
            j = follow[i]
            span = end[j] - lead[i]
            code = lead[i] * self.unit + np.minimum(span, self.unit - 1)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            ok = (codes[at] == code) & (span < self.unit) if len(codes) else np.zeros(len(i), bool)
            best[i[ok]] = self.scores[piece[at[ok]]]

        score(active)
        while len(active):
            # Runs in which some edge spans two symbols; one edge is taken in each.
            groups = np.flatnonzero(np.r_[True, run[active][1:] != run[active][:-1]])
            size = np.diff(np.r_[groups, len(active)])
            top = np.maximum.reduceat(best[active], groups)
            live = np.repeat(top > -np.inf, size)
            is_top = live & (best[active] == np.repeat(top, size))
            active_top = np.flatnonzero(is_top)
            if not len(active_top):
                break
            group_of = np.repeat(np.arange(len(groups)), size)[active_top]
            i = active[active_top[np.r_[True, group_of[1:] != group_of[:-1]]]]
            j = follow[i]
            end[i] = end[j]
            follow[i] = follow[j]
            nxt = follow[i]
            before[nxt[nxt >= 0]] = i[nxt >= 0]
            alive[j] = False
            best[j] = -np.inf
            prev = before[i]
            score(np.concatenate([i, prev[prev >= 0]]))
            active = active[live & alive[active]]
        return alive

    def _by_heap(self, lead: np.ndarray, end: np.ndarray, codes: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merges one run whose edges have ``codes``; ``end`` follows. Returns which symbols are left."""
        unit, m = self.unit, len(lead)
        begins, ends = lead.tolist(), end.tolist()
        follow, before = list(range(1, m)) + [-1], list(range(-1, m - 1))
        alive = bytearray(b"\1") * m
        listed, costs = array("q", codes.astype(np.int64).tobytes()), array("d", (-self.scores[piece]).tobytes())
        span = end[1:] - lead[:-1]
        code = lead[:-1] * unit + np.minimum(span, unit - 1)
        at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        first = np.flatnonzero((codes[at] == code) & (span < unit)) if len(codes) else np.zeros(0, np.int64)
        # The best score, then the leftmost; an entry whose symbols have changed since is passed over.
        heap = list(zip((-self.scores[piece[at[first]]]).tolist(), first.tolist(), end[first + 1].tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = follow[i]
            if not alive[i] or j < 0 or ends[j] != stop:
                continue
            ends[i], alive[j] = stop, 0
            k = follow[i] = follow[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a < 0 or b < 0:
                    continue
                wide = ends[b] - begins[a]
                if wide < unit:
                    sought = begins[a] * unit + wide
                    place = bisect_left(listed, sought)
                    if place < len(listed) and listed[place] == sought:
                        heapq.heappush(heap, (costs[place], a, ends[b]))
        end[:] = ends
        return np.frombuffer(bytes(alive), bool)

    def learn(self, segments: list[str]) -> None:
        """Encodes segments that aren't known yet; a zero byte never is part of a piece and parts them."""
        texts = [s.encode() for s in segments]
        lengths = np.array([len(t) for t in texts])
        begin = np.cumsum(lengths + 1) - lengths - 1
        out, count = self.relax(np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), begin)
        base = len(self.begin) - 1
        self.known.update(zip(segments, range(base, base + len(segments)), strict=True))
        self.flat = np.concatenate([self.flat, out])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_SEGMENT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh = list(dict.fromkeys(s for segments in split for s in segments if s not in self.known))
        if len(self.known) + len(fresh) > CACHE_SEGMENTS and self.known:
            self._restart()
            fresh = list(dict.fromkeys(s for segments in split for s in segments))
        zeros = [s for s in fresh if s == "\0"]
        if zeros:  # as its own segment: one byte
            self.known["\0"] = len(self.begin) - 1
            self.flat = np.r_[self.flat, self.byte_id[0]].astype(np.int32)
            self.begin = np.r_[self.begin, self.begin[-1] + 1]
        fresh = [s for s in fresh if s != "\0"]
        if fresh:
            self.learn(fresh)
        out = []
        for segments in split:
            at = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
            size = self.begin[at + 1] - self.begin[at]
            total = int(size.sum())
            index = np.arange(total) + np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
            out.append(self.flat[index])
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, np.asarray(ids, int).tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_SEGMENT = re.compile("\0| +[^ \0]*|[^ \0]+")


@lru_cache(2)
def _loaded(path: str) -> Pieces:
    return Pieces(path)


def _model_path(model: str) -> str:
    """The model where it stands on this machine, else the copy that Spark sent along."""
    if "://" not in model and os.path.isfile(model):
        return model
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(model))


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= STEP_CHARS):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode_texts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encodes and decodes every whole text of ``docs`` (doc_id, text) with the SentencePiece model at ``model``.

    Returns doc_id, text, ids (array of int) and decoded. Ids are those of the model's
    own BPE rule, without begin or end marks; characters without a piece become bytes.

    Null and empty texts have no ids and decode to the empty text. Texts with U+2581
    decode with a space in its place, as the model can't tell them apart. Null doc_ids
    and repeated rows keep a row each. Further columns, of any name, are ignored. An
    empty table gives an empty result. A very long text takes time n log n and memory in
    proportion, with white space or without.

    Spark sends the model file along; machines on which it stands under its own path
    read it there. A model of another kind (not BPE, without byte fallback, with a
    normaliser) is refused with an error.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.sparkContext.addFile(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(_model_path(model))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _steps(texts):
                ids = pieces.encode(texts[i:j])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(texts[i:j]), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([pieces.decode(x) for x in ids])],
                    ["doc_id", "text", "ids", "decoded"],
                )

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4")
        digests = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(digests), batch.column(1), batch.column(3)], ["doc_id", "n_tokens", "ids_sha256", "text", "decoded"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 and round_trip."""
    coded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = coded.mapInArrow(_digested, "doc_id long, n_tokens long, ids_sha256 string, text string, decoded string")
    same = F.translate("text", SPACE, " ") == F.col("decoded")
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))
