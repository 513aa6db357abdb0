"""Packing of tokenised documents into sequences: large-item matching, then best fit.

A document's ids end with an end id. Documents longer than a sequence are cut into full pieces and a last piece. Pieces
above one third of the capacity go first: at most two of them fit a sequence, so the largest is matched greedily with
the largest partner that fits beside it. Smaller pieces follow in falling size, each into the tightest gap that holds
it.

Scale: which piece of a given length goes where does not matter, so the plan needs only how many pieces have each
length. That histogram has at most ``capacity`` rows at any input size; the plan is made of ranges of equal pieces and
equal sequences, so that its size follows the number of lengths, not of documents. Each piece then finds its place by
its rank among the pieces of its length. Ranks are counted in salted cells (length, salt), whose offsets are added, so
one very common length does not meet in one task. Tokenising is one pass without a shuffle.

Defined results: null text is empty and gives one piece with the end id alone; repeated rows are packed each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stash, table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of words and ids that a Python worker remembers, and bytes of text that it takes at a time.
_REMEMBERED = 32 << 20
_SLICE = 4 << 20
#: A word that the tokenizer lower-cases and cuts into its letters and its marks, whatever stands around it.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[,.!?;:#$]*$"
_MARKS = ",.!?;:#$"


class Encoder:
    """Ids of texts; a word between white space is encoded once and remembered.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words in a row.
    Words of letters of the first 256 characters are remembered in lower case and apart from the marks that follow them.
    What is remembered lies in three flat arrays (words, where their ids end, ids), bounded by bytes; words that have not
    been met for longest go first.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.array([k.endswith("</w>") for k, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])], bool)
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends, self.met, self.now = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        listed = words.to_pylist()
        count = np.zeros(len(listed), np.int64)
        found = []
        alone = np.flatnonzero(plain)
        for at in range(0, len(alone), 5_000):  # each is one run of letters, whose last id is marked as an end of word
            part = alone[at : at + 5_000]
            ids = np.array(self.tokenizer.encode(" ".join([listed[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            count[part] = np.diff(stops, prepend=0)
            found.append(ids)
        rest = np.flatnonzero(~plain)
        for at in range(0, len(rest), 5_000):
            part = rest[at : at + 5_000]
            for i, x in zip(part, self.tokenizer.encode_batch_fast([listed[i] for i in part], add_special_tokens=False), strict=True):
                found.append(np.array(x.ids, np.uint32))
                count[i] = len(x.ids)
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        order = np.concatenate((alone, rest))
        begins = np.empty(len(order), np.int64)
        begins[order] = np.cumsum(count[order]) - count[order]
        return _runs(ids, begins, count), count

    def _known(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those remembered; new ones are encoded."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        if len(new):
            ids, count = self._encoded(new)
            self.ids = np.concatenate((self.ids, ids))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(count)))
            place = at.to_numpy(zero_copy_only=False)
            place = np.where(np.isnan(place), 0, place).astype(np.int64) if place.dtype.kind == "f" else place.astype(np.int64)
            place[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))
        else:
            place = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[place] = self.now
        return place

    def _forget(self) -> None:
        """Keep the words met last, up to half of what may be remembered."""
        size = np.asarray(pc.binary_length(self.words)).astype(np.int64) + 24 + 4 * np.diff(self.ends)
        if size.sum() <= _REMEMBERED:
            return
        order = np.argsort(-self.met, kind="stable")
        keep = np.sort(order[np.cumsum(size[order]) <= _REMEMBERED // 2])
        count = np.diff(self.ends)[keep]
        self.ids = _runs(self.ids, self.ends[:-1][keep], count)
        self.ends = np.concatenate(([0], np.cumsum(count)))
        self.words, self.met = self.words.take(pa.array(keep)), self.met[keep]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in order."""
        texts = texts.cast(pa.large_string())
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        start = 0
        while start < len(texts):
            stop = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), _SLICE, side="right")))
            yield from self._slice(pc.fill_null(texts.slice(start, stop - start), ""))
            start = stop

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self.now += 1
        cut = pc.ascii_split_whitespace(texts)
        ends = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, _PLAIN)
        stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, _MARKS)), words)
        marks = pc.if_else(plain, pc.replace_substring_regex(words, "^[^,.!?;:#$]+", ""), "")
        both = pa.concat_arrays([stems, marks]).dictionary_encode()
        place = self._known(both.dictionary)[np.asarray(both.indices)].reshape(2, -1)
        count = np.diff(self.ends)[place]
        # the ids of each distinct word, then of each word in place
        ids = _runs(self.ids, self.ends[place].T.ravel(), count.T.ravel())
        each = count.sum(axis=0)
        code = np.asarray(coded.indices)
        of = each[code]
        flat = _runs(ids, (np.cumsum(each) - each)[code], of)
        stops = np.concatenate(([0], np.cumsum(of)))[ends - ends[0]]
        self._forget()
        del texts, cut, coded, words, plain, stems, marks, both, ids, code, of
        pa.default_memory_pool().release_unused()
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            yield flat[a:b]


def _runs(values: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``values[begin : begin + count]`` in a row."""
    at = np.repeat(begins - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return values[at]


_encoders: dict[str | None, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, found in enumerate(own.encode(batch.column("text"))):
                data = found.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go: rows ``(length, first rank, first sequence, pieces to a sequence, offset)``
    in order of length and rank; and the number of sequences."""
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first sequence, how many)
    gaps: list[int] = []
    total = 0

    def put(size: int, base: int, bins: int, each: int, offset: int) -> None:
        out.append((size, used[size], base, each, offset))
        used[size] += bins * each
        left[size] -= bins * each

    def release(gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if gap not in free:
                free[gap] = []
                insort(gaps, gap)
            free[gap].append((base, bins))

    large = sorted(s for s in left if 3 * s > capacity)
    open_ = list(large)  # sizes that still have pieces, rising
    while open_:
        a = open_[-1]
        fit = bisect_left(open_, capacity - a + 1) - 1
        if fit < 0:
            n = left[a]
            put(a, total, n, 1, 0)
            release(capacity - a, total, n)
        else:
            b = open_[fit]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b and n == 0:  # the last of its size: the next smaller partner, if any
                if fit:
                    b, n = open_[fit - 1], 1
                else:
                    put(a, total, 1, 1, 0)
                    release(capacity - a, total, 1)
                    total += 1
                    open_.pop()
                    continue
            put(a, total, n, 1, 0)
            put(b, total, n, 1, a)
            release(capacity - a - b, total, n)
            if b != a and left[b] == 0:
                open_.remove(b)
        total += n
        if left[a] == 0:
            open_.pop()
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            n, at = left[s], bisect_left(gaps, s)
            if at == len(gaps):
                gap, base, bins = capacity, total, -(-n // (capacity // s))
                total += bins
            else:
                gap = gaps[at]
                base, bins = free[gap].pop()
                if not free[gap]:
                    del free[gap]
                    gaps.pop(at)
            each = gap // s
            want = -(-n // each)
            if bins > want:
                release(gap, base + want, bins - want)
                bins = want
            full = min(bins, n // each)
            if full:
                put(s, base, full, each, capacity - gap)
                release(gap - each * s, base, full)
            if bins > full:
                rest = left[s]
                put(s, base + full, 1, rest, capacity - gap)
                release(gap - rest * s, base + full, 1)
    return np.array(sorted(out), np.int64).reshape(-1, 5), total


def pack(found: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (stored pieces with a ``length``) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranges, _ = plan(counts, capacity)
    salts = max(64, -(-sum(counts.values()) // 500_000))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = stash(cells.select("length", "salt", before.alias("before")), folder, "cells")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(cells, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).select(*found.columns, "rank")
    shared, names = found.sparkSession.sparkContext.broadcast(ranges), found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] * (1 << 45) + t[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = t[np.searchsorted(keys, length * (1 << 45) + rank, side="right") - 1] if len(t) else t
            nth = rank - r[:, 1]
            sequence, offset = r[:, 2] + nth // r[:, 3], r[:, 4] + nth % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in found.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``."""
    folder = shared_folder(docs.sparkSession)
    found = stash(pieces(docs, id_col, text_col, capacity, end_id, tokenizer, with_ids), folder, "pieces")
    return pack(found, folder, capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
