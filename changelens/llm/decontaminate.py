"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a batch of whole documents inside one task. Its words become integers by the benchmark's vocabulary; a word
that the benchmark lacks ends a suffix, since no match can run over it. Runs too short for any window are left out,
the suffixes of the rest are sorted by prefix doubling, and every benchmark suffix is binary-searched in that array.
The range of hits of a benchmark suffix gives the places of its window; hits at consecutive places make up the
longest verbatim matches (each checked against the items), with document, place and length.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. A document word
inside any occurrence of a window is hit. A document is contaminated if at least one word, and at least one in twenty,
is hit.

Scale: documents are never shuffled, each task sorts one bounded shard at a time, and a third of all rows sharing one
passage only means that many rows report it. The benchmark is the query set: it is read in blocks of a stated size
(``block_bytes`` of text), each broadcast and searched against all documents; the blocks' hits are joined per document.

Defined results: null text has no words and is never contaminated; empty documents and items have no windows; repeated
rows are judged alike; items that share a window are all named; a null item id is left out of the list of ids;
other columns of the input are ignored, or kept as they are by ``decontaminate``; empty tables are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stash, table

WINDOW = 13
SHARD_WORDS = 300_000
BLOCK_BYTES = 16 << 20
#: Words are runs of digits, letters (lower-cased A-Z) and bytes beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes that begin with a word, in order; word 0 ends a suffix.

    Prefix doubling: the rank by the first h words and that of the place h words on give the rank by 2h words.
    """
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    left = _run_left(ids)[at]
    key, h = ids[at].astype(np.int64), 1
    while True:
        order = np.argsort(key, kind="stable")
        dense = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        if dense[-1] == len(at) or h >= left.max():
            return at[order]
        rank = np.zeros(len(ids) + 1, np.int64)
        rank[at[order]] = dense
        ahead = np.where(left > h, rank[np.minimum(at + h, len(ids))], 0)
        key, h = rank[at] * (len(at) + 1) + ahead, 2 * h


def _run_left(ids: np.ndarray) -> np.ndarray:
    """For each place, how many words follow before the next 0, itself included."""
    ends = np.flatnonzero(ids == 0)
    stop = np.concatenate((ends, [len(ids)]))
    return stop[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


class TestSet:
    """A block of benchmark items as word numbers, with its distinct windows."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], int] = {}
        self.items: list[list[int]] = []  # of each window, the items that have it
        self.names = [item for item, _ in items]
        self.width = width
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                w = windows.setdefault(tuple(ids[i : i + width]), len(windows))
                if w == len(self.items):
                    self.items.append([])
                if not self.items[w] or self.items[w][-1] != k:
                    self.items[w].append(k)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.queries = np.zeros((len(windows), width), np.int32)
        for w, k in windows.items():
            self.queries[k, : len(w)] = w
        self.shortest = int(self.lengths.min()) if windows else 1 << 60
        joined = np.array([x for _, text in items for x in [0, *(self.vocabulary[w] for w in words(text))]], np.int32)
        self.order = suffix_array(joined).astype(np.int32)
        self.joined = joined.astype(">i4").tobytes()  # big-endian, so that bytes compare as the words do

    def holds(self, ids: np.ndarray) -> bool:
        """Whether some item has these words in a row: binary search in the benchmark's own suffix array."""
        what = ids.astype(">i4").tobytes()
        lo, hi = 0, len(self.order)
        while lo < hi:
            mid = (lo + hi) // 2
            at = 4 * int(self.order[mid])
            if self.joined[at : at + len(what)] < what:
                lo = mid + 1
            else:
                hi = mid
        at = 4 * int(self.order[lo]) if lo < len(self.order) else len(self.joined)
        return self.joined[at : at + len(what)] == what

    def longest(self, ids: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[int, int]:
        """Place and length of the longest verbatim match within stretches whose windows all occur in the benchmark."""
        best = (-1, 0)
        for a, b in sorted(stretches, key=lambda s: s[0] - s[1]):
            if b - a <= best[1]:
                break
            if self.holds(ids[a:b]):
                best = (a, b - a)
                continue
            stop = a  # the stretch runs over several items: move both ends
            for start in range(a, b):
                stop = max(stop, start)
                while stop < b and self.holds(ids[start : stop + 1]):
                    stop += 1
                if stop - start > best[1]:
                    best = (start, stop - start)
        return best

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), np.int32, len(found))

    def search(self, ids: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) in the suffix array of the suffixes that begin with each window."""
        padded = np.concatenate((ids, np.zeros(self.width, ids.dtype)))

        def bound(after_equal: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.queries), np.int64), np.full(len(self.queries), len(array))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                sign = np.zeros(len(lo), np.int8)  # of suffix against window
                who = np.flatnonzero(open_)
                for k in range(self.width):
                    who = who[k < self.lengths[who]]
                    if not len(who):
                        break
                    diff = padded[array[mid[who]] + k] - self.queries[who, k]
                    sign[who] = np.sign(diff)
                    who = who[diff == 0]
                right = (sign <= 0) if after_equal else (sign < 0)
                lo = np.where(open_ & right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        return bound(False), bound(True)


def scan_shard(found: list[list[bytes]], test: TestSet) -> list[tuple[np.ndarray, list[int], int, int]]:
    """For each document of a shard: spans ``[start, stop)`` of hit words as an array, the items found (as numbers in
    the block), and place and length of its longest verbatim match."""
    n_words = np.array([len(w) for w in found], np.int64)
    ids = [test.numbers(w) for w in found]
    flat = np.concatenate([x for doc in ids for x in (doc, np.zeros(1, np.int32))]) if ids else np.zeros(0, np.int32)
    offset = np.concatenate(([0], np.cumsum(n_words + 1)))[:-1]
    left = _run_left(flat)
    starts = np.flatnonzero((flat != 0) & np.concatenate(([True], flat[:-1] == 0))) if len(flat) else np.zeros(0, np.int64)
    long = starts[left[starts] >= test.shortest]
    none = [(np.zeros((0, 2), np.int64), [], -1, 0)] * len(found)
    if not len(long):
        return none
    # keep the long runs, each with a 0 behind it
    size = left[long] + 1
    place = np.repeat(long - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
    kept = np.where(place < len(flat), flat[np.minimum(place, len(flat) - 1)], 0)
    array = suffix_array(kept)
    first, last = test.search(kept, array)
    hits = last - first
    window = np.repeat(np.arange(len(hits)), hits)
    if not len(window):
        return none
    at = place[array[np.repeat(first - np.concatenate(([0], np.cumsum(hits)))[:-1], hits) + np.arange(hits.sum())]]
    doc = np.searchsorted(offset, at, side="right") - 1
    order = np.lexsort((at, doc))
    doc, at, window = doc[order], at[order] - offset[doc[order]], window[order]
    out = list(none)
    cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin, stop = at[a:b], at[a:b] + test.lengths[window[a:b]]
        # the windows of one verbatim match begin one word apart
        reach = np.maximum.accumulate(stop)
        apart = np.concatenate(([True], begin[1:] > begin[:-1] + 1))
        run = np.flatnonzero(apart)
        stretches = list(zip(begin[run].tolist(), np.maximum.reduceat(stop, run).tolist(), strict=True))
        gap = np.concatenate(([True], begin[1:] > reach[:-1]))
        spans = np.stack((begin[gap], np.maximum.reduceat(stop, np.flatnonzero(gap))), axis=1)
        items = sorted({k for w in np.unique(window[a:b]).tolist() for k in test.items[w]})
        out[int(doc[a])] = (spans, items, *test.longest(ids[int(doc[a])], stretches))
    return out


def _shards(texts: list[str | None], limit: int) -> Iterator[list[list[bytes]]]:
    shard: list[list[bytes]] = []
    size = 0
    for text in texts:
        found = words(text)
        if shard and size + len(found) > limit:
            yield shard
            shard, size = [], 0
        shard.append(found)
        size += len(found)
    if shard:
        yield shard


def _judged(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _listed(names: list[object]) -> str:
    return sha256(",".join(sorted({str(x) for x in names if x is not None})).encode()).hexdigest()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark cut by a hash of the item so that a block holds about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, longest_at, longest_words``.

    ``spans``: hit words as ``start, stop`` pairs; ``longest_at``: where the longest verbatim match begins (-1: none).
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    if len(blocks) == 1:
        return rows.mapInArrow(_search(blocks[0], window, shard_words, whole=True), f"doc_id {kind}, {_DIGEST}")
    # Several blocks: each row gets a number, stored, so that the blocks' findings meet again.
    folder = shared_folder(docs.sparkSession)
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), folder, "numbered")
    found = None
    for k, block in enumerate(blocks):
        one = stash(rows.mapInArrow(_search(block, window, shard_words, whole=False), f"row long, doc_id {kind}, {_PARTS}"), folder, f"block{k}")
        found = one if found is None else found.unionByName(one)

    def together(keys: tuple, parts: pa.Table) -> pa.Table:
        spans = sorted((a, b) for x in parts.column("spans").to_pylist() for a, b in zip(x[::2], x[1::2], strict=True))
        items = [i for x in parts.column("items").to_pylist() for i in x]
        at, n = max(((a, n) for a, n in zip(parts.column("longest_at").to_pylist(), parts.column("longest_words").to_pylist(), strict=True)), key=lambda x: (x[1], -x[0]))
        row = _digest(parts.column("n_words")[0].as_py(), spans, items, at, n)
        return pa.Table.from_arrays([parts.column("doc_id").slice(0, 1).combine_chunks(), *[pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)]], ["doc_id", *_NAMES])

    return found.groupBy("row").applyInArrow(together, f"doc_id {kind}, {_DIGEST}")


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "longest_at", "longest_words"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
_DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>, longest_at long, longest_words long"
_PARTS = "n_words long, spans array<long>, items array<string>, longest_at long, longest_words long"


def _digest(n_words: int, spans: list[tuple[int, int]], items: list[object], at: int, longest: int) -> list:
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    hit = sum(b - a for a, b in merged)
    return [n_words, hit, len({str(i) for i in items if i is not None}), _listed(items), _judged(n_words, hit), [x for s in merged for x in s], at, longest]


def _search(block: DataFrame, window: int, shard_words: int, whole: bool):
    test = block.sparkSession.sparkContext.broadcast(TestSet([(r["item"], r["text"]) for r in block.collect()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = test.value
        for batch in batches:
            at = 0
            for shard in _shards(batch.column("text").to_pylist(), shard_words):
                part, rows = batch.slice(at, len(shard)), []
                at += len(shard)
                for found, (spans, items, place, longest) in zip(shard, scan_shard(shard, t), strict=True):
                    names = [t.names[k] for k in items]
                    if whole:
                        rows.append(_digest(len(found), spans.tolist(), names, place, longest))
                    else:
                        rows.append([len(found), spans.ravel().tolist(), [None if x is None else str(x) for x in names], place, longest])
                kinds = _TYPES if whole else [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                own = ["doc_id"] if whole else ["row", "doc_id"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *columns], [*own, *(_NAMES if whole else ["n_words", "spans", "items", "longest_at", "longest_words"])])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows, in its own columns; no row is shuffled if the benchmark is one block."""
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if len(blocks) == 1:
        test = docs.sparkSession.sparkContext.broadcast(TestSet([(r["item"], r["text"]) for r in blocks[0].collect()], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = []
                for shard in _shards(batch.column(text_col).to_pylist(), shard_words):
                    for found, (spans, *_) in zip(shard, scan_shard(shard, test.value), strict=True):
                        clean.append(not _judged(len(found), int((spans[:, 1] - spans[:, 0]).sum())))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    texts = docs.select(F.col(text_col).alias("text")).distinct()
    marked = contamination(texts.withColumn("id", F.col("text")), benchmark, "id", "text", item_col, item_text_col, window, shard_words, block_bytes)
    bad = marked.filter("contaminated").select(F.col("doc_id").alias(text_col))
    return docs.join(bad, text_col, "left_anti").select(docs.columns)


def op3_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")
