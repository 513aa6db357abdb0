"""Language-model scores from a Katz backoff model with Good-Turing discounts, learned and applied over all documents.

Model. P(w | v) = d_c c(vw) / c(v) where the pair was seen in training, else alpha(v) P(w); P(w) = d_c c(w) / N for known
words, and what the discounts leave is the probability of the one unknown word. Counts up to ``K`` get Simple Good-Turing
discounts, from a log-linear fit of the counts of counts 1 to ``K`` + 1, as copies raise single ones of them (absolute
discounts only where these do not fall, as in tiny input); larger counts lose a sliver of 0.01, so that something is left
after every history. alpha(v) is the left-over of v divided by one minus the summed P of v's seen
followers, so each distribution sums to one exactly. A text is scored token by token down this recursion; its last token is an end mark.

Tables. Words are 64-bit hashes. (1) Unigram counts, one row per word, by an ordinary aggregation. (2) Pair
occurrences, scattered by the follower's hash into buckets of about ``bucket_tokens``, as blocks of sorted arrays that
hold each pair of a chunk once, with the chunk-local numbers of the documents. (3) From the buckets: sums for each
document, partial sums for each history, and the unseen pairs that await their history's weight. (4) The histories'
weights meet the unseen pairs by the history's hash. (5) Sums meet per document. Tables 1 and 3 are stored, partitioned by
kind, among them the counts of the seen pairs; the counts of counts that fix the discounts are read in between.

Scale: everything gathered grows with the text and is spread by hash; no table is held whole anywhere, the driver
sees counts of counts and the words above half a bucket (at most twice the number of buckets). Such hot words are
split over buckets by their history; as histories, hot words and the start mark have buckets of their own, each with their
weight, over which the pairs that wait for it are dealt by document. Sums meet chunk by chunk. A pair comes once per chunk with its documents, and what a task receives is
spooled to disk beyond 64 MB, so a pair in a third of all documents costs time in proportion to those documents but not
memory. Chunks and buckets are parameters; beyond about 1 TB of text raise them with the executors' memory, as the
blocks between chunks and buckets get small.

Defined results: null text is empty and has the end mark alone; repeated rows are scored each and learned from each; null
ids are learned from; with nothing to learn from every token has probability 1; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import pickle
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import shared_folder, stash, table
from .simhash import LOWER

K = 5
SLIVER = 0.01
CHUNK_TOKENS = 3_000_000
CHUNK_DOCS = 60_000
BUCKET_TOKENS = 4_000_000
LEAST_BUCKETS = 12
#: No word holds a blank, so these hashes are of no word's spelling.
START, END = np.uint64(xxh64_intdigest(b" start")), np.uint64(xxh64_intdigest(b" end"))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows not learned from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


# Blocks of arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight lie together, which the zeros of small numbers repay."""
    head = [(a.dtype.str, len(a)) for a in arrays]
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((head, body)))


def unpack(block: bytes) -> list[np.ndarray]:
    head, body = pickle.loads(zstandard.ZstdDecompressor().decompress(block))
    out, at = [], 0
    for kind, n in head:
        size = np.dtype(kind).itemsize
        part = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T
        out.append(np.ascontiguousarray(part).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * size
    return out


class Spool:
    """Records in the order of arrival, in memory up to 64 MB, beyond that in the task's own scratch file."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=64 << 20)

    def add(self, record: tuple) -> None:
        pickle.dump(record, self.file)

    def __iter__(self) -> Iterator[tuple]:
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                return

    def close(self) -> None:
        self.file.close()


# Chunks of documents


class Chunk:
    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.ids: list = []
        self.held: list[bool] = []
        self.tokens = 0

    def add(self, doc_id: object, held: bool, text: str | None) -> None:
        found = words(text)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.tokens += len(found) + 1

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxh64_intdigest, self.numbers), np.uint64, len(self.numbers))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
            chunk.add(doc_id, held, text.as_py())
            if chunk.tokens >= chunk_tokens or len(chunk.ids) >= CHUNK_DOCS:
                yield chunk
                chunk = Chunk()
    if chunk.ids:
        yield chunk


def _unigrams(rows: DataFrame, chunk_tokens: int) -> DataFrame:
    """``h, c, n``: a word's count in training and in all documents; the end mark is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_tokens):
            n = len(chunk.numbers)
            held = np.repeat(np.array(chunk.held, bool), [len(p) for p in chunk.parts])
            flat = np.concatenate(chunk.parts)
            h = np.concatenate((chunk.hashes(), [END]))
            learned = np.concatenate((np.bincount(flat[~held], minlength=n), [chunk.held.count(False)]))
            both = np.concatenate((np.bincount(flat, minlength=n), [len(chunk.ids)]))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(learned), pa.array(both)], ["h", "c", "n"])

    return rows.mapInArrow(run, "h long, c long, n long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def slope(counts_of_counts: list[int], k: int = K) -> float:
    """Of the line through log Z over log r, r up to k + 1, where Z spreads n_r over the gap around r; 0 if there is no line."""
    r = [c for c, n in enumerate(counts_of_counts[: k + 1], 1) if n]
    if len(r) < 2:
        return 0.0
    around = [0, *r, 2 * r[-1] - r[-2]]
    x = np.log(r)
    y = np.log([2 * counts_of_counts[c - 1] / (b - a) for a, c, b in zip(around[:-2], r, around[2:], strict=True)])
    x = x - x.mean()
    return float(x @ y / (x @ x))


def discounts(counts_of_counts: list[int], k: int = K) -> np.ndarray:
    """Factors for counts 0 to k (the first is unused), from how many things have counts 1 to k + 1.

    With S(r) = a r^b, r*/r = (r + 1) S(r + 1) / (r S(r)) = (1 + 1/r)^(b + 1), and Katz's tail (k + 1) S(k + 1) / S(1) is
    (k + 1)^(b + 1): every factor is in (0, 1) as soon as b < -1, which Good-Turing needs for r* < r.
    """
    m = slope(counts_of_counts, k) + 1
    c = np.arange(1, k + 1)
    if m < -1e-9:
        tail = (k + 1.0) ** m
        return np.concatenate(([1.0], ((1 + 1 / c) ** m - tail) / (1 - tail)))
    n = [0, *counts_of_counts]
    b = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.concatenate(([1.0], 1 - b / c))


class Unigrams:
    """What every task knows of the unigram model: totals, discounts, and counts and buckets of the hot words."""

    def __init__(self, total: int, known: int, counts_of_counts: list[int], docs: int, hot: dict[int, int], buckets: int, hot_parts: dict[int, int]):
        self.total, self.known, self.docs, self.buckets = total, known, docs, buckets
        self.d = discounts(counts_of_counts)
        few = counts_of_counts[:K]
        rest, rest_mass = known - sum(few), total - sum(c * n for c, n in enumerate(few, 1))
        mass = sum(self.d[c] * c * n for c, n in enumerate(few, 1)) + rest_mass - SLIVER * rest
        self.unknown = 1.0 if not total else 1 - mass / total
        self.hot = hot
        self.first, at = {}, buckets
        for h in sorted(hot_parts):
            self.first[h] = (at, hot_parts[h])
            at += hot_parts[h]
        self.targets = at

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        low = self.d[np.minimum(c, K)] * c
        return np.where(c == 0, self.unknown, np.where(c <= K, low, c - SLIVER) / self.total)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def history_targets(self, h: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Where what waits for a history's weight goes: its bucket, or by ``salt`` one of a hot word's buckets."""
        target = self.bucket(h)
        hot = np.array(sorted(self.first), np.uint64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            own = hot[at] == h
            first, parts = (np.array([self.first[int(x)][k] for x in hot], np.int64) for k in (0, 1))
            target[own] = first[at[own]] + salt[own] % parts[at[own]]
        return target


def _scatter(u: Unigrams, chunk: Chunk) -> Iterator[tuple[int, bytes, bytes]]:
    """Blocks ``(bucket, pairs, places)`` of a chunk."""
    n, docs = len(chunk.numbers), len(chunk.ids)
    h = np.concatenate((chunk.hashes(), [END, START]))
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    h = h[order]
    size = np.array([len(p) + 1 for p in chunk.parts])
    end = np.cumsum(size)
    follower = np.full(end[-1], rank[n])
    mask = np.ones(end[-1], bool)
    mask[end - 1] = False
    follower[mask] = rank[np.concatenate(chunk.parts)]
    history = np.empty_like(follower)
    history[1:] = follower[:-1]
    history[end - size] = rank[n + 1]
    doc = np.repeat(np.arange(docs, dtype=np.uint32), size)
    target = u.bucket(h)[follower]
    for word, (first, parts) in u.first.items():
        at = int(np.searchsorted(h, np.uint64(word)))
        if at < len(h) and h[at] == word:
            own = follower == at
            target[own] = first + (h[history[own]] >> np.uint64(13)) % np.uint64(parts)
    if u.targets * len(h) ** 2 < 1 << 62:
        by = np.argsort((target * len(h) + history) * len(h) + follower, kind="stable")
    else:
        by = np.lexsort((follower, history, target))
    target, history, follower, doc = target[by], history[by], follower[by], doc[by]
    learned = ~np.array(chunk.held, bool)[doc]
    cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        v, w = history[a:b], follower[a:b]
        start = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
        m = np.diff(np.concatenate((start, [b - a]))).astype(np.uint32)
        c = np.add.reduceat(learned[a:b].astype(np.uint32), start, dtype=np.uint32)
        v, w = v[start], w[start]
        new = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        each = np.diff(np.concatenate((new, [len(v)]))).astype(np.uint32)
        own, place = np.unique(w, return_inverse=True)
        yield int(target[a]), pack(h[v[new]], each, h[own], place.astype(np.uint32), c), pack(m, doc[a:b])


def _count_bucket(u: Unigrams, spool: Spool, keep_pairs: bool) -> Iterator[dict]:
    """From the blocks of a bucket: rows of the kinds ``sums``, ``histories``, ``unseen``, ``counts`` (and ``pairs``)."""
    heads, sizes = [], []
    for _, _, pairs, _ in spool:
        v, each, own, place, c = unpack(pairs)
        heads.append((np.repeat(v, each), own[place], c))
        sizes.append(len(place))
    v, w, c = (np.concatenate(x) for x in zip(*heads, strict=True))
    heads.clear()
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    pair = np.empty(len(v), np.int64)
    pair[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    c = np.add.reduceat(c[order], start, dtype=np.int64)
    v, w = v[start], w[start]
    del order, new

    own, place = np.unique(w, return_inverse=True)
    cw = np.bincount(place, weights=c).astype(np.int64)
    for word, known in u.hot.items():
        at = int(np.searchsorted(own, np.uint64(word)))
        if at < len(own) and own[at] == word:
            cw[at] = known
    pw = u.p(cw)[place]
    cw = cw[place]
    seen = c > 0
    term = np.log10(np.where(seen, np.where(c <= K, np.maximum(c, 1), c - SLIVER), pw))
    term -= np.where((w != END) & (cw > 0), np.log10(np.maximum(cw, 1)), 0.0)  # the word is the next token's history
    base, known = np.log10(cw + 1.0), cw > 0
    kind = np.where(c <= K, c, 0)
    yield {"kind": "counts", "data": pack(np.bincount(np.minimum(c, K + 2), minlength=K + 3).astype(np.int64))}

    late: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    for (split, docs, _, places), n in zip(spool, sizes, strict=True):
        m, doc = unpack(places)
        e = np.repeat(pair[at : at + n], m)
        at += n
        kinds = np.bincount(doc.astype(np.int64) * (K + 1) + kind[e], minlength=docs * (K + 1)).reshape(docs, K + 1)
        sums = [np.bincount(doc, term[e], docs), np.bincount(doc, base[e], docs)]
        yield {"kind": "sums", "split": split, "data": pack(*sums, np.bincount(doc, known[e], docs).astype(np.uint32), *[kinds[:, k].astype(np.uint32) for k in range(1, K + 1)])}
        out = ~seen[e]
        late.append((v[e[out]], np.full(out.sum(), split, np.int64), doc[out]))

    lv, split, doc = (np.concatenate(x) for x in zip(*late, strict=True))
    for target, part in _dealt(u.history_targets(lv, split + doc)):
        yield {"kind": "unseen", "target": target, "data": pack(lv[part], split[part], doc[part])}
    v, c, pw = v[seen], c[seen], pw[seen]
    del late, lv, split, doc, pair, kind, term, base, known, place
    if keep_pairs:
        w = w[seen]
        for at in range(0, len(v), 400_000):
            part = slice(at, at + 400_000)
            yield {"kind": "pairs", "data": pack(v[part], w[part], c[part].astype(np.uint32))}
    if len(v):
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        by = [np.add.reduceat((c == k).astype(np.uint32), start, dtype=np.uint32) for k in range(1, K + 1)]
        big = c > K
        by += [np.add.reduceat(big.astype(np.uint32), start, dtype=np.uint32), np.add.reduceat(np.where(big, c, 0), start)]
        mass = np.add.reduceat(pw, start)
        v = v[start]
        hot = np.isin(v, np.array(sorted(u.first), np.uint64))
        for target, part in _dealt(u.bucket(v)):
            cold = part[~hot[part]]
            if len(cold):
                yield {"kind": "histories", "target": target, "data": pack(v[cold], mass[cold], *[x[cold] for x in by])}
        for k in np.flatnonzero(hot).tolist():  # a hot history is known in each of its buckets
            first, parts = u.first[int(v[k])]
            for target in range(first, first + parts):
                yield {"kind": "histories", "target": target, "data": pack(v[k : k + 1], mass[k : k + 1], *[x[k : k + 1] for x in by])}


def _dealt(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(target[order]) != 0, [True]))) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(target[order[a]]), order[a:b]


def backoff_weights(blocks: Iterator[list[np.ndarray]], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories in order, their counts, and alpha(v) c(v), from the partial sums of all buckets."""
    parts = list(blocks)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    v, mass, *by = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(v, kind="stable")
    v = v[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    mass = np.add.reduceat(mass[order], start)
    by = [np.add.reduceat(x[order], start, dtype=np.int64) for x in by]
    c = sum(k * by[k - 1] for k in range(1, K + 1)) + by[K + 1]
    left = sum((1 - d[k]) * k * by[k - 1] for k in range(1, K + 1)) + SLIVER * by[K]
    return v[start], c, left / np.maximum(1 - mass, 1e-300)


_SCHEMA = "kind string, target int, split long, data binary"


def _record(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], list(kinds))


_COLUMNS = {"kind": pa.string(), "target": pa.int32(), "split": pa.int64(), "data": pa.binary()}


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, keep_pairs: bool = True, folder: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows where ``held`` is true are scored but not learned from. The pair counts are stored too, unless ``keep_pairs`` is false, as
    the kind ``pairs`` of the table ``parts`` below ``folder``; see ``stored_model``.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), (held_out(id_col) if held is None else held).alias("held"), F.col(text_col).alias("text"))
    kind_of_id = dict(rows.dtypes)["doc_id"]
    grams = stash(_unigrams(rows, chunk_tokens), folder, "unigrams")
    tally = grams.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, K + 2)], F.sum("c").alias("total"), F.sum("n").alias("all"), F.count_if(F.col("c") > 0).alias("known"), F.max(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))).alias("docs")).first()
    hot = {int(np.int64(r["h"]).view(np.uint64)): (r["c"], r["n"]) for r in grams.filter(F.col("n") > bucket_tokens // 2).collect()}  # at most 2 * all / bucket_tokens words
    buckets = max(LEAST_BUCKETS, -(-(tally["all"] or 0) // bucket_tokens))
    parts_of = {h: -(-2 * n // bucket_tokens) for h, (_, n) in hot.items()}
    if hot.get(int(END)):
        parts_of[int(START)] = parts_of[int(END)]  # as many texts begin as end; it is a history only
    u = Unigrams(tally["total"] or 0, tally["known"], [tally[f"n{k}"] for k in range(1, K + 2)], tally["docs"] or 0, {h: c for h, (c, _) in hot.items()}, buckets, parts_of)
    shared = spark.sparkContext.broadcast(u)
    wide = {"target": pa.int32(), "split": pa.int64(), "docs": pa.int64(), "pairs": pa.binary(), "places": pa.binary()}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared.value, TaskContext.get().partitionId() << 24
        for k, chunk in enumerate(_chunks(batches, chunk_tokens)):
            about = pickle.dumps((chunk.ids, chunk.held, [len(p) + 1 for p in chunk.parts]))
            yield _record([{"target": (own + k) % model.targets, "split": own + k, "docs": -1, "places": about}], wide)
            for target, pairs, places in _scatter(model, chunk):
                yield _record([{"target": target, "split": own + k, "docs": len(chunk.ids), "pairs": pairs, "places": places}], wide)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spools: dict[int, Spool] = defaultdict(Spool)
        for batch in batches:
            for r in batch.to_pylist():
                if r["docs"] < 0:
                    yield _record([{"kind": "docs", "split": r["split"], "data": r["places"]}], _COLUMNS)
                else:
                    spools[r["target"]].add((r["split"], r["docs"], r["pairs"], r["places"]))
        for spool in spools.values():
            for row in _count_bucket(shared.value, spool, keep_pairs):
                yield _record([row], _COLUMNS)
            spool.close()

    scattered = rows.mapInArrow(scatter, "target int, split long, docs long, pairs binary, places binary").repartitionById(u.targets, "target")
    parts = stash(scattered.mapInArrow(gather, _SCHEMA), folder, "parts", ["kind"])
    d = discounts(counts_of_counts(parts))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = defaultdict(list)
        late: dict[int, Spool] = defaultdict(Spool)
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == "histories":
                    known[r["target"]].append(unpack(r["data"]))
                else:
                    late[r["target"]].add((r["data"],))
        for target, spool in late.items():
            v, _, weight = backoff_weights(iter(known.pop(target, [])), d)
            for (data,) in spool:
                h, split, doc = unpack(data)
                at = np.minimum(np.searchsorted(v, h), max(0, len(v) - 1))
                found = v[at] == h if len(v) else np.zeros(len(h), bool)
                h, split, doc, at = h[found], split[found], doc[found], at[found]
                gain = np.log10(weight[at])
                for one in np.unique(split).tolist():
                    who = split == one
                    place, number = np.unique(doc[who], return_inverse=True)
                    yield _record([{"kind": "weights", "split": one, "data": pack(place, np.bincount(number, gain[who]))}], _COLUMNS)
            spool.close()

    weighed = parts.filter("kind IN ('histories', 'unseen')").select("kind", "target", "split", "data").repartitionById(u.targets, "target").mapInArrow(weigh, _SCHEMA)
    logs = np.log10(d[1:])
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk by chunk, as rows come in the order of chunks: one chunk's sums are held at a time."""
        model = shared.value
        records = ((r["split"], r) for batch in batches for r in batch.to_pylist())
        for _, own in groupby(records, key=lambda x: x[0]):
            about, sums, late = None, None, []
            for _, r in own:
                if r["kind"] == "docs":
                    about = pickle.loads(r["data"])
                elif r["kind"] == "weights":
                    late.append(unpack(r["data"]))
                else:
                    term, base, n, *kinds = unpack(r["data"])
                    part = np.stack((term + sum(k * x for k, x in zip(kinds, logs, strict=True)), base, n))
                    sums = part if sums is None else sums + part
            ids, held, size = about
            for place, gain in late:
                sums[0][place] += gain
            term, base, n = sums
            size = np.array(size, np.int64)
            if model.docs:
                term = term - np.log10(model.docs)  # the start mark is the first token's history
            base = base - size * np.log10(model.total + model.known + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(held), pa.array(size), pa.array(n.astype(np.int64)), pa.array(np.full(len(size), model.total, np.int64)), pa.array(base), pa.array(term)], names)

    meet = parts.filter("kind IN ('docs', 'sums')").select("kind", "target", "split", "data").unionByName(weighed).repartition("split").sortWithinPartitions("split", "kind")
    return meet.mapInArrow(together, f"doc_id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def counts_of_counts(parts: DataFrame) -> list[int]:
    """How many pairs have counts 1 to K + 1: a few numbers from each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [unpack(x)[0] for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(1, K + 2)], [f"n{k}" for k in range(1, K + 2)])

    counted = parts.filter("kind = 'counts'").select("data").mapInArrow(run, ", ".join(f"n{k} long" for k in range(1, K + 2)))
    row = counted.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(1, K + 2)]).first()
    return [int(x) for x in row]


def stored_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored tables as rows: ``unigrams(h, c, n)``, ``pairs(v, w, c)`` and ``histories(v, mass, n1.., n_more, c_more)`` (partial sums)."""
    parts = spark.read.parquet(f"{folder}/parts")

    def rows(kind: str, names: list[str], types: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.float64 if a.dtype.kind == "f" else np.int64)) for a in unpack(data)], names)

        return parts.filter(F.col("kind") == kind).select("data").mapInArrow(run, types)

    more = [*[f"n{k}" for k in range(1, K + 1)], "n_more", "c_more"]
    return {
        "unigrams": spark.read.parquet(f"{folder}/unigrams"),
        "pairs": rows("pairs", ["v", "w", "c"], "v long, w long, c long"),
        "histories": rows("histories", ["v", "mass", *more], "v long, mass double, " + ", ".join(f"{c} long" for c in more)),
    }


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
