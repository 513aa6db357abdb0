"""Near duplicates by SimHash fingerprints, compared at the anchors of a covering code.

A fingerprint has 64 bits, and two of them link at 3 or fewer differing bits. Of two linked fingerprints at least one
32-bit half differs in at most one bit. On 31 bits of each half the code words of the perfect [31, 26] Hamming code
are the anchors: covering radius 1, so each half has exactly one anchor within the radius, its home, and a linked
partner lies within radius + 1 = 2 of that home. Each distinct fingerprint is therefore replicated to every anchor
within 2 of each half (16 at most), and every link is found at the home anchor of one of its ends.

Scale: only distinct fingerprints are replicated (copies collapse first), 32 narrow rows each at most, over 2^27
anchors. Anchors with one member go before any comparison. An anchor with more members than one task should hold is
cut into blocks, and each pair of blocks is compared in a task of its own, so that memory is bounded and no link is
lost. Inside a group a spanning forest of the links is emitted, never all pairs.

Defined results: null and blank texts have fingerprint zero and link like any other; repeated rows share a fingerprint;
the component is named by the smallest non-null id in it (null if it has none); other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, row_key, shared_folder, stash, table, unique_ids
from .components import components

THRESHOLD = 3
SHINGLE = 3
BLOCK = 8192
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 18


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint: a bit is set if it is set in over half the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, unique: bool, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(row_key, doc_id, fp)``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(fps.view(np.int64))], ["row_key", "doc_id", "fp"])

    rows = docs.select(row_key(unique, id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"row_key {kinds['row_key']}, doc_id {kinds['doc_id']}, fp long")


def _anchor_masks() -> str:
    """For each syndrome of the [31, 26] code: what to flip to reach the code words within 2, the home first."""
    rows = ["array(0L)"]
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        rows.append("array(" + ", ".join(f"{m}L" for m in [1 << (s - 1), *pairs]) + ")")
    return "array(" + ", ".join(rows) + ")"


def anchors(fp: Column) -> Column:
    """Array of ``(cell, home)``: the anchors that a fingerprint goes to, for both halves."""
    parity = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    masks = F.expr(_anchor_masks())
    out = []
    for half in (0, 1):
        x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(2**31 - 1))
        syndrome = sum((F.shiftleft((F.bit_count(x.bitwiseAND(F.lit(m)))).bitwiseAND(F.lit(1)), k) for k, m in enumerate(parity)), F.lit(1))
        out.append(F.transform(F.element_at(masks, syndrome), _flip(x, half << 31)))
    return F.concat(*out)


def _flip(x: Column, base: int):
    return lambda mask, i: F.struct((x.bitwiseXOR(mask) + F.lit(base)).alias("cell"), (i == 0).alias("home"))


def _forest(f: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected within the group: each member is reached once."""
    left, right, rest = [], [], f
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                todo.extend(found)
    return left, right


def _links(group: np.ndarray, f: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``; small runs are compared side by side, larger ones one by one."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    left, right = [], []
    for at, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        a, b = _forest(f[at : at + n], threshold)
        left += a
        right += b
    small = np.repeat(sizes <= 16, sizes)
    f, group = f[small], group[small]
    for d in range(1, 16):
        same = np.flatnonzero((group[d:] == group[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= threshold))
        if len(same):
            left.append(f[same])
            right.append(f[same + d])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(nodes: DataFrame, folder: str, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``nodes(fp)``, enough to connect all that is connected."""
    if threshold > 3:
        raise ValueError("two halves with anchors within 2 find links of up to 3 bits")
    placed = nodes.select("fp", F.explode(anchors(F.col("fp"))).alias("x")).select("fp", "x.cell", "x.home")
    crowd = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).filter("n > 1 AND any").select("cell", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    member = placed.join(crowd, "cell").select("cell", "fp", "nb", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int").alias("i"))
    pairs = member.select("cell", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    pairs = pairs.select("cell", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def done() -> pa.RecordBatch:
            key, f = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            a, b = _links(key, f, threshold)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        serial = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("cell", "i", "j")]
            first = (cols[0][0], cols[1][0], cols[2][0])
            new = np.concatenate(([first != last], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            key = serial + np.cumsum(new)
            serial, last = int(key[-1]), tuple(c[-1] for c in cols)
            f = batch.column("fp").to_numpy().view(np.uint64)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if new.any():
                held.append((key[:cut], f[:cut]))
                yield done()
            held.append((key[cut:], f[cut:]))
        if held:
            yield done()

    dealt = pairs.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return stash(dealt.mapInArrow(run, "a long, b long"), folder, "links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, stays, row_key``."""
    folder = shared_folder(docs.sparkSession)
    unique = unique_ids(docs, id_col)
    prints = stash(fingerprints(docs, unique, id_col, text_col, width), folder, "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    nodes = stash(prints.groupBy("fp").agg(F.min(first).alias("first")), folder, "nodes")
    roots = components(links(nodes.select("fp"), folder, threshold, block), folder)
    if roots is None:
        named = nodes.select("fp", F.col("first").alias("rep"))
    else:
        rooted = nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        reps = rooted.groupBy("root").agg(F.min("first").alias("rep"))
        named = rooted.join(reps, "root").select("fp", "rep")
    out = prints.join(named, "fp")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("rep.doc_id").alias("component_id"),
        (F.col("row_key") == F.col("rep.row_key")).alias("stays"),
        "row_key",
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id."""
    keys = near_classes(docs, id_col, text_col, threshold).filter("stays").select("row_key")
    return keep_rows(docs, keys.distinct(), unique_ids(docs, id_col), id_col, text_col)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
