"""Near copies of embeddings by an epsilon grid order join.

Cosine of at least t is a distance of at most epsilon = sqrt(2 - 2t) between unit vectors. Unit vectors are projected on
their leading principal directions, which brings no two of them further apart, and sorted by the cells of a grid of width
epsilon there (the epsilon grid order). The sequence is cut into blocks, and joined with itself by recursion over
intervals: the whole sequence with itself, then intervals of blocks with each other, ``fan`` to a level. A pair of intervals whose
boxes or balls are provably further apart than epsilon is skipped with all below it. A pair that is provably nearer than epsilon
in its whole extent needs no comparison either: all its vectors are linked, so their numbers are added and one link for each
vector is kept. What is left at the level of blocks is compared, again by intervals of ``LEAF`` rows, in double precision.

Scale: equal vectors become one node with a weight first. Nodes are range-partitioned by cell and digest, so that no cell, however
full, goes to one task. The recursion is an equi join of interval numbers for each level; never a cross join. A block meets its
partners in slices of ``SLICE`` blocks, so one task holds one block and streams the others, whatever the number of partners. Links are
reduced to a spanning forest where they are found; pairs are never emitted. A dense group of near copies costs comparisons only at its
rim. Random vectors of many dimensions defeat any grid: then the number of block pairs grows with the square of the blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component.
Vectors of different length never link. Repeated ids are rows of their own and count as others; the component is named by the smallest
non-null id in it; a null id is kept if its component has no other id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, shared_folder, stash, table
from .components import components
from .rotation import matrix, principal, sound

THRESHOLD = 0.95
LEADING = 8
BLOCK, LEAF, FAN, SLICE = 8192, 128, 8, 16
_MARGIN = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so that no square runs over."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nodes(rows: DataFrame, epsilon: float, dim: int, leading: int, directions: np.ndarray) -> DataFrame:
    """``row_id, key, dim, vec, at, cell``: digest and unit vector, its leading coordinates and their cell.

    Vectors of other lengths than ``dim`` are projected on their first components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("vec").value_lengths())
            for d in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == d))
                u = unit(matrix(own.column("vec"), d))
                at = np.zeros((len(u), leading))
                rot = directions if d == dim else np.eye(d)[:, :leading]
                at[:, : rot.shape[1]] = u @ rot
                raw = [r.tobytes() for r in u]
                cells = pa.array(np.floor(at / epsilon).astype(np.int32).tolist(), pa.list_(pa.int32()))
                keys = pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column("row_id"), keys, pa.array(np.full(len(u), d, np.int32)), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in at], pa.binary()), cells],
                    ["row_id", "key", "dim", "vec", "at", "cell"],
                )

    return rows.mapInArrow(run, f"row_id {dict(rows.dtypes)['row_id']}, key binary, dim int, vec binary, at binary, cell array<int>")


def _number(nodes: DataFrame, block: int) -> DataFrame:
    """``nodes`` in grid order with ``pid, k, i``: partition, block in it, place in the block. Blocks end where the length changes."""
    kinds = dict(nodes.dtypes)
    ordered = nodes.repartitionByRange("dim", "cell", "key").sortWithinPartitions("dim", "cell", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k, i, last = TaskContext.get().partitionId(), -1, block, None
        for batch in batches:
            ks, places = [], []
            for d in batch.column("dim").to_pylist():
                if i == block or d != last:
                    k, i, last = k + 1, 0, d
                ks.append(k)
                places.append(i)
                i += 1
            extra = [pa.array([pid] * batch.num_rows, pa.int32()), pa.array(ks, pa.int32()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "pid", "k", "i"])

    return ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in nodes.columns) + ", pid int, k int, i int")


def _summaries(numbered: DataFrame, leading: int) -> DataFrame:
    """One row per block, found by one pass over the ordered table: box, ball, weight and first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done() -> pa.RecordBatch:
            u, at = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            centre, far = u.mean(0), 10.0 * u.shape[1]
            radius = float(np.sqrt(((u - centre) ** 2).sum(1).max()))
            row = [*last, [far, *at.min(0)], [far, *at.max(0)], centre.tolist(), radius, sum(h[2] for h in held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        doubles = pa.list_(pa.float64())
        names, kinds = ["pid", "k", "lo", "hi", "centre", "radius", "weight"], [pa.int32(), pa.int32(), doubles, doubles, doubles, pa.float64(), pa.int64()]
        for batch in batches:
            pid, k, dim, weight = (batch.column(c).to_numpy() for c in ("pid", "k", "dim", "weight"))
            vec, at = batch.column("vec").to_pylist(), batch.column("at").to_pylist()
            cuts = np.flatnonzero((pid[1:] != pid[:-1]) | (k[1:] != k[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if last != (pid[a], k[a]) and held:
                    yield done()
                last = (int(pid[a]), int(k[a]))
                held.append((np.frombuffer(b"".join(vec[a:b])).reshape(b - a, dim[a]), np.frombuffer(b"".join(at[a:b])).reshape(b - a, leading), int(weight[a:b].sum())))
        if held:
            yield done()

    # blocks are bounded, so a task holds one at a time
    ordered = numbered.select("pid", "k", "i", "dim", "weight", "vec", "at").repartition("pid", "k").sortWithinPartitions("pid", "k", "i")
    return ordered.mapInArrow(run, "pid int, k int, lo array<double>, hi array<double>, centre array<double>, radius double, weight long")


def _apart(a: str, b: str) -> Column:
    """Distance of two centres; null where their lengths differ."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _levels(blocks: DataFrame, fan: int, count: int, folder: str) -> list[DataFrame]:
    """Intervals of the sequence, ``(n, lo, hi, centre, radius, weight, rep)``: level 0 has the blocks, the last one interval."""
    levels = [blocks.select("n", "lo", "hi", "centre", "radius", "weight", "rep")]
    width = len(levels[0].select("lo").first()[0])
    while count > 1:
        below = levels[-1].withColumn("up", F.expr(f"n div {fan}"))
        box = [F.array(*(f(F.col(c)[j]) for j in range(width))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
        rough = below.groupBy("up").agg(*box, F.sum("weight").alias("weight"), F.min("rep").alias("rep"), F.min_by("centre", "n").alias("middle"))
        reach = below.join(rough.select("up", "middle"), "up").groupBy("up").agg(F.max(F.coalesce(_apart("centre", "middle"), F.lit(4.0)) + F.col("radius")).alias("radius"))
        level = rough.join(reach, "up").select(F.col("up").alias("n"), "lo", "hi", F.col("middle").alias("centre"), "radius", "weight", "rep")
        count = -(-count // fan)
        levels.append(stash(level, folder, f"level{len(levels)}"))
    return levels


def _judge(pairs: DataFrame, level: DataFrame, epsilon: float) -> DataFrame:
    """``pairs(a, b)`` of intervals that may hold links, with ``near``: all their vectors are linked."""
    side = lambda s: level.select(*(F.col(c).alias(s + c) for c in level.columns))
    both = pairs.join(side("a_"), F.col("a") == F.col("a_n")).join(side("b_"), F.col("b") == F.col("b_n"))
    gap = F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    box = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    centres = _apart("a_centre", "b_centre")
    reach = F.col("a_radius") + F.col("b_radius")
    least = F.greatest(box, F.coalesce(centres - reach, F.lit(0.0)))
    near = F.coalesce(centres + reach, F.lit(9.0)) <= epsilon - _MARGIN
    same_length = (F.col("a_lo")[0] == F.col("b_hi")[0]) & (F.col("a_hi")[0] == F.col("b_lo")[0])
    return both.filter(least <= epsilon + _MARGIN).select("a", "b", (near & same_length).alias("near"), "a_weight", "b_weight", "a_rep", "b_rep")


def _recurse(levels: list[DataFrame], fan: int, count: int, epsilon: float, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of blocks to be compared, and for each level its pairs of intervals that are linked as a whole."""
    spark = levels[0].sparkSession
    pairs, wholes = spark.createDataFrame([(0, 0)], "a long, b long"), []
    for depth in range(len(levels) - 1, -1, -1):
        judged = stash(_judge(pairs, levels[depth], epsilon), folder, f"pairs{depth}")
        wholes.append(judged.filter("near").withColumn("depth", F.lit(depth)))
        pairs = judged.filter("NOT near").select("a", "b")
        if depth:
            last = -(-count // fan ** (depth - 1)) - 1
            below = lambda c: F.explode(F.sequence(F.col(c) * fan, F.least(F.col(c) * fan + (fan - 1), F.lit(last))))  # noqa: E731, B023
            pairs = pairs.withColumn("c", below("a")).withColumn("d", below("b")).filter("c <= d").select(F.col("c").alias("a"), F.col("d").alias("b"))
    return pairs, wholes


class _Own:
    """One block, against which rows of other blocks (and its own) are compared."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, u: np.ndarray, at: np.ndarray, threshold: float, epsilon: float):
        self.node, self.weight, self.u, self.threshold, self.epsilon = node, weight.astype(np.float64), u, threshold, epsilon
        self.starts = list(range(0, len(u), LEAF))
        self.lo = np.array([at[s : s + LEAF].min(0) for s in self.starts])
        self.hi = np.array([at[s : s + LEAF].max(0) for s in self.starts])
        self.label = np.arange(len(u))
        self.count = np.zeros(len(u))

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))

    def _leaves(self, at: np.ndarray) -> np.ndarray:
        """The block's own rows in intervals that may hold partners of ``at``."""
        gap = np.maximum(np.maximum(self.lo - at.max(0), at.min(0) - self.hi), 0)
        near = np.flatnonzero((gap * gap).sum(1) <= (self.epsilon + _MARGIN) ** 2)
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(self.starts[x], min(self.starts[x] + LEAF, len(self.u))) for x in near)])

    def meet(self, node: np.ndarray, weight: np.ndarray, u: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare with rows of another block; both sides gain."""
        for s in range(0, len(u), LEAF):
            part = slice(s, s + LEAF)
            rows = self._leaves(at[part])
            linked = self.u[rows] @ u[part].T >= self.threshold
            if not linked.any():
                continue
            self.count[rows] += linked @ weight[part].astype(np.float64)
            a, b = np.nonzero(linked)
            first = linked.argmax(0)
            self._union(rows[a], rows[first[b]])
            found = np.flatnonzero(linked.any(0))
            yield _counted(node[part][found], self.weight[rows] @ linked[:, found], self.node[rows[first[found]]])

    def within(self, node: np.ndarray, weight: np.ndarray, u: np.ndarray, at: np.ndarray) -> None:
        """Compare consecutive rows of the block with the whole block; they gain what they are linked with, themselves included."""
        begin = int(np.flatnonzero(self.node == node[0])[0])
        for s in range(0, len(u), LEAF):
            rows = self._leaves(at[s : s + LEAF])
            mine = np.arange(begin + s, begin + min(s + LEAF, len(u)))
            linked = (self.u[rows] @ u[s : s + LEAF].T >= self.threshold) | (rows[:, None] == mine[None])
            self.count[mine] += self.weight[rows] @ linked
            a, b = np.nonzero(linked)
            self._union(rows[a], mine[b])

    def rest(self) -> pa.RecordBatch:
        some = np.flatnonzero((self.count > 0) | (self.label != np.arange(len(self.label))))
        return _counted(self.node[some], self.count[some], self.node[self.label[some]])


def _counted(node: np.ndarray, n: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.rint(n).astype(np.int64)), pa.array(root)], ["node", "n", "root"])


def _compare(pairs: DataFrame, rows: DataFrame, leading: int, threshold: float, epsilon: float) -> DataFrame:
    """``(node, n, root)`` for pairs of blocks ``(a, b)``: what a node gains in linked rows, and a node that it is connected with."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), "b")
    own = dealt.select("a", "slice").distinct().select("a", "slice", F.lit(-1).cast("long").alias("b"), F.col("a").alias("n"))
    sides = own.unionByName(dealt.select("a", "slice", "b", F.col("b").alias("n")))
    shipped = sides.join(rows, "n").select("a", "slice", "b", "i", "node", "weight", "dim", "vec", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block: _Own | None = None
        key = None
        for batch in batches:
            a, s, b, dim, node, weight = (batch.column(c).to_numpy() for c in ("a", "slice", "b", "dim", "node", "weight"))
            vec, at = batch.column("vec").to_pylist(), batch.column("at").to_pylist()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (b[1:] != b[:-1])) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if x == y:
                    continue
                got = (node[x:y], weight[x:y], np.frombuffer(b"".join(vec[x:y])).reshape(y - x, dim[x]), np.frombuffer(b"".join(at[x:y])).reshape(y - x, leading))
                if (a[x], s[x]) != key:
                    if block:
                        yield block.rest()
                    key, block, held = (a[x], s[x]), None, []
                if b[x] < 0:
                    held.append(got)
                    continue
                if block is None:
                    block = _Own(*(np.concatenate(c) for c in zip(*held, strict=True)), threshold, epsilon)
                    held = []
                if b[x] != a[x]:
                    yield from block.meet(*got)
                else:
                    block.within(*got)
        if block:
            yield block.rest()

    return shipped.repartition("a", "slice").sortWithinPartitions("a", "slice", "b", "i").mapInArrow(run, "node long, n long, root long")


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, leading: int = LEADING, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per row of ``vectors``: ``<id_col>, n_links, component_id, kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    epsilon = max(sqrt(2 - 2 * threshold), 1e-6)
    folder = shared_folder(vectors.sparkSession)
    vec = F.col(vec_col)
    usable = sound(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.filter(usable).select(F.col(id_col).alias("row_id"), vec.alias("vec"))
    alone = vectors.filter(~usable).select(F.col(id_col).alias("row_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return _named(alone, id_col)
    _, directions = principal(rows.filter(F.size("vec") == common.dim), "vec", common.dim, leading, unit)
    placed = stash(_nodes(rows, epsilon, common.dim, leading, directions), folder, "placed")
    weighed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("row_id").alias("row_id"), *(F.any_value(c).alias(c) for c in ("dim", "vec", "at", "cell")))
    numbered = stash(_number(weighed, block), folder, "numbered")
    per_part = numbered.groupBy("pid").agg((F.max("k") + 1).alias("blocks")).orderBy("pid").collect()  # one row per partition
    ends = np.cumsum([r.blocks for r in per_part])
    base = vectors.sparkSession.createDataFrame([(r.pid, int(e) - r.blocks) for r, e in zip(per_part, ends, strict=True)], "pid int, base long")
    count = int(ends[-1])
    rank = F.col("base") + F.col("k")
    node = lambda n, i: n * block + i
    blocks = stash(_summaries(numbered, leading).join(F.broadcast(base), "pid").withColumn("n", rank).withColumn("rep", node(F.col("n"), F.lit(0))), folder, "blocks")
    ranked = numbered.join(F.broadcast(base), "pid").withColumn("n", rank).withColumn("node", node(F.col("n"), F.col("i")))
    levels = _levels(blocks, fan, count, folder)
    pairs, wholes = _recurse(levels, fan, count, epsilon, folder)
    found = stash(_compare(pairs, ranked.select("n", "i", "node", "weight", "dim", "vec", "at"), leading, threshold, epsilon), folder, "found")
    gains, links = [found.select("node", "n")], [found.select(F.col("node").alias("a"), F.col("root").alias("b"))]
    near = reduce(DataFrame.unionByName, wholes)
    if not near.isEmpty():
        links.append(near.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
        sides = near.select("depth", F.col("a").alias("up"), F.col("b_weight").alias("gain"), F.col("b_rep").alias("other"))
        sides = sides.unionByName(near.filter("a <> b").select("depth", F.col("b").alias("up"), F.col("a_weight").alias("gain"), F.col("a_rep").alias("other")))
        gained = sides.groupBy("depth", "up").agg(F.sum("gain").alias("gain"), F.min("other").alias("other"))
        tops = blocks.select("n", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))).alias("depth")).withColumn("up", F.floor(F.col("n") / F.pow(F.lit(fan), F.col("depth"))).cast("long"))
        leaves = tops.join(gained, ["depth", "up"])
        links.append(leaves.select(node(F.col("n"), F.lit(0)).alias("a"), F.col("other").alias("b")))
        per_block = stash(leaves.groupBy("n").agg(F.sum("gain").alias("gain"), F.min("other").alias("other")), folder, "whole_blocks")
        joined = ranked.select("n", "node").join(per_block, "n")
        gains.append(joined.select("node", F.col("gain").alias("n")))
        links.append(joined.select(F.col("node").alias("a"), F.col("other").alias("b")))
    total = reduce(DataFrame.unionByName, gains).groupBy("node").agg((F.sum("n") - 1).alias("n_links"))
    roots = components(reduce(DataFrame.unionByName, links), folder)
    known = ranked.select("node", "key", "weight", "row_id").join(total, "node")
    known = known.withColumn("root", F.col("node")) if roots is None else known.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stash(known, folder, "known")
    names = known.groupBy("root").agg(F.min("row_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    classes = stash(join_counted(known, names, "root", "size").select("key", "weight", "n_links", "component_id"), folder, "classes")
    mine = join_counted(placed.select("row_id", "key"), classes, "key", "weight").select("row_id", "n_links", "component_id")
    return _named(mine.unionByName(alone), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("row_id").alias(id_col), "n_links", "component_id", F.col("row_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """The ids that stay: the smallest of each component."""
    return linked_vectors(vectors, id_col, vec_col, threshold).filter("kept").select(id_col).distinct()


def op13_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
good AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id <= coalesce(m, v.vec_id) AS kept
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)"""
