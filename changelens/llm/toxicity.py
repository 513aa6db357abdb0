"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of the earlier categories.

The chain runs over label columns in a stated order; in these tables ``quality`` (as its complement, low quality) comes
before ``toxic``. Each link is an L2 logistic regression on the presence of words, word beginnings (3 to 6 bytes) and
runs of symbols in the whole text, plus the probabilities of all earlier links. Later links are trained on out-of-fold
probabilities of the earlier ones (``FOLDS`` folds by crc32 of the id): for each fold both the features and the weights are
chosen on the other folds alone, so later links see errors like those of new rows.

Training takes a bounded sample: at most ``SAMPLE`` labelled rows for each value of the last category, the first in
the order of a seeded hash, so that it is the same at every size and partitioning. Features are kept if their G
statistic against the category exceeds ``MIN_G``, at most ``FEATURES`` of them, counted over the sample with Spark. The
intercepts are moved back to the label frequencies of the whole label table.

Scale: scoring is one narrow pass; documents are never shuffled, and the model is a few hundred weights.

Defined results: null and empty texts have no features and get the base probability; rows without a label or with a null
id are scored but not learned from, and rows that lack one category's label are learned from for the others (the last
category's label chooses the sample); labels other than 0 and 1 count as none; repeated label rows count once, with the
larger label; of documents with one id one is learned from; a category with one class only (or no labels) has a constant
probability of 0 (or that class); empty tables are allowed; other columns are ignored, or kept as they are by
``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stash, table
from .decontaminate import words

SAMPLE = 4000
FEATURES = 256
MIN_G = 30.0
FOLDS = 5
L2 = 0.02
SEED = 1
THRESHOLD = 0.5
PREFIXES = (3, 4, 5, 6)
_SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
#: The categories of the query, in chain order: column of ``labels``, and whether its complement is meant.
CATEGORIES = (("quality", True), ("toxic", False))


def features(text: str | None) -> set[bytes]:
    own = set(words(text))
    found = {b"=" + w for w in own}
    for k in PREFIXES:
        found.update(b"^" + w[:k] for w in own if len(w) > k)
    found.update(b"~" + s[:8] for s in _SYMBOLS.findall((text or "").encode()))
    return found


@dataclass
class Link:
    """One model of the chain: weights of features, of the earlier links' probabilities, and an intercept."""

    weights: dict[bytes, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    intercept: float = -20.0


def _probability(z: float) -> float:
    return float(1 / (1 + np.exp(-max(-20.0, min(20.0, z)))))


def scores(chain: list[Link], found: set[bytes]) -> list[float]:
    """The probabilities of all categories, in chain order."""
    out: list[float] = []
    for link in chain:
        z = link.intercept + sum(w * p for w, p in zip(link.earlier, out, strict=True))
        out.append(_probability(z + sum(link.weights[f] for f in sorted(found & link.weights.keys()))))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = L2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method; the intercept is not penalised."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x1.shape[1])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x1 @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (v * v))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (p - y) + penalty * w
        curve = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, abs(before)):
            break
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, categories, sample: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """Labelled rows ``doc_id, text, y0, y1, ...``, one for each id, and the label frequencies of the whole table."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(*[F.max(F.when(F.col(c).cast("int").isin(0, 1), F.col(c).cast("int"))).alias(f"y{k}") for k, (c, _) in enumerate(categories)])
    known = known.select("doc_id", *[(1 - F.col(f"y{k}") if flip else F.col(f"y{k}")).alias(f"y{k}") for k, (_, flip) in enumerate(categories)])
    names = [f"y{k}" for k in range(len(categories))]
    rates = known.agg(*[F.count(y).alias(f"n_{y}") for y in names], *[F.sum(y).alias(y) for y in names]).first().asDict()
    order = F.xxhash64(F.lit(seed), "doc_id")
    parts = [known.filter(F.col(names[-1]) == v).orderBy(order, "doc_id").limit(sample) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample rows of a few integers
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")  # of the documents of one id
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *names).agg(one)
    return text.select("doc_id", "text", *names, (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int").alias("fold")), rates


def _feature_counts(text: DataFrame, m: int) -> DataFrame:
    """``f, fold`` and for each category how many rows with a label, and with label 1, have the feature."""
    columns = [f"{c}{k}" for k in range(m) for c in ("n", "ones")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[tuple[int, int], Counter[bytes]] = {(fold, c): Counter() for fold in range(FOLDS) for c in range(2 * m)}

        def flush() -> Iterator[pa.RecordBatch]:
            for fold in range(FOLDS):
                own = [tallies[fold, c] for c in range(2 * m)]
                names = list(set().union(*own))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([fold] * len(names), pa.int32()), *[pa.array([c[f] for f in names], pa.int64()) for c in own]], ["f", "fold", *columns])
                for c in own:
                    c.clear()

        held = 0
        for batch in batches:
            folds, ys = batch.column("fold").to_pylist(), [batch.column(f"y{k}").to_pylist() for k in range(m)]
            for i, t in enumerate(batch.column("text")):
                found = features(t.as_py())
                held += len(found)
                for k in range(m):
                    if ys[k][i] is not None:
                        tallies[folds[i], 2 * k].update(found)
                        if ys[k][i]:
                            tallies[folds[i], 2 * k + 1].update(found)
                if held > 200_000:
                    yield from flush()
                    held = 0
        yield from flush()

    raw = text.mapInArrow(count, "f binary, fold int, " + ", ".join(f"{c} long" for c in columns))
    return raw.groupBy("f").agg(*[F.sum(F.when(F.col("fold") == fold, F.col(c)).otherwise(0)).alias(f"{c}_{fold}") for fold in range(FOLDS) for c in columns])


def _telling(counts: DataFrame, sizes: dict, k: int, out: int | None) -> list[bytes]:
    """The features that tell category ``k`` best by G, on all folds but ``out``."""
    folds = [f for f in range(FOLDS) if f != out]
    rows, ones = (sum(sizes[f"{c}{k}_{f}"] or 0 for f in folds) for c in ("n", "ones"))
    if not 0 < ones < rows:
        return []
    n, hits = (sum((F.col(f"{c}{k}_{f}") for f in folds), F.lit(0)) for c in ("n", "ones"))
    seen = counts.select("f", n.alias("n"), hits.alias("hits")).filter("n >= 5")
    g = F.lit(0.0)
    for a, of in ((F.col("hits"), ones), (F.col("n") - F.col("hits"), rows - ones)):
        expected = F.col("n") * of / rows
        g = g + F.when(a > 0, a * F.log(a / expected)).otherwise(0.0) + F.when(of - a > 0, (of - a) * F.log((of - a) / (of - expected))).otherwise(0.0)
    best = seen.withColumn("g", F.round(2 * g, 9)).filter(F.col("g") > MIN_G).orderBy(F.desc("g"), "f").limit(FEATURES)
    return [bytes(r["f"]) for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """The chain, learned from the texts of ``docs`` and the categories of ``labels``, which name rows by ``id_col``."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text, rates = _sample(docs, labels, categories, sample, seed, id_col, text_col)
    text = stash(text, folder, "sample")
    m = len(categories)
    counts = stash(_feature_counts(text, m).filter(" OR ".join("(" + " + ".join(f"n{k}_{f}" for f in range(FOLDS)) + ") >= 5" for k in range(m))), folder, "counts")
    sizes = text.agg(*[F.count(F.when(F.col("fold") == f, F.col(f"y{k}"))).alias(f"n{k}_{f}") for k in range(m) for f in range(FOLDS)], *[F.sum(F.when(F.col("fold") == f, F.col(f"y{k}"))).alias(f"ones{k}_{f}") for k in range(m) for f in range(FOLDS)]).first().asDict()
    chosen = {(k, out): _telling(counts, sizes, k, out) for k in range(m) for out in (None, *(range(FOLDS) if k < m - 1 else ()))}
    index = {f: i for i, f in enumerate(sorted(set().union(*chosen.values())))}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[f] for f in features(t) & index.keys()] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *[batch.column(f"y{k}") for k in range(m)], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "fold", *[f"y{k}" for k in range(m)], "x"])

    kind = dict(text.dtypes)["doc_id"]
    matrix = text.mapInArrow(place, f"doc_id {kind}, fold int, " + ", ".join(f"y{k} int" for k in range(m)) + ", x array<int>").collect()  # at most 2 * sample rows
    matrix.sort(key=lambda r: str(r["doc_id"]))
    x = np.zeros((len(matrix), len(index)), np.float64)
    for i, r in enumerate(matrix):
        x[i, r["x"]] = 1
    fold = np.array([r["fold"] for r in matrix], np.int64)
    chain: list[Link] = []
    earlier = np.zeros((len(matrix), 0))
    for k in range(m):
        y = np.array([-1 if r[f"y{k}"] is None else r[f"y{k}"] for r in matrix], np.int64)
        ones, n = rates[f"y{k}"] or 0, rates[f"n_y{k}"]

        def fitted(rows: np.ndarray, names: list[bytes], k=k, y=y, ones=ones, n=n, earlier=earlier) -> Link:
            """The link learned from the sample's ``rows``."""
            rows = rows & (y >= 0)
            if not rows.any() or y[rows].min() == y[rows].max():
                return Link(earlier=[0.0] * k, intercept=20.0 if rows.any() and y[rows][0] else -20.0)
            w, b = fit_logistic(np.concatenate((x[np.ix_(rows, [index[f] for f in names])], earlier[rows]), axis=1), y[rows].astype(np.float64))
            shift = np.log(ones / (n - ones)) - np.log(y[rows].mean() / (1 - y[rows].mean()))
            return Link(dict(zip(names, w[: len(names)].tolist(), strict=True)), w[len(names) :].tolist(), float(b + shift))

        chain.append(fitted(np.ones(len(y), bool), chosen[k, None]))
        if k < m - 1:
            p = np.zeros(len(y))
            for out in range(FOLDS):
                link = fitted(fold != out, chosen[k, out])
                z = link.intercept + x[:, [index[f] for f in link.weights]] @ np.array(list(link.weights.values())) + earlier @ np.array(link.earlier)
                p[fold == out] = 1 / (1 + np.exp(-np.clip(z[fold == out], -20, 20)))
            earlier = np.concatenate((earlier, p[:, None]), axis=1)
    return chain


def score(docs: DataFrame, chain: list[Link], categories=CATEGORIES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category and ``toxic``: whether the last one reaches the threshold."""
    names = [f"p_low_{c}" if flip else f"p_{c}" for c, flip in categories]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lookup(chain)
        for batch in batches:
            p = np.array([own.scores(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "toxic"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


class Lookup:
    """Finds the features that a chain has weights for; the same as intersecting ``features``, with less work."""

    def __init__(self, chain: list[Link]):
        self.chain = chain
        wanted = set().union(*[link.weights.keys() for link in chain]) if chain else set()
        self.words = {f[1:] for f in wanted if f[:1] == b"="}
        self.prefixes = {k: {f[1:] for f in wanted if f[:1] == b"^" and len(f) == k + 1} for k in PREFIXES}
        self.symbols = {f for f in wanted if f[:1] == b"~"}

    def present(self, text: str | None) -> set[bytes]:
        own = set(words(text))
        found = {b"=" + w for w in own & self.words}
        for k, of in self.prefixes.items():
            if of:
                found.update(b"^" + p for p in {w[:k] for w in own if len(w) > k} & of)
        if self.symbols:
            found |= {b"~" + s[:8] for s in _SYMBOLS.findall((text or "").encode())} & self.symbols
        return found

    def scores(self, text: str | None) -> list[float]:
        return scores(self.chain, self.present(text))


def drop_toxic(docs: DataFrame, chain: list[Link], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the chain rejects, in its own columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lookup(chain)
        for batch in batches:
            clean = [own.scores(t)[-1] < threshold for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
