"""Language identification by error-correcting output codes.

Each language has a codeword of bits: all distinct splits of the languages for up to five of them, else a random code with
the widest least distance of many seeded draws. For each bit a binary logistic classifier on hashed byte n-grams (1 to
3) of the lower-cased text predicts its value. Decoding is loss-weighted: each language's loss is the sum over bits of
the logistic loss of the margin against its codeword, weighted by how well the bit was learned on that language; the
nearest codeword wins. A prediction is flagged ambiguous if the runner-up's loss is within ``AMBIGUOUS`` of the best.

Training takes a bounded sample: at most ``PER_LANGUAGE`` different labelled rows of each language, the first in the order of
a seeded hash of id and text, the same at every partitioning, also where ids repeat or are null. Languages, source and ids are never inputs of a prediction.

Scale: features of the sample are made by Spark, and the model (bits x buckets) is fitted on at most ``PER_LANGUAGE``
rows per language; scoring is one narrow pass over whole texts without a shuffle. A language with a third of all rows is
thinned by hash before it is ranked, so no task gathers it.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with null language are scored but
not learned from; with one learned language that one is predicted with score 1; with none all are ``und``; repeated
rows are scored alike; other columns are ignored; empty tables are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stash, table

PER_LANGUAGE = 600
BUCKETS = 2048
MAX_LANGUAGES = 512
AMBIGUOUS = 0.5
ROUNDS = 150
SEED = 6
#: ASCII that is no letter becomes a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def vector(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the hashed n-gram shares, of length 1."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    c = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = (c[:-1] << np.uint32(8)) | c[1:]
    three = (two[:-1] << np.uint32(8)) | c[2:]
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    grams = np.concatenate((c * np.uint32(2654435761), (two + np.uint32(1 << 24)) * np.uint32(2246822519), (three + np.uint32(1 << 28)) * np.uint32(3266489917)))
    v = np.sqrt(np.bincount(grams >> shift, minlength=buckets).astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codebook(n: int, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 for each of ``n`` languages."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        return np.array([[1 if k == 0 or not b >> (k - 1) & 1 else -1 for b in range(1, 2 ** (n - 1))] for k in range(n)], np.int8)
    draw, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(n)))
    least = -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, width))
        if (np.abs(code.astype(int).sum(axis=0)) == n).any():
            continue
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2 + width * np.eye(n, dtype=int)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


class Model:
    """Languages, codewords, weights of the bits' classifiers and the decoding weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, seed: int = SEED):
        self.languages = languages
        self.code = codebook(len(languages), seed)
        if self.code.shape[1] == 0:
            return
        target = self.code[y].astype(np.float32)
        self.w, self.b = _fit(x, target)
        # how well each bit was learned on each language: the mean logistic probability of the right value, each half by a model of the other
        half = np.arange(len(x)) % 2 == 0
        right = np.zeros_like(target)
        for out in (half, ~half):
            w, b = _fit(x[~out], target[~out]) if (~out).any() else (self.w, self.b)
            right[out] = (x[out] @ w + b) * target[out]
        sure = 1 / (1 + np.exp(-right))
        held = np.stack([sure[y == k].mean(axis=0) if (y == k).any() else np.ones(target.shape[1]) for k in range(len(languages))])
        self.weight = held / held.sum(axis=1, keepdims=True)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the likelihood, the runner-up, and the gap of their losses."""
        n = len(x)
        if len(self.languages) < 2:
            return np.zeros(n, int), np.ones(n), np.zeros(n, int), np.full(n, np.inf)
        margin = x @ self.w + self.b
        loss = (self.weight[None] * np.logaddexp(0, -margin[:, None, :] * self.code[None])).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = order[:, 0], order[:, 1]
        z = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        at = np.arange(n)
        return best, z[at, best] / z.sum(axis=1), second, loss[at, second] - loss[at, best]


def _fit(x: np.ndarray, target: np.ndarray, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights for all bits at once by accelerated gradient steps."""
    n = len(x)
    x1 = np.concatenate((x, np.ones((n, 1), np.float32)), axis=1)
    w = np.zeros((x1.shape[1], target.shape[1]), np.float32)
    ahead, before, rate = w.copy(), w.copy(), 2.0
    for k in range(ROUNDS):
        slope = -(x1.T @ (target / (1 + np.exp(np.clip(target * (x1 @ ahead), -30, 30))))) / n + l2 * ahead
        w = ahead - rate * slope
        ahead, before = w + k / (k + 3) * (w - before), w
    return w[:-1], w[-1]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, seed: int = SEED, max_languages: int = MAX_LANGUAGES) -> Model:
    """The model learned from ``docs``; pass only rows that may be learned from.

    Of more than ``max_languages`` values the most frequent are learned (ties by name) and no others, so that dirty labels can't break a run.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros(0, int))
    limits = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, (1.5 * per_language + 50) / max(1, counts[lang])) * 2.0**63)])
    thin = rows.filter(F.col("lang").isin(languages) & (F.col("order") <= limits[F.col("lang")]))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    picked = stash(thin.select("lang", "order").distinct().withColumn("nth", nth).filter(F.col("nth") <= per_language).groupBy("lang").agg(F.max("order").alias("last")), folder, "last")
    last = {r["lang"]: r["last"] for r in picked.collect()}
    within = F.create_map(*[F.lit(v) for lang in languages for v in (lang, last.get(lang, -1))])
    chosen = thin.filter(F.col("order") <= within[F.col("lang")]).dropDuplicates(["lang", "order"]).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t, buckets).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    found = chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, lang string, x binary").collect()  # per_language rows for each language
    found.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found])
    return Model(languages, x, np.array([languages.index(r["lang"]) for r in found]), seed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, runner_up, ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score, second, unsure = (np.full(batch.num_rows, v, t) for v, t in (("und", object), (0.0, float), (None, object), (False, bool)))
            texts = batch.column("text").to_pylist()
            who = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            for at in range(0, len(who), 500):
                part = who[at : at + 500]
                best, share, other, gap = m.decode(np.stack([vector(texts[i], buckets) for i in part]))
                lang[part], score[part], unsure[part] = [m.languages[k] for k in best], share, gap < AMBIGUOUS
                if len(m.languages) > 1:
                    second[part] = [m.languages[k] for k in other]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean")


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.filter(~held_out())))
