"""Clustering around integer centroids with PCA-rotated filtering.

Components x become integers floor(scale * x). The vectors are rotated once onto their principal directions; of each, the
``leading`` rotated coordinates and the norm of the rest are stored beside the integers. For a vector and a centroid the
squared distance of the leading coordinates plus the squared difference of the rest norms is a lower bound of their squared
distance. Each vector is measured in integers against the centroid of the smallest bound, then against every centroid
whose bound (less a margin for rounding) does not exceed that distance; so the assignment is the exact one, and ties go to the
smaller number.

Scale: vectors are read once for the moments and once for the rotation, stored, and then read once per round in narrow
tasks. A task sends sums for each of the k clusters, which are added by cluster and component; the driver holds k centroids and
the dim x dim moments only. Nothing depends on how many vectors a cluster has.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out, as are those with
a component beyond +-2^27 after scaling, whose distances need not fit a long. Repeated ids are rows of their own; equal hashes
of ids are ordered by the vector; null ids are chosen as centroids last. With fewer vectors than k there are as many centroids
as vectors. Sums are exact (decimal); an inertia beyond a long is null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stash, table
from .rotation import matrix, principal, sound

K, ROUNDS, SEED, SCALE, DIM, LEADING = 16, 3, 1, 64, 64, 16
MAX_COMPONENT = 1 << 27
_OUT = "row_id {kind}, cluster int, distance long"


def _bounds(z: np.ndarray, zc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (rows x centroids) of leading coordinates with rest norms, and what rounding may add to them."""
    own, other = (z * z).sum(1)[:, None], (zc * zc).sum(1)[None]
    return own + other - 2 * (z @ zc.T), 1e-6 * (own + other + 1)


def nearest(q: np.ndarray, z: np.ndarray, centres: np.ndarray, zc: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each vector's nearest centroid, and how many pairs were measured in integers."""
    low, slack = _bounds(z, zc)
    low -= slack
    first = low.argmin(1)
    limit = ((q - centres[first]) ** 2).sum(1)
    survives = low <= limit[:, None]
    cluster, distance = first.astype(np.int32), limit.copy()
    for c in range(len(centres)):
        rows = np.flatnonzero(survives[:, c] & (first != c))
        d = ((q[rows] - centres[c]) ** 2).sum(1)
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < cluster[rows]))
        cluster[rows[better]], distance[rows[better]] = c, d[better]
    return cluster, distance, int(survives.sum())


def rotated(q: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Leading rotated coordinates with the norm of what they leave out as last column."""
    x = q - mean
    lead = x @ directions
    rest = np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0))
    return np.column_stack([lead, rest])


def _blobs(a: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(a).tobytes(), a.shape[1] * a.itemsize
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def _read(batch: pa.RecordBatch, name: str, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype).reshape(batch.num_rows, width)


def _rotate(kept: DataFrame, scale: int, dim: int, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.floor(scale * matrix(batch.column("vec"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), _blobs(q.astype(np.int32)), _blobs(rotated(q, mean, directions))], ["row_id", "q", "z"])

    return kept.mapInArrow(run, f"row_id {dict(kept.dtypes)['row_id']}, q binary, z binary")


def _moved(turned: DataFrame, centres: np.ndarray, zc: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floor of the mean of their vectors; those without any stay."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            q = _read(batch, "q", np.int32, dim).astype(np.int64)
            cluster, _, _ = nearest(q, _read(batch, "z", np.float64, zc.shape[1]), centres, zc)
            for c in np.unique(cluster):
                own = q[cluster == c]
                total[c] += np.append(own.sum(0), len(own))
        at = np.flatnonzero(np.repeat(total[:, -1] > 0, dim + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["i", "v"])

    sums = turned.select("q", "z").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r.i: int(r.v) for r in sums.collect()}
    moved = centres.copy()
    for c in range(k):
        if n := found.get(c * (dim + 1) + dim):
            moved[c] = [found[c * (dim + 1) + j] // n for j in range(dim)]
    return moved


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dim: int = DIM, leading: int = LEADING
) -> DataFrame:
    """One row per kept vector: ``<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    most = F.array_max(F.transform(vec, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))
    kept = vectors.filter(sound(vec) & (F.size(vec) == dim)).filter(most <= MAX_COMPONENT).select(F.col(id_col).alias("row_id"), vec.alias("vec"))
    folder = shared_folder(spark)
    name = F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))
    first = kept.select("vec", F.sha2(name, 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    kind = dict(kept.dtypes)["row_id"]
    if not first:
        digest = F.lit(None).cast("string").alias("centroid_sha256")
        none = spark.createDataFrame([], _OUT.format(kind=kind)).withColumns({c: F.lit(None).cast("long") for c in ("cluster_inertia", "inertia")})
        return none.select(F.col("row_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", digest)
    centres = np.floor(scale * np.array([r.vec for r in first], np.float64)).astype(np.int64)
    mean, directions = principal(kept, "vec", dim, leading, lambda x: np.floor(scale * x))
    turned = stash(_rotate(kept, scale, dim, mean, directions), folder, "rotated")
    for _ in range(rounds):
        centres = _moved(turned, centres, rotated(centres, mean, directions))
    zc = rotated(centres, mean, directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _read(batch, "q", np.int32, dim).astype(np.int64)
            cluster, distance, _ = nearest(q, _read(batch, "z", np.float64, zc.shape[1]), centres, zc)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(cluster), pa.array(distance)], ["row_id", "cluster", "distance"])

    out = stash(turned.mapInArrow(run, _OUT.format(kind=kind)), folder, "assigned")
    inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = spark.createDataFrame([(c, fits(d), digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    whole = F.lit(fits(sum(inertia.values()))).cast("long").alias("inertia")
    # at most k rows, whatever the input
    return out.join(F.broadcast(facts), "cluster").select(F.col("row_id").alias(id_col), "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")


def op12_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = ["""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q FROM (SELECT q, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT 16))"""]
    for r in range(4):
        steps.append(f"""a{r} AS (SELECT vec_id, q, m % 16 AS cluster, m // 16 AS distance FROM (
  SELECT vec_id, any_value(k.q) AS q, min(list_sum(list_transform(list_zip(k.q, c.q), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * 16 + cluster) AS m FROM kept k, c{r} c GROUP BY vec_id))""")
        if r < 3:
            steps.append(f"""s{r} AS (SELECT cluster, dim, sum(v) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS v, unnest(range(64)) AS dim FROM a{r}) GROUP BY cluster, dim),
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS q FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a3 a JOIN c3 c USING (cluster)"""


OP12_SQL = _sql()
