import hashlib
import math

import numpy as np

from changelens.llm.centroids import cluster_vectors, nearest, rotated

SCHEMA = "vec_id long, embedding array<double>, label int, row_id string, cluster int, q string, inertia long"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 7, "q", 9) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [q for _, q in sorted(kept, key=name)[:k]]
    nearest_to = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest_to(q)[1] for _, q in kept]
        for c in range(len(centres)):
            members = [q for (_, q), o in zip(kept, own, strict=True) if o == c]
            if members:
                centres[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [(i, *nearest_to(q)[::-1]) for i, q in kept]
    inertia = {c: sum(d for _, o, d in last if o == c) for c in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in last)


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [(i, (centres[rng.integers(5)] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_against_brute_force_with_odd_rows(spark):
    rows = vectors(1, 150, 12)
    rows += [(3, rows[3][1]), (200, None), (201, []), (202, [1.0] * 11), (203, [None] + [1.0] * 11), (204, [math.nan] * 12), (205, [math.inf] * 12)]
    rows += [(None, [0.5] * 12), (206, [0.0] * 12), (207, [-0.01] * 12), (208, [1000.0, -1000.0] * 6), *[(300 + i, [0.25] * 12) for i in range(40)]]
    got = cluster_vectors(make(spark, rows), k=6, dim=12, leading=3).collect()
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == brute(rows, 6, 3, 12)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(2, 4, 12)
    got = cluster_vectors(make(spark, rows), k=6, dim=12).collect()
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == brute(rows, 6, 3, 12)
    for none in ([], [(1, None)], [(1, [1e300] * 12)]):
        empty = cluster_vectors(make(spark, none), k=6, dim=12)
        assert empty.count() == 0
        assert empty.dtypes == cluster_vectors(make(spark, rows), k=6, dim=12).dtypes


def test_filter_spares_measurements_and_loses_none():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (16, 64))
    q = centres[rng.integers(16, size=2000)] + rng.integers(-20, 20, (2000, 64))
    directions = np.linalg.qr(rng.normal(size=(64, 64)))[0][:, :8]
    mean = q.mean(0)
    cluster, distance, measured = nearest(q, rotated(q, mean, directions), centres, rotated(centres, mean, directions))
    exact = ((q[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert measured < 0.5 * exact.size


def test_ties_go_to_the_smaller_number():
    centres = np.array([[2, 0], [0, 0], [2, 0]])
    q = np.array([[1, 0], [2, 0], [0, 0]])
    cluster, distance, _ = nearest(q, rotated(q, np.zeros(2), np.eye(2)[:, :1]), centres, rotated(centres, np.zeros(2), np.eye(2)[:, :1]))
    assert cluster.tolist() == [0, 0, 1] and distance.tolist() == [1, 0, 0]
