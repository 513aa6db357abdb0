import random
import re

import numpy as np
import xxhash

from changelens.llm.common import shared_folder
from changelens.llm.components import components
from changelens.llm.simhash import anchors, fingerprint, links, near_classes, near_dedup


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, threshold=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd_rows):
    for t in ["a", "a b", "A b C d é", "", None, " x  y\x0bz q", *[r[1] for r in odd_rows if len(r[1] or "") < 5000]]:
        assert fingerprint(t) == brute(t)


def test_components_of_odd_rows(make_docs, odd_rows):
    rows = odd_rows
    got = near_classes(make_docs(rows)).collect()
    fps = [fingerprint(t) for _, t, *_ in rows]
    root = roots(fps)
    by = {}
    for (i, *_), f, r in zip(rows, fps, root, strict=True):
        by.setdefault(f, r)
        by.setdefault(("id", r), [])
        by[("id", r)].append(i)
    for r in got:
        ids = [x for x in by[("id", by[int(r.fingerprint, 16)])] if x is not None]
        assert r.component_id == (min(ids) if ids else None)


def _clusters(seed, n, spread):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(spread):
            f = centre
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out)


def test_links_connect_all_that_is_connected(spark):
    """Against all pairs; tiny blocks force the pairwise comparison of the blocks of one anchor."""
    for block in (8192, 7):
        fps = _clusters(block, 30, 25)
        signed = np.array(fps, np.uint64).view(np.int64).tolist()
        nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
        folder = shared_folder(spark)
        found = links(nodes, folder, block=block)
        for r in found.collect():
            assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
        got = {r.v: r.root for r in components(found, folder).collect()}
        want = roots(fps)
        groups = {}
        for s, w in zip(signed, want, strict=True):
            groups.setdefault(w, []).append(got.get(s, s))
        assert all(len(set(g)) == 1 for g in groups.values())
        assert len({g[0] for g in groups.values()}) == len(groups)


def test_anchors_cover(spark):
    """The home lies within 1 of each half, the replicas within 2, and a partner's replicas hold the home."""
    import pyspark.sql.functions as F

    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        pairs.append((x, y))
    sign = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(sign(x), sign(y)) for x, y in pairs], "x long, y long").select(anchors(F.col("x")).alias("a"), anchors(F.col("y")).alias("b"))
    for r in df.collect():
        home = {c.cell for c in r.a if c.home}
        assert len(home) == 2 and len(r.a) <= 32
        assert home & {c.cell for c in r.b}


def test_chains_become_one_component(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(1).shuffle(chain)
    df = spark.createDataFrame(chain, "a long, b long")
    assert len({r.root for r in components(df, shared_folder(spark)).collect()}) == 1


def test_filter(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots([fingerprint(t) for _, t, *_ in odd_rows])))
    assert near_dedup(make_docs([])).count() == 0
    assert near_classes(make_docs([])).count() == 0
