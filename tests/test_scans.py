"""Two-level scans against plain loops, with bins that rows straddle, gaps of many bins, nulls and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.functions.scans import highest_total, scan
from changelens.functions.series import carried, islands
from changelens.operators import lag

M = 60_000_000


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), n, rng.choice([None, 1, 2]), rng.choice([None, None, "", "x"])) for n in range(150)]
    df = spark.createDataFrame(rows, "k string, t long, n long, v long, m string")
    got = scan(df, ["k"], ["t", "n"], width, prev=(F.col("n"), "previous"), before=(F.struct("t", "v"), "previous"), total=(F.col("v"), "total"), mark=(F.col("m"), "mark"))
    assert got.columns == [*df.columns, "prev", "before", "total", "mark"]
    want = {}
    for key in ("a", "b", None):
        prev, before, total, mark = None, None, None, None
        for _, t, n, v, m in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            total = total if v is None else (total or 0) + v
            mark = mark if m is None else m
            want[n] = (prev, before, total, mark)
            prev, before = n, (t, v)
    assert {r.n: (r.prev, tuple(r.before) if r.before else None, r.total, r.mark) for r in got.collect()} == want


@pytest.mark.parametrize("width", [3, 50])
def test_runs_and_carried_state_are_those_of_plain_windows(spark, width):
    rng = random.Random(width)
    times = {(k, rng.randrange(300)) for k in "abc" for _ in range(60)}
    df = spark.createDataFrame([(k, t, rng.choice([None, "", "s", "z"])) for k, t in sorted(times)], "k string, t long, m string")
    near = F.col("t") - F.col("prev") <= 2
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(islands(df, ["k"], "t", near, width=width).select("k", "t", "run")) == rows(islands(df, ["k"], "t", near).select("k", "t", "run"))
    assert rows(carried(df, ["k"], ["t"], F.col("m"), "s", width=width).select("k", "t", "s")) == rows(carried(df, ["k"], ["t"], F.col("m"), "s").select("k", "t", "s"))


def test_highest_total(spark):
    rng = random.Random(2)
    steps = [(rng.choice("ab"), t, rng.choice([-2, -1, 1, 2])) for t in range(200)]
    df = spark.createDataFrame(steps, "k string, t long, d long")
    for width in (1, 13, 1000):
        got = {r.k: r.peak for r in highest_total(df, ["k"], ["t"], width, "d", "peak").collect()}
        assert got == {k: max(np.cumsum([d for key, _, d in steps if key == k])) for k in "ab"}


def episodes(t, v):
    """The episodes of one node by walking along its minutes."""
    out, i, n = [], 0, len(t)
    near = lambda a: t[a + 1] - t[a] == M
    while i < n:
        if v[i] < 30:
            i += 1
            continue
        a = b = i
        while a > 0 and near(a - 1) and v[a - 1] > 0.5 and v[a - 1] <= v[a]:
            a -= 1
        while b + 1 < n and near(b) and v[b] > 0.5:
            b += 1
        peak = max(range(a, b + 1), key=lambda k: (v[k], -k))
        slopes = [(v[k + 1] - v[k]) / 60 for k in range(a, b)]
        best, at = (0, 0), 0
        while at < len(slopes):
            end = at
            while end < len(slopes) and slopes[end] >= 0.85:
                end += 1
            if end - at >= 2 and end - at > best[1] - best[0]:
                best = (at, end)
            at = max(end, at + 1)
        origin = None
        if best[1]:
            found = np.array([t[k] - 30e6 - v[k] * 1e6 for k in range(a + best[0], a + best[1] + 1)])
            found = found[abs(found - np.median(found)) <= 60e6]
            origin = int(np.median(found)) if len(found) >= 3 else None
        kind = "stall" if origin is not None else "behind" if b - a >= 2 else "spike"
        middle = lambda x: round(float(np.median(x)), 9) if len(x) else None
        out.append((kind, t[a], t[b], v[peak], t[peak], middle(slopes[: peak - a]), middle(slopes[peak - a :]), origin, t[a + best[1]] if origin is not None else None))
        i = b + 1
    return out


def test_lag_episodes_on_random_series(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for node in range(40):
        t, v, at, now = [], [], 0, 0.0
        for _ in range(rng.randint(1, 60)):
            at += M if rng.random() < 0.93 else rng.choice([M // 2, 2 * M, 5 * M])
            kind = rng.random()
            now = now + 60 if kind < 0.45 else now + rng.choice([50, 51, 55, 61, 70]) if kind < 0.6 else rng.choice([0.0, 0.2, 0.5, 0.6, 5.0, 29.9, 30.0, 45.0, now, now / 2])
            t.append(at)
            v.append(now)
        rows += [("i", f"n{node}", x, y) for x, y in zip(t, v, strict=True)] + [("i", f"n{node}", t[0], v[0])]
        want[f"n{node}"] = episodes(t, v)
    df = spark.createDataFrame(rows, "instance_id string, node_id string, end_us long, lag_s double")
    for width in (None, 7 * M):
        got = {}
        for r in lag.lag_episodes(df, width_us=width).orderBy("start_us").collect():
            short = [x if x is None else round(x, 9) for x in (r.growth, r.recovery)]
            got.setdefault(r.node_id, []).append((r.kind, r.start_us, r.end_us, r.peak_s, r.peak_us, *short, r.origin_us, r.release_us))
        assert got == {k: x for k, x in want.items() if x}
    assert {x[0] for e in want.values() for x in e} == {"stall", "behind", "spike"}
