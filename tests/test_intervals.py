import random

import pytest
from pyspark.sql import functions as F

from changelens.functions.intervals import gather, overlapping, stab, whole_bins
from changelens.operators.coverage import coverage_runs

def measures():
    return {"n": (F.lit(1), "sum"), "last": (F.col("name"), "max"), "first": (F.col("name"), "min")}


def spans(seed, n):
    """Nested, equal, very long, very short, empty and open-ended spans over two keys and a null key."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([0, 1, 2, 1000, 1 << 20, (1 << 20) + 1, 1 << 23, 3 << 26, 1 << 35, 1 << 44, 1 << 59])
        lo = rng.choice([0, 1 << 20, 5, rng.randrange(1 << 24), rng.randrange(1 << 36), rng.randrange(1 << 51)])
        out.append((rng.choice(["a", "a", "b", None]), lo, lo + size, f"s{k:03}"))
    return [*out, ("a", None, 5, "x"), ("a", 5, None, "y"), ("b", 9, 3, "z")]


def ats(rows, rng):
    edges = [x + d for _, lo, hi, _ in rows if lo is not None and hi is not None for x in (lo, hi) for d in (-1, 0, 1)]
    return [*rng.sample(edges, 60), *(rng.randrange(1 << 36) for _ in range(30)), None]


def summed(names):
    return (len(names), max(names), min(names)) if names else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_points_in_spans(spark, seed):
    rows = spans(seed, 60)
    rng = random.Random(seed)
    points = [(rng.choice(["a", "b", "c"]), t, f"p{n:03}") for n, t in enumerate(ats(rows, rng))]
    r = spark.createDataFrame(rows, "key string, lo long, hi long, name string")
    p = spark.createDataFrame(points, "key string, at long, name string")
    ok = [x for x in rows if x[1] is not None and x[2] is not None]
    got = {(x.key, x.at): (x.n, x.last, x.first) for x in stab(p, r, ["key"], "at", "lo", "hi", measures()).collect()}
    want = {(k, t): summed([s[3] for s in ok if s[0] == k and s[1] <= t < s[2]]) for k, t, _ in points if t is not None}
    assert got == {k: v for k, v in want.items() if v}
    got = {(x.key, x.lo, x.hi): (x.n, x.last, x.first) for x in gather(r, p, ["key"], "lo", "hi", "at", measures()).collect()}
    want = {(k, lo, hi): summed([m for key, t, m in points if key == k and t is not None and lo <= t < hi]) for k, lo, hi, _ in ok}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", [4, 5])
def test_overlapping_spans(spark, seed):
    left, right = spans(seed, 50), spans(seed + 10, 50)
    make = lambda rows: spark.createDataFrame(rows, "key string, lo long, hi long, name string")
    got = {(x.key, x.lo, x.hi): (x.n, x.last, x.first) for x in overlapping(make(left), make(right), ["key"], "lo", "hi", measures()).collect()}
    ok = lambda rows: [x for x in rows if x[0] is not None and x[1] is not None and x[2] is not None and x[1] < x[2]]
    want = {(k, lo, hi): summed([m for key, a, b, m in ok(right) if key == k and a < hi and b > lo]) for k, lo, hi, _ in ok(left)}
    assert got == {k: v for k, v in want.items() if v}


def test_a_hot_key_makes_no_pairs(spark):
    """A thousand bindings over a thousand events of one key: rows of the join follow the bins, not the pairs."""
    r = spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") * 1000).alias("lo"), (F.lit(1 << 40) + F.col("id")).alias("hi"))
    p = spark.range(1000).select(F.lit("k").alias("key"), F.shiftleft(F.col("id") + 1, 25).alias("at"))
    got = stab(p, r, ["key"], "at", "lo", "hi", {"n": (F.lit(1), "sum")})
    assert {x.n for x in got.collect()} == {1000}
    made = []

    def joins(node):
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            joins(node.children().apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            joins(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            joins(node.plan())

    joins(got._jdf.queryExecution().executedPlan())
    assert made and sum(made) <= 14 * 1000


@pytest.mark.parametrize("few", [0, 16, 1000])
def test_light_and_heavy_keys_agree(spark, monkeypatch, few):
    """Pairs of keys with few rows and bins of the others give the same measures."""
    monkeypatch.setattr("changelens.functions.intervals.FEW", few)
    test_points_in_spans(spark, 6)
    test_overlapping_spans(spark, 7)


def test_bins_take_one_expression_for_all_widths(spark):
    """The plan of an explosion doesn't hold the expression of each width, which took the driver's memory."""
    r = spark.range(1).select(F.lit("k").alias("key"), F.col("id").alias("lo"), (F.col("id") + 5).alias("hi"), F.col("id").alias("at"))
    assert len(r.select(F.explode(whole_bins(F.col("lo"), F.col("hi"))))._jdf.queryExecution().optimizedPlan().toString()) < 10_000


def test_coverage_plans_are_small(spark):
    """Runs of coverage read stored parts; planned as one tree they took all of the driver's memory."""
    rows = [(1, "a", 0, 10, "done"), (2, "a", 20, 30, "pending"), (3, "b", 5, 9, "collecting")]
    files = spark.createDataFrame(rows, "id long, instance_id string, lo long, hi long, state string")
    out = coverage_runs(files, files.filter("state = 'done'"), 0, 40 * 1_000_000)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    got = {(r.instance_id, r.lo, r.hi, r.reason) for r in out.collect()}
    assert got == {("a", 0, 1_000_000, "covered"), ("a", 1_000_000, 40_000_000, "pending"), ("b", 0, 40_000_000, "collecting")}
