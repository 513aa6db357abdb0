"""Growth ranking and execution series against plain Python with exact fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from changelens.operators import attribution as att

M = 60_000_000
EVENT = "instance_id string, event_id string, family string, node_id string, start_us long, duration_us long"


def test_repeated_and_outlying_executions_are_refused(spark):
    make = lambda rows: spark.createDataFrame(rows, EVENT)
    run = lambda rows: {(r.family, r.end_us): (r.runtime_us, r.executions) for r in att.execution_series(make(rows), 0, 10 * M).collect()}
    one = ("i", "1", "x", "n", 0, M)
    assert run([one, ("j", "1", "x", "n", 0, M)]) == {("x", M): (2 * M, 2)}  # another instance's number
    assert run([("i", "", "x", "n", 0, M), ("i", None, "x", "n", 0, M), ("i", "", "x", "n", 0, M)]) == {("x", M): (3 * M, 3)}
    for bad, why in (([one, one], "repeated event id"), ([one, ("i", "1", "y", "m", M, 5)], "repeated event id"), ([("i", "2", "x", "n", -1, 5)], "outside"), ([("i", "2", "x", "n", 10 * M, 5)], "outside")):
        with pytest.raises(Exception, match=why):
            run(bad)
        with pytest.raises(Exception, match=why):
            att.execution_series(make(bad), 0, 10 * M).count()


def test_exact_order_of_huge_fractions(spark):
    rng = random.Random(4)
    top = 2**63 - 1
    rows = []
    for n in range(300):
        score = rng.choice([0, 1, 10**19, 10**38 - 1, 10**38 - 1 - rng.randrange(3), rng.randrange(10**38), rng.randrange(10**20)])
        runtime = rng.choice([0, 1, 3, top, top - 1, rng.randrange(1, top), rng.randrange(1, 10**6)])
        growth = rng.choice([0, 1, runtime, max(runtime - 1, 0), top, rng.randrange(top), rng.randrange(10**6)])
        rows.append(("n", f"f{n:03}", str(score), growth, runtime, rng.choice([None, -1, 0, 5])))
    # neighbours in the last place
    rows += [("n", "p", str(10**38 - 1), top - 2, top - 1, 0), ("n", "q", str(10**38 - 1), top - 1, top, 0), ("n", "r", str(10**38 - 2), top - 1, top, 0)]
    df = spark.createDataFrame(rows, "node_id string, family string, score string, growth_us long, runtime_us long, scan long").withColumn("score", F.col("score").cast("decimal(38,0)"))
    got = {r.family: r["rank"] for r in att.fraction_rank(df).collect()}
    value = lambda r: Fraction(int(r[2]) * r[3], max(r[4], 1))
    order = sorted(rows, key=lambda r: (-value(r), -max(0, r[5] or 0), r[1]))
    assert got == {r[1]: n if value(r) or (r[5] or 0) > 0 else None for n, r in enumerate(order, 1)}


def test_growth_ranking_against_the_rule(spark):
    rng = random.Random(6)
    event = lambda half: (rng.choice("mn"), rng.choice("abcdefgh"[half * 2 :]), rng.randrange(1000), rng.randrange(1000), rng.choice([None, -5, rng.randrange(900)]) if rng.random() < 0.1 else rng.randrange(900), None if rng.random() < 0.05 else rng.randrange(50))
    cols = "node_id string, family string, overlap_us long, duration_us long, lock_time_us long, rows_examined long"
    fix = lambda e: (*e[:2], min(e[2], e[3]), *e[3:])
    before, now = ([fix(event(half)) for _ in range(60)] for half in (1, 0))
    score = {(n, f): rng.randrange(10**6) for n in "mn" for f in "abcdefg"}
    rise = {"m": -1.0, "n": 2.0}

    def costs(events):
        out = {}
        for n, f, overlap, duration, lock, rows in events:
            c = out.setdefault((n, f), {"run": 0, "net": 0, "n": 0, "rows": [], "lock": []})
            lock = None if lock is None or lock < 0 else lock
            c["run"] += overlap
            c["net"] += overlap * max(duration - min(lock or 0, duration), 0) // duration if duration else 0
            c["n"] += 1
            c["rows"] += [] if rows is None else [rows]
            c["lock"] += [] if lock is None else [lock]
        return out

    a, b = costs(now), costs(before)
    want, rank = {}, {}
    for key, c in a.items():
        old = b.get(key)
        delta = {x: sum(c[x]) - sum(old[x]) if old and len(c[x]) == c["n"] and len(old[x]) == old["n"] else None for x in ("rows", "lock")}
        grown = max(0, c["net"] - old["net"]) if old else 0
        evidence = "scan_growth_related_evidence" if (delta["rows"] or 0) > 0 else "no_scan_growth" if delta["rows"] is not None else "elapsed_overlap_only" if old else "baseline_shape_unobserved"
        told = [*att.WARNINGS, *([] if old else [att.NO_BASELINE]), *([att.VICTIM] if (delta["lock"] or 0) > 0 else []), *([att.NO_RISE] if rise[key[0]] <= 0 else [])]
        value = Fraction(score.get(key, 0) * grown, max(c["run"], 1))
        want[key] = (grown, delta["rows"], evidence, told)
        rank[key] = (-value, -max(0, delta["rows"] or 0), key[1])
    ranks = {}
    for n in "mn":
        for k, key in enumerate(sorted((x for x in rank if x[0] == n), key=rank.get), 1):
            ranks[key] = k if rank[key][0] or rank[key][1] else None
    overlap = spark.createDataFrame([(*k, v) for k, v in score.items()], "node_id string, family string, score long")
    rises = spark.createDataFrame(list(rise.items()), "node_id string, delta double")
    make = lambda rows: att.family_costs(spark.createDataFrame(rows, cols))
    got = {(r.node_id, r.family): r for r in att.growth_ranking(make(now), make(before), overlap, rises).collect()}
    assert {k: (r.growth_us, r.rows_examined_delta, r.evidence, r.warnings) for k, r in got.items()} == want
    assert {k: r["rank"] for k, r in got.items()} == ranks
    assert {r[2] for r in want.values()} >= {"scan_growth_related_evidence", "no_scan_growth", "baseline_shape_unobserved"}
