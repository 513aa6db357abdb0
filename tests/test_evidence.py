import random
from statistics import median

import pytest

from changelens.operators import counters as cn
from changelens.operators import coverage as cov
from changelens.operators import evidence as ev
from changelens.operators import lag

M = 60_000_000
POINTS = "role string, metric string, node_id string, epoch string, end_us long, value double"


def test_metric_profiles_name_the_gravest_fault(spark):
    ok = lambda role, **x: [(role, "CPUUtilization", x.get("node", "n"), x.get("epoch", "e"), k * M, float(k)) for k in range(1, 9)]
    rows = ok("fine") + ok("gap")[:-1] + ok("nameless", node=None) + ok("nan")[:-1] + [("nan", "CPUUtilization", "n", "e", 8 * M, float("nan"))]
    rows += ok("twice") + [("twice", "CPUUtilization", "n", "e", 3 * M, 3.0)] + ok("torn") + [("torn", "CPUUtilization", "n", "e", 3 * M, 3.5)]
    rows += ok("moved")[:4] + [(r, m, "other", e, t, v) for r, m, _, e, t, v in ok("moved")[4:]] + ok("again")[:4] + [(r, m, n, "f", t, v) for r, m, n, _, t, v in ok("again")[4:]]
    rows += [("fine", "CPUUtilization", "n", "e", 8 * M + 7, 99.0), ("fine", "CPUUtilization", "n", "e", 9 * M, 99.0)]
    now = ev.metric_profiles(spark.createDataFrame(rows, POINTS), 0, 8 * M)
    got = {r.role: r for r in now.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "fine": "ok", "gap": "metric_gaps", "nameless": "ok", "nan": "invalid_metric_value", "twice": "ok", "torn": "ambiguous_metric_samples", "moved": "node_or_epoch_changed", "again": "node_or_epoch_changed"
    }
    assert (got["fine"].periods, got["fine"].mean, got["fine"].peak_us) == (8, 4.5, 8 * M)
    before = ev.metric_profiles(spark.createDataFrame(ok("fine", epoch="old") + ok("nameless", node=None) + ok("gap"), POINTS), 0, 8 * M)
    assert {r.role: (r.status, r.delta) for r in ev.compare_profiles(now, before).collect() if r.role in ("fine", "gap", "nameless", "torn")} == {
        "fine": ("node_or_epoch_changed", None), "gap": ("metric_comparison_incomplete", None), "nameless": ("role_only_identity_unverified", 0.0), "torn": ("metric_baseline_unavailable", None)
    }


def test_assessment_of_single_groups(spark):
    costs = [*ev.COSTS, "write_wait_us"]
    cols = "role string, group_id string, first_us long, incomplete boolean, count long, count_before long, " + ", ".join(f"{c} long, {c}_before long, {c}_delta long" for c in costs)
    group = lambda name, first=0, broken=False, **x: ("r", name, first, broken, 6, 2, *[v for c in costs for v in x.get(c, (20, 10, 10))])
    rows = [group("up"), group("late", 5 * M), group("broken", broken=True), group("flat", cpu_ns=(5, 10, -5)), group("unknown", cpu_ns=(5, None, None), docs=(1, 1, None), bytes_read=(1, 1, 0), duration_us=(1, 1, 0), write_wait_us=(1, 1, 0))]
    groups = spark.createDataFrame(rows, cols)
    points = [("r", m, "n", "e", k * M, float(9 - abs(k - 5))) for m in ("CPUUtilization", "IoBandwidth", "MemoryUtilization") for k in range(1, 9)]
    profiles = ev.metric_profiles(spark.createDataFrame(points, POINTS), 0, 8 * M)
    seen = ev.continuity(spark.createDataFrame([("r", "n", "e")], "role string, node_id string, epoch string"))
    metrics = ["CPUUtilization", "IoBandwidth", "MemoryUtilization", "AvgRt"]
    got = {(r.metric, r.group_id): r for r in ev.assess(groups, metrics, profiles, ev.compare_profiles(profiles, profiles), seen).collect()}
    status = lambda m, g: (got[m, g].status, got[m, g].priority)
    assert status("CPUUtilization", "up") == ("direct_cost_growth", 3) and status("IoBandwidth", "up") == ("related_cost_growth", 2)
    assert status("MemoryUtilization", "up") == ("memory_requires_component_deltas", 0) and status("AvgRt", "up") == ("latency_growth_not_cause", 1)
    assert status("CPUUtilization", "late") == ("after_peak", 0) and status("CPUUtilization", "broken") == ("incomplete_command", 0)
    assert status("CPUUtilization", "unknown") == ("resource_cost_incomplete", 0) and got["CPUUtilization", "unknown"].assessment == "insufficient_cost_fields"
    flat = got["CPUUtilization", "flat"]
    assert flat.status == "no_resource_cost_growth" and flat.reasons[:3] == ["elapsed_growth_without_resource_cost_growth", "write_concern_wait_increased", "resource_window_mean_not_increased"]
    assert (flat.frequency_component, flat.per_call_component) == (20.0, -25.0) and flat.frequency_component + flat.per_call_component == flat.delta
    assert "temporal_association_unavailable" in got["AvgRt", "up"].reasons and got["AvgRt", "up"].conclusion == "insufficient_evidence"
    first = ev.order_by_evidence(ev.assess(groups, metrics, profiles, profiles.selectExpr("role", "metric", "'ok' AS status", "1D AS delta"), seen), 1).first()
    assert first.priority == 3


def test_nearest_windows_against_all_spans(spark):
    rng = random.Random(5)
    spans, windows = [], []
    for key in ("a", "b", "c"):
        at = 0
        for _ in range(rng.choice([0, 12, 40]) if key == "c" else 30):
            lo = at + rng.randint(1, 60)
            at = lo + rng.randint(1, 50)
            spans.append((key, lo, at))
        windows += [(key, n, s := rng.randint(-20, 1500), s + rng.choice([1, 5, 20, 49, 60])) for n in range(60)]
    w = spark.createDataFrame(windows, "instance_id string, id long, start_us long, end_us long")
    s = spark.createDataFrame(spans, "instance_id string, lo long, hi long")
    for width in (7, 10**6):
        got = {(r.instance_id, r.id): (r.nearest_start_us, r.nearest_end_us) for r in cov.nearest_windows(w, s, width).collect()}
        want = {}
        for key, n, start, end in windows:
            found = [min(max(start, lo), hi - (end - start)) for k, lo, hi in spans if k == key and hi - lo >= end - start]
            best = min(found, key=lambda x: (abs(x - start), x), default=None)
            want[key, n] = (best, None if best is None else best + end - start)
        assert got == want


def test_removed_intervals_allow_one_hole(spark):
    states = {1: "removed", 2: "removed", 4: "removed", 7: "removed", 8: "removed", 11: "removed", 12: "unknown", 13: "removed", 14: "removed", 15: "usable"}
    health = spark.createDataFrame([("i", "n", k * M, s) for k, s in states.items()], "instance_id string, node_id string, end_us long, status string")
    got = sorted((r.start_us // M, r.end_us // M, r.minutes) for r in lag.removed_intervals(health).collect())
    assert got == [(0, 4, 3), (10, 14, 3)]
    assert [(r.start_us // M) for r in lag.removed_intervals(health, listed=1).collect()] == [10]


def test_peer_evidence_against_the_rule(spark):
    rng = random.Random(8)
    nodes, minutes = ["a", "b", "c", "d"], list(range(1, 41))
    value = lambda low, high: None if rng.random() < 0.1 else rng.uniform(low, high)
    series = {(n, t): (None if rng.random() < 0.05 else rng.choice([0.0, 100.0, 120.0]), value(0, 9 if n == "a" else 2), value(1, 9), value(0, 90), value(0, 50)) for n in nodes for t in minutes if rng.random() < 0.95}
    df = spark.createDataFrame([("i", n, t * M, *v) for (n, t), v in series.items()], "instance_id string, node_id string, end_us long, reads double, slow double, threads double, cpu double, iops double")
    spans = {"a": [(3, 20), (18, 30)], "b": [(5, 38)], "c": [(1, 2)], "d": [(50, 60)]}
    episodes = spark.createDataFrame([("i", n, lo * M, hi * M) for n, s in spans.items() for lo, hi in s], "instance_id string, node_id string, start_us long, end_us long")
    health = lag.peer_health(df)
    status = {(r.node_id, r.end_us // M): r.status for r in health.collect()}
    got = {r.node_id: r for r in lag.peer_evidence(df, health, episodes).collect()}
    at = lambda n, t, k: series.get((n, t), (None,) * 5)[k]

    def ratio(n, ts, top, bottom):
        pairs = [(at(n, t, top), at(n, t, bottom)) for t in ts]
        pairs = [p for p in pairs if None not in p]
        return sum(p[0] for p in pairs) / sum(p[1] for p in pairs) * 1000 if sum(p[1] for p in pairs) > 0 else None

    def mean(n, ts, k):
        known = [at(n, t, k) for t in ts if at(n, t, k) is not None]
        return sum(known) / len(known) if known else None

    for n, s in spans.items():
        inside = [t for t in minutes if (n, t) in series and any(lo <= t <= hi for lo, hi in s)]
        usable = [t for t in inside if status[n, t] == "usable"]
        if not inside:
            assert n not in got
            continue
        assert (got[n].minutes, got[n].read_minutes, got[n].status) == (len(inside), len(usable), "ok" if len(usable) >= 5 else "no_reads")
        if len(usable) < 5:
            assert got[n].diverged is None and got[n].cpu_pct is None
            continue
        measures = {"slow_per_1000_reads": lambda x, u=usable: ratio(x, u, 1, 0), "ms_per_read": lambda x, u=usable: ratio(x, u, 2, 0), "reads_per_s": lambda x, u=usable: mean(x, u, 0), "cpu_pct": lambda x, u=usable: mean(x, u, 3), "iops_pct": lambda x, u=usable: mean(x, u, 4)}
        for name, f in measures.items():
            peers = median(v for v in (f(x) for x in nodes if x != n) if v is not None)
            floor = max(peers, 0.05) if name.startswith("slow") else peers
            row = got[n][name]
            assert (row.node, row.peers, row.ratio) == pytest.approx((round(f(n), 0 if name == "reads_per_s" else 1 if "pct" in name else 2), round(peers, 0 if name == "reads_per_s" else 1 if "pct" in name else 2), round(f(n) / floor, 2)), abs=0.0101)
        slow = sum((at(n, t, 1) or 0) * 60 for t in usable)
        assert got[n].diverged == (slow >= 60 and got[n].slow_per_1000_reads.ratio >= 3)
    assert got["a"].diverged and not got["b"].diverged


def test_a_tail_adds_only_what_is_not_published(spark):
    cols = "role string, group_id string, bucket_us long, overlap_us long, count long, c long, c_known long, sample string, max_us long, first_us long, last_us long"
    row = lambda minute, n, most, sample: ("r", "g", minute * M, n, n, n, n, sample, most, minute * M + n, minute * M + n)
    stored = spark.createDataFrame([row(0, 1, 5, "s0"), row(4, 2, 5, "s4")], cols)
    tail = spark.createDataFrame([row(1, 100, 9, "t1"), row(5, 10, 9, "t5"), row(6, 20, 3, "t6"), row(9, 1000, 9, "t9")], cols)
    published = spark.createDataFrame([(0,)], "window_us long")
    out = cn.mongo_read(stored, 0, 10 * M, ("c",), tail, published, 9 * M)
    got = {r.bucket_us // M: (r["count"], r.c, r.sample, r.first_us % M) for r in out.collect()}
    assert got == {0: (1, 1, "s0", 1), 4: (2, 2, "s4", 2), 5: (10, 10, "t5", 10), 6: (20, 20, "t6", 20)}
    assert cn.mongo_read(stored, 0, 10 * M, ("c",)).count() == 2
