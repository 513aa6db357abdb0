import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from changelens.operators import attribution as att
from changelens.operators import changes as ch
from changelens.operators import counters as cn
from changelens.operators import coverage as cov
from changelens.operators import filters as fl
from changelens.operators import lag, schema_diff, search, sessions
from changelens.operators import slow as sl
from changelens.schemas import SLOW_EVENT, with_defaults

M = 60_000_000
META = '[{"index":1,"name":"id","type_id":%d,"primary_key":true}]'


def change(spark, rows):
    return with_defaults(spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "event_id string, event_epoch_us long, operation string, database_name string, table_name string, before_json string, after_json string, columns_json string, transaction_id string"))


def test_keywords_are_literal(spark):
    df = spark.createDataFrame([("50% off_x",), ("500 offax",)], "sql_text string")
    assert fl.keyword_contains(df, "50% off_", "AND", ("sql_text",)).count() == 1
    assert fl.keyword_contains(df, "zzz 50%", "OR", ("sql_text",)).count() == 1
    with pytest.raises(ValueError, match="20 terms"):
        fl.keyword_contains(df, "x " * 21, "AND", ("sql_text",))
    with pytest.raises(ValueError, match="connection"):
        fl.slow_filter(df, connection="c")


def test_primary_key_match(spark):
    rows = [(1, "INSERT", "d", "t", "", '{"id":7}', META % 3, ""), (2, "UPDATE", "d", "t", '{"id":7}', '{"id":8}', META % 3, ""), (3, "DELETE", "d", "t", "", "", META % 3, ""), (4, "INSERT", "d", "t", "", '{"id":"0x07"}', META % 252, ""), (5, "INSERT", "d", "t", "", '{"id":7}', "[]", "")]
    got = [r.x for r in change(spark, rows).orderBy("event_epoch_us").select(fl.pk_match("7").alias("x")).collect()]
    assert got[:3] == [True, True, None] and got[4] is None
    with pytest.raises(Exception, match="primary key unknown"):
        search.pk_history(change(spark, rows), "d", "t", "7").collect()
    assert search.pk_history(change(spark, rows[:2]), "D", "T", "8").count() == 1


def test_page_elects_newest_copy(spark):
    df = change(spark, [(5, "INSERT", "d", "t", "", "", "", ""), (9, "UPDATE", "d", "t", "", "", "", "")]).withColumns({"_content_revision": F.lit(1), "_source_part_key": F.lit("a")})
    old = df.withColumn("operation", F.lit("OLD")).withColumn("_content_revision", F.lit(0))
    page = search.search_events(df.unionByName(old), 1).collect()
    assert [r.operation for r in page] == ["UPDATE", "INSERT"]
    with pytest.raises(ValueError, match="offset"):
        search.search_events(df, 1, 10**6)


def test_last_effective_change(spark):
    rows = [("c", "1", "A", "B", 1), ("c", "1", "B", "C", 2), ("c", "1", "C", "C", 3), ("c", "2", "A", "B", 1), ("c", "2", "B", "A", 2), ("bad", "1", "A", "B", 1), ("bad", "1", "X", "C", 2), ("bad", "2", "A", "B", 1)]
    df = spark.createDataFrame(rows, "cohort string, row_key string, before string, after string, pos int")
    got = ch.last_effective_change(df, ["cohort"], ["pos"]).collect()
    assert [(r.cohort, r.row_key, r.before, r.after, r.pos) for r in got] == [("c", "1", "B", "C", 2)]


def test_last_effective_change_rejects_reused_keys(spark):
    rows = [
        ("reused", "1", "A", None, 1), ("reused", "1", None, "B", 2), ("reused", "2", "A", "B", 1),
        ("same", "1", "A", None, 1), ("same", "1", None, "A", 2), ("same", "2", "A", "B", 1),
        ("twice", "1", "A", None, 1), ("twice", "1", None, None, 2), ("tie", "1", "A", "B", 1), ("tie", "1", "B", "B", 1),
        ("good", "1", None, "A", 1), ("good", "1", "A", "B", 2), ("good", "2", "A", "B", 1), ("good", "2", "B", None, 2), ("good", "3", None, "A", 1), ("good", "3", "A", None, 2),
    ]
    df = spark.createDataFrame(rows, "cohort string, row_key string, before string, after string, pos int")
    got = ch.last_effective_change(df, ["cohort"], ["pos"]).collect()
    assert sorted(tuple(r) for r in got) == [("good", "1", "A", "B", 2), ("good", "2", "B", None, 2)]
    said = spark.createDataFrame([("ok", "1", "A", "B", 1, "UPDATE"), ("odd", "1", "A", "B", 1, "INSERT"), ("ddl", "1", "A", "B", 1, None)], "cohort string, row_key string, before string, after string, pos int, operation string")
    assert [r.cohort for r in ch.last_effective_change(said, ["cohort"], ["pos"]).collect()] == ["ok"]


def test_last_effective_change_keeps_changed_columns_of_whole_images(spark):
    whole = lambda n, v, t="x": f'{{"id":{n},"t":"{t}","v":{v}}}'
    rows = [
        ("c", "1", None, whole(1, "1.5"), 1), ("c", "1", whole(1, "1.5"), whole(1, "1.50"), 2), ("c", "1", whole(1, "1.50"), whole(1, "1.50"), 3),
        ("c", "2", None, whole(2, "12345678901234567890.10"), 1), ("c", "3", whole(3, "null"), None, 1), ("c", "4", whole(4, '{"b":1,"a":[2]}'), whole(4, '{"b":1,"a":[3]}', "y"), 1),
        ("partial", "1", '{"id":1,"v":1}', '{"id":1,"v":2}', 1), ("partial", "2", whole(2, 1), whole(2, 2), 1),
        ("more", "1", None, '{"id":1,"t":"x","v":1,"w":1}', 1), ("text", "1", None, "A", 1),
    ]
    df = spark.createDataFrame(rows, "cohort string, row_key string, before string, after string, pos int")
    want = [
        ("c", "1", "UPDATE", '{"v":1.5}', '{"v":1.50}', 2),
        ("c", "2", "INSERT", None, whole(2, "12345678901234567890.10"), 1),
        ("c", "3", "DELETE", None, None, 1),
        ("c", "4", "UPDATE", '{"t":"x","v":{"a":[2],"b":1}}', '{"t":"y","v":{"a":[3],"b":1}}', 1),
    ]
    for columns in (["v", "id", "t"], F.split(F.lit("v,id,t"), ",")):
        assert sorted((tuple(r) for r in ch.last_effective_change(df, ["cohort"], ["pos"], columns).collect()), key=lambda r: r[:2]) == want
    assert ch.last_effective_change(df, ["cohort"], ["pos"], F.lit(None).cast("array<string>")).count() == 0


def slow_rows(spark, rows):
    return with_defaults(spark.createDataFrame(rows, "event_id string, event_epoch_us long, fingerprint string"), SLOW_EVENT)


def test_exact_correlation_against_the_library(spark):
    rng = random.Random(53)
    width, n = M, 40
    counts = {f: [rng.choice([0, 0, 1, 3, rng.randint(0, 9)]) for _ in range(n)] for f in ("a", "b", "c")}
    counts["flat"] = [2] * n
    rows = [(f"{f}-{k}-{j}", k * width + j, f) for f, x in counts.items() for k, v in enumerate(x) for j in range(v)]
    got = {r.fingerprint: r for r in sl.slow_correlation(slow_rows(spark, rows), 0, n * width - 1, width).collect()}
    total = [sum(x) for x in zip(*counts.values(), strict=True)]
    diff = lambda v: [b - a for a, b in zip(v, v[1:], strict=False)]
    for f in ("a", "b", "c"):
        x = counts[f]
        assert got[f].r_level == pytest.approx(statistics.correlation(x, total))
        assert got[f].r_change == pytest.approx(statistics.correlation(diff(x), diff(total)))
        assert got[f].r_rest == pytest.approx(statistics.correlation(x, [t - v for t, v in zip(total, x, strict=True)]))
        assert got[f].active_buckets == sum(v > 0 for v in x)
    assert got["flat"].status == "constant_sql" and got["flat"].r_level is None
    cut = sl.slow_correlation(slow_rows(spark, rows), 1, 5 * width + 3, width).collect()
    assert {r.status for r in cut} == {"insufficient_buckets"} and {r.buckets for r in cut} == {4}


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, family string, node_id string, start_us long, duration_us long")


def test_attribution_against_fractions(spark):
    rng = random.Random(9)
    n = 10
    rows = [(str(k), rng.choice("xyz"), "n1", rng.randrange(0, n * M), rng.randrange(0, 4 * M)) for k in range(60)]
    metric = [rng.randint(0, 50) for _ in range(n)]
    points = spark.createDataFrame([("n1", (k + 1) * M, v) for k, v in enumerate(metric)], "node_id string, end_us long, value long")
    series = att.execution_series(events(spark, rows), 0, n * M)
    want = {}
    for _, f, _, s, d in rows:
        for k in range(n):
            o = max(0, min(s + d, (k + 1) * M) - max(s, k * M))
            want.setdefault(f, [0] * n)[k] += o
    got = {}
    for r in series.collect():
        got.setdefault(r.family, [0] * n)[r.end_us // M - 1] = r.runtime_us
    assert got == want
    reference = sorted(metric)[(n - 1) // 5]
    score = {f: sum(o * max(m - reference, 0) for o, m in zip(x, metric, strict=True)) for f, x in want.items()}
    out = {r.family: r for r in att.resource_overlap(series, points, 0, n * M).collect()}
    for f, x in want.items():
        assert int(out[f].score) == score[f] and out[f].status == "ok"
        assert out[f].share == pytest.approx(float(Fraction(score[f], sum(score.values()))))
        assert out[f].r == pytest.approx(statistics.correlation(x, metric))
    holes = att.resource_overlap(series, points.filter(f"end_us <> {3 * M}"), 0, n * M).collect()
    assert {(r.status, int(r.score)) for r in holes} == {("metric_gaps", 0)}
    none = att.resource_overlap(series, points, 0, n * M, reference=spark.createDataFrame([], "node_id string, reference long")).collect()
    assert {r.status for r in none} == {"metric_baseline_unavailable"}
    with pytest.raises(Exception, match="negative"):
        att.execution_series(events(spark, [("1", "x", "n", 0, -5)]), 0, n * M).collect()


def test_growth_needs_growth(spark):
    cols = "node_id string, family string, runtime_us long, executions long, rows_examined long"
    now = spark.createDataFrame([("n", "up", 100, 2, 5), ("n", "flat", 100, 2, 5), ("n", "new", 50, 1, 9)], cols)
    old = spark.createDataFrame([("n", "up", 20, 1, 5), ("n", "flat", 100, 2, 5)], cols)
    overlap = spark.createDataFrame([("n", "up", 1000), ("n", "flat", 9000), ("n", "new", 10)], "node_id string, family string, score long")
    got = {r.family: r for r in att.growth_ranking(now, old, overlap).collect()}
    assert got["up"].final_score == 800 and got["up"].rank == 1
    assert got["flat"].rank is None and got["flat"].evidence == "no_scan_growth"
    new = got["new"]  # never seen before: not zero before
    assert (new.runtime_us_before, new.growth_us, new.rank, new.evidence) == (None, 0, None, "baseline_shape_unobserved")
    assert new.warnings[-1] == att.NO_BASELINE and att.NO_BASELINE not in got["up"].warnings
    assert {r.status for r in att.growth_status(att.growth_ranking(now, old, overlap)).collect()} == {"ok"}


def test_families_merge_shards_only_in_pairs(spark):
    rows = [("d", "s1", "f1", "select * from log_1 where a=?"), ("d", "s2", "f2", "select * from log_2 where a=?"), ("d", "s3", "f3", "select ?"), ("", "s4", "f4", "select * from log_9 where a=?")]
    got = {r.sql_id: r.family for r in att.assign_families(spark.createDataFrame(rows, "database_name string, sql_id string, fingerprint string, normalized_sql string")).collect()}
    assert got["s1"] == got["s2"] and got["s3"] == "d/s3" and got["s4"].endswith("s4")


def test_counter_statuses(spark):
    rows = [("n", 0, "get", 5, 50, "e1"), ("n", M, "get", 9, 90, "e1"), ("n", M, "set", 1, 1, "e1"), ("n", 2 * M, "get", 3, 95, "e1"), ("n", 2 * M, "set", 4, 9, "e1"), ("n", 9 * M, "get", 6, 99, "e1"), ("n", 10 * M, "get", 8, 120, "e2")]
    df = spark.createDataFrame(rows, "node_id string, ts_us long, command string, calls long, usec long, epoch string")
    got = {(r.end_us // M, r.command): (r.status, r.calls) for r in cn.counter_deltas(df, expected_us=M).collect()}
    assert got == {(0, "get"): ("initial", None), (1, "get"): ("ok", 4), (2, "get"): ("counter_reset", None), (2, "set"): ("counter_reset", None), (9, "get"): ("gap", None), (10, "get"): ("restarted", None)}


def test_metric_windows_name_their_reason(spark):
    rows = [("a", "e", M, 1.0), ("a", "e", 2 * M, 2.0), ("a", "e", 2 * M, 3.0), ("a", "e", 3 * M, -1.0), ("b", "e", M, 1.0005), ("b", "f", 2 * M, 1.0)]
    df = spark.createDataFrame(rows, "node_id string, epoch string, end_us long, value double")
    got = {(r.node_id, r.end_us // M): (r.reason, r.value_milli) for r in cn.metric_windows(df, 0, 4 * M).collect()}
    assert got[("a", 1)] == (None, 1000) and [got[("a", k)][0] for k in (2, 3, 4)] == ["ambiguous", "invalid", "gaps"]
    assert {got[("b", k)][0] for k in (1, 2, 3, 4)} == {"node_or_epoch_changed"}


def test_lag_stall_has_its_planted_origin(spark):
    origin = 600 * M
    lags = [0.0] * 5 + [30.0 + 60 * k for k in range(10)] + [200.0, 40.0, 0.2, 0.1]
    start = origin + 30_000_000 + 30_000_000 - 5 * M
    rows = [("i", "n1", start + k * M, v) for k, v in enumerate(lags)] + [("i", "n2", start + k * M, 40.0 if k == 3 else 0.0) for k in range(len(lags))]
    episodes = lag.lag_episodes(spark.createDataFrame(rows, "instance_id string, node_id string, end_us long, lag_s double"))
    got = {r.node_id: r for r in episodes.collect()}
    assert got["n1"].kind == "stall" and abs(got["n1"].origin_us - origin) < 2_000_000 and got["n1"].peak_s == 570
    assert got["n2"].kind == "spike" and got["n2"].origin_us is None
    ddl = spark.createDataFrame([("i", origin + 20_000_000, "d1"), ("i", origin - 80_000_000, "d2"), ("i", origin + 10**9, "d3")], "instance_id string, event_epoch_us long, event_id string")
    told = {r.node_id: r for r in lag.describe_lag(episodes, ddl).collect()}
    assert told["n1"].ddl_event == "d1" and told["n1"].rank == 1


def test_plan_estimates(spark):
    rows = [("p", 1, 1, 100, 10.0, "ALL"), ("p", 1, 2, 5, None, "ref"), ("p", 2, 1, 7, 100.0, "const")]
    got = lag.estimate_rows(spark.createDataFrame(rows, "plan_id string, select_id int, step int, rows long, filtered double, access string")).first()
    assert (got.est_rows, got.full_scan) == (100 + 10 * 5 + 7, True)


def test_sessions(spark):
    cols = "instance_id string, node_id string, ts_us long, session_id string, user string, client string, database_name string, command string, state string, time_s long, trx_id string, trx_s long, sql_text string"
    rows = [("i", "n", 1, "w", "u", "c:1", "d", "Query", "Waiting for table metadata lock", 40, "", 0, "alter"), ("i", "n", 1, "h", "u", "c:2", "d", "Sleep", "", 50, "t1", 60, ""), ("i", "n", 1, "y", "u", "c:3", "d", "Sleep", "", 5, "t2", 5, "")]
    flagged = sessions.session_flags(spark.createDataFrame(rows, cols))
    assert {r.session_id: r.kinds for r in flagged.collect()} == {"w": ["long_running", "lock_wait"], "h": ["long_trx", "idle_trx"], "y": []}
    assert [r.session_id for r in sessions.lock_holder_candidates(flagged).collect()] == ["h"]


def test_coverage_runs(spark):
    files = spark.createDataFrame([("a", "i", 0, 100, "done"), ("b", "i", 100, 200, "pending"), ("c", "i", 300, 400, "done"), ("d", "i", 110, 130, "done")], "id string, instance_id string, lo long, hi long, state string")
    # seconds as the unit of the test
    files = files.withColumns({"lo": F.col("lo") * 10**7, "hi": F.col("hi") * 10**7})
    done = files.filter("state = 'done'").select("id")
    got = sorted((r.lo // 10**7, r.hi // 10**7, r.reason) for r in cov.coverage_runs(files, done, 0, 500 * 10**7).collect())
    assert got == [(0, 100, "covered"), (100, 110, "pending"), (110, 130, "covered"), (130, 300, "pending"), (300, 400, "covered"), (400, 500, "not_collected_yet")]
    assert cov.align_window([(0, 900_000_000)], 100, 800_000_000) == (100, 800_000_000)
    assert cov.align_window([(0, 700_000_000)], 100, 800_000_000) == (100, 600_000_000)
    assert cov.align_window([(200, 300)], 100, 250) is None
    assert aligned(spark, cov.nearest_windows, "nearest", [(0, 50), (100, 300)], 40, 140) == (100, 200)


def aligned(spark, find, name, spans, start, end):
    windows = spark.createDataFrame([("i", 1, start, end)], "instance_id string, id long, start_us long, end_us long")
    row = find(windows, spark.createDataFrame([("i", *x) for x in spans], "instance_id string, lo long, hi long")).first()
    found = (row[f"{name}_start_us"], row[f"{name}_end_us"])
    return None if found == (None, None) else found


def test_ready_prefix(spark):
    m = 60_000_000
    assert aligned(spark, cov.ready_prefixes, "ready", [(0, 20 * m)], 5, 10 * m + 7) == (5, 10 * m)
    assert aligned(spark, cov.ready_prefixes, "ready", [(0, 8 * m + 9), (9 * m, 20 * m)], 0, 15 * m) == (0, 8 * m)
    assert aligned(spark, cov.ready_prefixes, "ready", [(0, 6 * m)], 1, 15 * m) is None
    assert aligned(spark, cov.ready_prefixes, "ready", [(10, 20 * m)], 0, 15 * m) is None and aligned(spark, cov.ready_prefixes, "ready", [], 0, 15 * m) is None


def test_episode_writes(spark):
    w = 300_000_000
    episodes = spark.createDataFrame([("i", "n", "spike", 3 * w + 1, 4 * w), ("i", "n", "stall", 9 * w, 9 * w), ("i", "m", "behind", 11 * w + 5, 11 * w + 9)], "instance_id string, node_id string, kind string, start_us long, end_us long")
    rows = [("i", k * w, "d", t, c) for t, of in {"a": {0: 9, 1: 2, 2: 3, 3: 4, 4: 50}, "b": {1: 90, 3: 20}, "c": {0: 5, 1: 5}, "*": {3: 99}}.items() for k, c in of.items()] + [("j", 3 * w, "d", "z", 99), ("i", 3 * w, "d", "a", 1)]
    agg = spark.createDataFrame(rows, "instance_id string, bucket_us long, database_name string, table_name string, row_events long")
    got = [(r.node_id, r.window_start_us // w, r.window_end_us // w, r.table_name, r.row_events, r.row_events_before, r["rank"]) for r in lag.episode_writes(episodes, agg).orderBy("rank").collect()]
    assert got == [("n", 2, 4, "b", 20, 90, 1), ("n", 2, 4, "a", 8, 11, 2)]
    assert [r.table_name for r in lag.episode_writes(episodes, agg, 1).collect()] == ["b"]


def test_verification(spark):
    a = spark.createDataFrame([("p1", 1, "x", 1), ("p2", 2, "y", 1)], "path string, rows int, sha256 string, revision int")
    b = spark.createDataFrame([("p1", 1, "z", 1), ("p3", 2, "y", 1)], "path string, rows int, sha256 string, revision int")
    assert {r.path: r.status for r in cov.verify_parts(a, b).collect()} == {"p1": "different", "p2": "missing", "p3": "extra"}
    cov.assert_same_rows(a, a)
    with pytest.raises(AssertionError, match="only in"):
        cov.assert_same_rows(a, b)
    ranking = spark.createDataFrame([("c1", "f", 2), ("c2", "g", 5)], "case_id string, family string, rank int")
    truth = spark.createDataFrame([("c1", "f", 3), ("c2", "g", 3), ("c3", "h", 1)], "case_id string, family string, max_rank int")
    assert {r.case_id: r.passed for r in cov.backtest(ranking, truth).collect()} == {"c1": True, "c2": False, "c3": False}


def test_schema_risks(spark):
    cols = "database_name string, table_name string, name string, column_type string, nullable boolean, default_value string, extra string, comment string, collation string"
    row = lambda n, t, null=True: ("d", "t", n, t, null, None, "", "", "")
    source = spark.createDataFrame([row("a", "bigint"), row("b", "varchar(20)"), row("c", "int", False), row("n", "int"), row("same", "int")], cols)
    target = spark.createDataFrame([row("a", "int"), row("b", "varchar(50)"), row("c", "int"), row("x", "int"), row("same", "int")], cols)
    got = {r.name: (r.change, r.risk) for r in schema_diff.diff_columns(source, target).collect()}
    assert got == {"a": ("changed", "safe"), "b": ("changed", "risky"), "c": ("changed", "risky"), "n": ("missing", "safe"), "x": ("extra", "risky")}


def test_peak_ends_first(spark):
    df = spark.createDataFrame([("s", 0, 10), ("s", 10, 20), ("s", 5, 12)], "shop string, start_us long, end_us long")
    assert cn.peak_concurrency(df, ["shop"]).first().peak == 2


def test_lead_type_and_explained_share(spark):
    cols = "node_id string, metric string, value double"
    now = spark.createDataFrame([("n", "com_select", 300.0), ("n", "com_update", 120.0), ("n", "threads_running", 14.0)], cols)
    old = spark.createDataFrame([("n", "com_select", 280.0), ("n", "com_update", 50.0), ("n", "threads_running", 4.0)], cols)
    evidence = att.node_evidence(now, old)
    assert [r.metric for r in att.lead_statement_type(evidence).collect()] == ["com_update"]
    added = spark.createDataFrame([("n", 5.0)], "node_id string, added double")
    assert att.explained_share(evidence, added).first().share == 0.5


def test_hot_keys_follow_the_metric(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 50) for _ in range(12)]
    hits = [("n", "up", k * M, 3 * v) for k, v in enumerate(values)] + [("n", "few", k * M, 1) for k in range(4)]
    metric = spark.createDataFrame([("n", k * M, v) for k, v in enumerate(values)], "node_id string, minute_us long, value long")
    got = {r.key: r for r in cn.hot_keys(spark.createDataFrame(hits, "node_id string, key string, minute_us long, hits long"), metric).collect()}
    assert got["up"].r == pytest.approx(1) and got["up"].n == 11 and got["few"].r is None
    calls = spark.createDataFrame([("d", "get", "user:*", k * M, 5 * v) for k, v in enumerate(values)], "deployment string, command string, shape string, minute_us long, client_us long")
    assert cn.client_shapes(calls, metric).first().r == pytest.approx(1)
