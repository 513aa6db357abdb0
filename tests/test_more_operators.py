import json
import random

import pytest
from pyspark.sql import functions as F

from changelens.operators import attribution, changes, coverage, lag, search
from changelens.operators.mongo import window_ledger
from changelens.plans import inputs

D = "/root/testdata/sf0.001"
CHANGES = "c string, before_key string, after_key string, before string, after string, n long"


def moved(spark, rows):
    got = changes.moving_row_changes(spark.createDataFrame(rows, CHANGES), ["c"], "n").collect()
    return {(r.c, r.first_key, r.last_key, r.before, r.after, r.n) for r in got}


def test_changes_follow_moving_keys(spark):
    rows = [
        ("a", None, "1", None, "x", 1), ("a", "1", "2", "x", "x", 2), ("a", "2", "2", "x", "y", 3), ("a", "2", "3", "y", "y", 4), ("a", None, "1", None, "p", 5),  # two rows on key 1, one after the other
        ("a", "1", None, "p", None, 6),  # gone again: no change
        ("a", "9", "9", "q", "r", 7), ("a", "9", "9", "r", "q", 8),  # as it was
        ("a", "7", "8", "s", "s", 9),  # was there before, moves only
        ("b", None, "1", None, "x", 1), ("b", "1", "1", "OTHER", "y", 2),  # the image before is not the one after
        ("c", None, "1", None, "x", 1), ("c", None, "1", None, "y", 2),  # an occupied key
        ("d", None, "1", None, "x", 1), ("d", "1", "2", "x", "x", 2), ("d", "1", "1", "x", "y", 3),  # nothing there any more
    ]
    assert moved(spark, rows) == {("a", None, "3", "y", "y", 4), ("a", "7", "8", "s", "s", 9)}
    assert moved(spark, []) == set()


def test_long_chains_of_moves(spark):
    rows = [("a", None if k == 0 else str(k - 1), str(k), None if k == 0 else f"v{k - 1}", f"v{k}", k) for k in range(60)]
    random.Random(1).shuffle(rows)
    assert moved(spark, rows) == {("a", None, "59", "v58", "v59", 59)}


def history(rng, cohort, partial):
    """A random history of rows that are inserted, updated, moved and deleted, and the last real change of each."""
    text = lambda image: json.dumps(image, sort_keys=True, separators=(",", ":"))
    live, chains, events = {}, [], []
    for k in range(3):  # there from the beginning
        live[str(k)] = (image := {"a": k, "b": 1.5, "id": str(k)}, chain := [])
        chains.append((chain, str(k), text(image)))
    for n in range(80):
        kind = rng.random()
        if kind < 0.25 or not live:
            key = str(rng.randrange(40))
            if key in live:
                continue
            live[key] = (image := {"a": rng.randrange(3), "b": 2.0, "id": key}, chain := [])
            chains.append((chain, None, None))
            event = (None, key, None, text(image), n)
        else:
            key = rng.choice(sorted(live))
            image, chain = live.pop(key)
            if kind < 0.4:
                event = (key, None, text(image), None, n)
            else:
                to = str(rng.randrange(40)) if kind < 0.7 else key
                to = key if to in live else to
                after = image | {"a": rng.randrange(3), "id": to}
                live[to] = (after, chain)
                event = (key, to, text(image), text(after), n)
        chain.append(event)
        events.append((cohort, *event))
    want = set()
    for chain, first_key, first in chains:
        real = [e for e in chain if e[2] != e[3] or e[0] != e[1]]
        if not real or (first_key, first) == (chain[-1][1], chain[-1][3]):
            continue
        b, a = (json.loads(x) if x else None for x in real[-1][2:4])
        shape = "INSERT" if b is None else "DELETE" if a is None else "UPDATE"
        cut = lambda x: text({k: v for k, v in x.items() if b[k] != a[k]})  # noqa: B023, E731
        images = (cut(b), cut(a)) if shape == "UPDATE" else (None, real[-1][3])
        want.add((cohort, shape, first_key, chain[-1][1], *images, real[-1][4]))
    if partial:
        n = rng.randrange(len(events))
        hurt = lambda x: x and x.replace('"b":', '"x":')
        events[n] = (*events[n][:3], hurt(events[n][3]), hurt(events[n][4]), events[n][5])
    return events, set() if partial else want


def test_changes_with_columns_through_moves(spark):
    rng = random.Random(12)
    events, want = [], set()
    for n in range(12):
        rows, expected = history(rng, f"c{n}", n % 4 == 3)
        events += rows
        want |= expected
    rng.shuffle(events)
    out = changes.moving_row_changes(spark.createDataFrame(events, CHANGES), ["c"], "n", ["a", "b", "id"])
    assert {(r.c, r.operation, r.first_key, r.last_key, r.before, r.after, r.n) for r in out.collect()} == want
    assert {x[1] for x in want} == {"INSERT", "UPDATE", "DELETE"}


def test_exact_fractions(spark):
    big = "9" * 38
    rows = [("n", "a", big, 10**17, 3, 0), ("n", "b", big, 10**17 + 1, 3, 0), ("n", "c", big, 10**17, 3, 5), ("n", "d", "0", 5, 1, None), ("n", "e", "0", 5, 1, 7), ("m", "a", "1", 1, 0, None)]
    df = spark.createDataFrame(rows, "node_id string, family string, score string, growth_us long, runtime_us long, scan long").withColumn("score", F.col("score").cast("decimal(38,0)"))
    got = {(r.node_id, r.family): r["rank"] for r in attribution.fraction_rank(df).collect()}
    assert got == {("n", "b"): 1, ("n", "c"): 2, ("n", "a"): 3, ("n", "e"): 4, ("n", "d"): None, ("m", "a"): 1}


def test_nearest_rows_match_brute_force(spark):
    rng = random.Random(3)
    left = [(f"k{rng.randint(0, 2)}", rng.randint(0, 3000), f"l{n}") for n in range(300)]
    right = [(f"k{rng.randint(0, 3)}", rng.randint(0, 3000), f"r{n}") for n in range(300)]
    for tolerance in (0, 7, 100):
        out = lag.nearest_within(spark.createDataFrame(left, "k string, at_us long, x string"), spark.createDataFrame(right, "k string, at_us long, x string"), tolerance, ["k"]).collect()
        got = {r.x: r.near.at_us for r in out}
        want = {}
        for k, t, x in left:
            near = [(abs(t - u), u) for j, u, _ in right if j == k and abs(t - u) <= tolerance]
            if near:
                want[x] = min(near)[1]
        assert got == want and all(r.near.k == r.k for r in out)


def test_templates_above_a_number_of_texts(spark):
    ev = inputs.derived_events(spark, D)
    assert {r.level for r in changes.statement_stats(ev, 10**6).select("level").distinct().collect()} == {"statement"}
    few = changes.statement_stats(ev, 5)
    assert {r.level for r in few.select("level").distinct().collect()} == {"template"}
    assert few.select("fingerprint").distinct().count() == 5
    assert few.agg(F.sum("events")).first()[0] == ev.count()


def test_pages_shuffle_narrow_rows_only(spark):
    rows = inputs.change_events(spark, D).withColumns({"_content_revision": F.lit(1).cast("bigint"), "_source_part_key": F.lit("p")})
    plan = search.search_events(rows, 10)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [event_id" in line and "max(" in line]
    assert grouped and all("sql_text" not in line and "after_json" not in line for line in grouped)
    with pytest.raises(ValueError, match="offset"):
        search.search_events(rows, 10, -1)
    assert search.row_store_page(rows, 100, 1950) is None


def test_ledger_of_windows(spark):
    rows = [(0, None), (1, None), (10, None), (20, "bad"), (21, None), (40, None), (41, None), (42, None)]
    got = window_ledger(spark.createDataFrame(rows, "start_us long, error string"), 0, 50, 2, 10).collect()
    assert [(r.window_us, r.status) for r in got] == [(40, "skipped"), (30, "missing"), (20, "unreadable"), (10, "published"), (0, "published")]


def test_pages_hash_and_row_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k long, v string")
    coverage.assert_same_rows(a, a.orderBy("v"))
    with pytest.raises(AssertionError, match="1 rows only in the first"):
        coverage.assert_same_rows(a, a.distinct())
    assert coverage.ordered_hash(a, ["k", "v"], ["k"]) == coverage.ordered_hash(a.repartition(3), ["k", "v"], ["k"])
    many = spark.range(20_001).select("id", F.xxhash64("id").alias("at"))  # more than any page
    whole = coverage.ordered_hash(many, ["id"], ["at"])
    assert whole == coverage.ordered_hash(many.repartition(7), ["id"], ["at"]) == coverage.ordered_hash(many.coalesce(1), ["id"], ["at"])
    first, second = (r.id for r in many.orderBy("at").limit(2).collect())
    swapped = many.withColumn("id", F.when(F.col("id") == first, second).when(F.col("id") == second, first).otherwise(F.col("id")))
    assert len({whole, *(coverage.ordered_hash(x, ["id"], ["at"]) for x in (swapped, many.filter("id > 0"), many.limit(0)))}) == 4
    windows = spark.createDataFrame([("i", 1, 5, 9), ("i", 2, 5, 30), ("i", 3, 1, 4), ("i", 4, 19, 30), ("j", 5, 1, 2)], "instance_id string, id long, start_us long, end_us long")
    spans = spark.createDataFrame([("i", 4, 18), ("i", 19, 20)], "instance_id string, lo long, hi long")
    got = {r.id: (r.aligned_start_us, r.aligned_end_us) for r in coverage.align_windows(windows, spans, 5).collect()}
    one = {i: coverage.align_window([(4, 18), (19, 20)] if i < 5 else [], a, b, 5) or (None, None) for i, a, b in ((1, 5, 9), (2, 5, 30), (3, 1, 4), (4, 19, 30), (5, 1, 2))}
    assert got == one
