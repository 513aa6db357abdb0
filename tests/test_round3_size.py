"""What the queries of round 3's findings do once, however large their tables."""

from changelens.functions import scalar as sc
from changelens.functions import udf
from changelens.operators import search
from changelens.plans.catalog import QUERIES
from changelens.streaming import streams

SMALL = "/root/testdata/sf0.001"


def test_statistics_are_made_once_for_plans_and_orders(spark):
    files = QUERIES["statement_orders"](spark, SMALL).inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]


def test_a_batch_is_moved_by_its_key_once(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        new = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3"), (None, "5"), (None, "4")], "k string, _digest string").repartition(3)
        out = streams.beside_earlier(new, spark.createDataFrame([("b", "9"), (None, "7")], "k string, _old string"), "k").dropDuplicates(["k", "_digest"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(k") == 2  # the batch, and what came earlier
        assert {tuple(r) for r in out.select("k", "_digest", "_first", "_old").collect()} == {("a", "2", "1", None), ("a", "1", "1", None), ("b", "3", "3", "9"), (None, "5", "4", None), (None, "4", "4", None)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_records_of_one_command_are_shaped_once(monkeypatch):
    calls, shape = [], udf.shape
    monkeypatch.setattr(udf, "shape", lambda c, p: calls.append(c) or shape(c, p))
    record = lambda sort, millis: f'{{"ns":"shop.seen_1","command":{{"find":"seen_1","filter":{{"z":7}},"sort":{sort}}},"millis":{millis}}}'
    got = [udf.normalize_command(record('{"x":1,"y":1}', n), ("seen",)) for n in range(5)]
    assert len(calls) == 1 and [g["duration_us"] for g in got] == [0, 1000, 2000, 3000, 4000] and len({g["group_id"] for g in got}) == 1
    # the order of a sort and the kind of a number are part of the command; so are the prefixes
    others = [udf.normalize_command(record(s, 0), p)["group_id"] for s, p in (('{"y":1,"x":1}', ("seen",)), ('{"x":1.0,"y":1}', ("seen",)), ('{"x":1,"y":1}', ()))]
    assert len({got[0]["group_id"], *others}) == 4
    deep = record("[" * 500 + "]" * 500, 0)
    assert [udf.normalize_command(deep)["error"] for _ in range(2)] == ["command_nesting_limit"] * 2


def test_a_text_is_computed_once_to_be_masked(spark):
    out = spark.createDataFrame([("'wp' = drowssap",)], "t string").select(sc.redact_secrets(sc.F.reverse("t")).alias("r"))
    assert out._jdf.queryExecution().analyzed().toString().count("reverse(t") == 1
    assert out.first()["r"]["text"] == "password = '<redacted>'"


def test_details_sort_no_rows_that_are_not_asked_for(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        copies = [("1", -1, "p", "old"), ("1", 2, "p", "part p"), ("1", 2, "q", "part q"), ("2", 1, "p", "not asked"), ("3", None, None, "bare"), ("", 1, "p", "blank"), (None, 1, "p", "null")]
        rows = spark.createDataFrame(copies, "event_id string, _content_revision bigint, _source_part_key string, v string").repartition(3)
        ids = spark.createDataFrame([("1",), ("1",), ("3",), ("",), ("9",), (None,)], "event_id string").repartition(3)
        for few, join in ((False, "ShuffledHashJoin"), (True, "BroadcastHashJoin")):
            out = search.event_detail(rows, ids, few)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "Sort [" not in plan[plan.index(join) :]  # a plan prints what runs first last
            assert {(r.event_id, r.v) for r in out.collect()} == {("1", "part q"), ("3", "bare"), ("", "blank")} and out.count() == 3
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_details_hash_their_ids_once(spark):
    plan = QUERIES["event_details"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == plan.count("ShuffledHashJoin ") == 1
