import json

import pytest
from pyspark.sql import functions as F

from changelens.operators.mongo import mongo_analyze, mongo_events, publishable_windows
from changelens.sources import events as ev
from changelens.sources import logs, telemetry


def test_ndjson_round_trip(spark, tmp_path):
    rows = [{"event_epoch_us": 1_700_000_000_000_000, "operation": "insert", "database_name": "d", "table_name": "t", "start_position": 4, "sql_text": "=cmd"}, {"event_id": "x", "event_epoch_us": 1_700_100_000_000_000, "database_name": "d", "table_name": "t"}]
    path = tmp_path / "in.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    names = {"file_id": "f", "instance_id": "i", "host_id": "h", "file_name": "bin.1"}
    df = ev.read_change_ndjson(spark, str(path), **names)
    got = {r.operation: r for r in df.collect()}
    assert got["INSERT"].event_id and len(got["INSERT"].event_id) == 64 and got["INSERT"].statement_index == -1
    assert got["OTHER"].event_id == "x" and got["OTHER"].instance_id == "i"
    out = str(tmp_path / "out")
    assert ev.checked_write(df, out, 2) == 2
    back = ev.read_change_parquet(spark, out)
    assert back.count() == 2 and set(df.columns) <= set(back.columns)
    narrow = str(tmp_path / "narrow")
    df.select("event_epoch_us", "operation", "database_name", "table_name").write.parquet(narrow)
    assert ev.read_change_parquet(spark, narrow).first().statement_index == -1
    df.select("operation").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="columns missing"):
        ev.read_change_parquet(spark, str(tmp_path / "bad"))
    ev.apply_retention(spark, out, str(tmp_path / "kept"), 1_700_050_000_000_000)
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == ["x"]
    assert {r.sql_text for r in ev.csv_rows(df).collect()} == {"'=cmd", ""}
    facts, words = ev.split_statement_text(df.withColumn("row_query", F.lit("select 1")))
    assert words.count() == 2 and facts.filter("row_query_hash = 0").count() == 0
    path.write_text(json.dumps({"event_epoch_us": 0, "operation": "x"}))
    with pytest.raises(Exception, match="no time"):
        ev.read_change_ndjson(spark, str(path), **names).collect()


SLOW = "SQLText string, Timestamp long, QueryStartTime string, AccountName string, HostAddress string, NodeId string, SqlId string, ThreadId long, QueryTime double, LockTime double, RowsExamined long, RowsSent long, DBName string, TableName string, SqlType string"


def test_slow_source(spark):
    base = ("select 1", 1000, "2024-01-01 00:00:00", "app", "h:1", "", "s", 1, 5.4, 1.0, 3, 1, "d", "t", None)
    rows = [base, base, ("", *base[1:]), (*base[:3], "Monitor", *base[4:]), ("delete from t", None, None, *base[3:]), ("update t set a=1", None, *base[2:14], "UPDATE")]
    df = spark.createDataFrame(rows, SLOW)
    got = logs.slow_events(df, instance_id="i", default_node="n0", exclude_accounts=["monitor"])
    assert {(r.operation, r.event_epoch_us, r.node_id, r.client_ip) for r in got.collect()} == {("SELECT", 1_000_000, "n0", "h"), ("UPDATE", 1_704_067_200_000_000, "n0", "h")}
    assert logs.slow_events(df, instance_id="i", default_node="n0", seen=got.select("event_id")).filter("database_account = 'app'").count() == 0


GENERAL = [(1, "Connect", "app@h on shop using TCP"), (2, "Query", "select 1"), (3, "Query", "use other"), (4, "Query", "select 2"), (5, "Quit", ""), (6, "Query", "select 3"), (7, "Init DB", "third"), (8, "Query", "update t set a=1"), (9, "Query", "show tables"), (9, "Query", "show tables")]


def test_general_log(spark):
    df = spark.createDataFrame([("s", 1, k, t, "app", c, a) for k, (t, c, a) in enumerate(GENERAL)], "server string, thread long, seq long, event_epoch_us long, user string, command string, argument string")
    got = logs.general_log_events(df, instance_id="i").orderBy("event_epoch_us").collect()
    assert [(r.sql_text, r.database_name) for r in got] == [("select 1", "shop"), ("select 2", "other"), ("select 3", ""), ("show tables", "third"), ("show tables", "third")]
    assert len({r.event_id for r in got}) == 5
    assert logs.general_log_events(df, instance_id="i", exclude_users=["APP"]).count() == 0


def test_audit_is_insert_only(spark):
    cols = "event_id string, instance_id string, execution_status string, started_epoch_us long, finished_epoch_us long, sql_text string"
    new = spark.createDataFrame([("a", "i", "SUCCESS", 1, 2, "x"), ("b", "i", "SUCCESS", 1, 2, "old"), ("c", "i", "SUCCESS", 1, 2, "other"), ("d", "i", "WHAT", 1, 2, ""), ("e", "i", "FAILED", 5, 2, ""), ("f", "z", "FAILED", 1, 2, ""), ("g", "i", "SUCCESS", 1, 2, "pwd = 'k'"), ("h", "i", "SUCCESS", 1, 2, "one"), ("h", "i", "SUCCESS", 1, 2, "one"), (None, "i", "SUCCESS", 1, 2, "")], cols)
    old = spark.createDataFrame([("b", "i", "SUCCESS", 1, 2, "old"), ("c", "i", "SUCCESS", 1, 2, "first")], cols)
    ok, again, no = logs.ingest_audit(new, old, ["i"])
    assert {r.event_id: r.sql_text for r in ok.collect()} == {"a": "x", "g": "pwd = '<redacted>'", "h": "one"}
    assert sorted(r.event_id for r in again.collect()) == ["b", "h"]
    assert {r.event_id: r.reason for r in no.collect()} == {"c": "AUDIT_ID_CONFLICT", "d": "AUDIT_STATUS", "e": "AUDIT_TIME", "f": "AUDIT_INSTANCE", None: "AUDIT_ID_MISSING"}


INFO = "# Server\r\nuptime_in_seconds:100\r\nrun_id:abc\r\n# Stats\r\ncmdstat_get:calls=5,usec=50,usec_per_call=10.00,rejected_calls=0,failed_calls=1\r\nused_cpu_sys:1.5\r\nused_memory:10\r\ndb0:keys=3,expires=1,avg_ttl=0\r\nerrorstat_ERR:count=2\r\n"


def test_redis_info(spark):
    r = telemetry.redis_snapshots(spark.createDataFrame([("n", 1, INFO)], "node_id string, ts_us long, info string")).first()
    assert (r.uptime_s, r.epoch, r.cpu.sys, r.gauges) == (100, "abc", 1.5, {"used_memory": 10.0})
    assert (r.commands[0].command, r.commands[0].calls, r.commands[0].failed_calls) == ("get", 5, 1)
    assert r.key_spaces[0].db == "db0" and r.errors[0]["count"] == 2 and "evicted_keys" in r.missing
    with pytest.raises(Exception, match="without uptime"):
        telemetry.redis_snapshots(spark.createDataFrame([("n", 1, "run_id:x")], "node_id string, ts_us long, info string")).collect()


def test_client_batches(spark):
    cols = "instance string, process string, batch string, start_us long, end_us long, totals map<string,bigint>, rows array<struct<command:string,shape:string,calls:bigint,errors:bigint,latency_known_calls:bigint>>"
    row = ("get", "user:*", 3, 0, 3)
    good = ("i", "p", "b1", 0, 10, {"get": 3}, [row])
    rows = [good, good, ("i", "p", "b2", 0, 10, {"get": 4}, [row]), ("i", "p", "b3", 0, 10, {"get": 3}, [("get", "user:12:x", 3, 0, 3)]), ("i", "p", "b4", 0, 10**9, {"get": 3}, [row])]
    ok, bad = telemetry.client_batches(spark.createDataFrame(rows, cols))
    assert [(r.batch, r.row_id, r.calls) for r in ok.collect()] == [("b1", 0, 3)]
    assert {r.batch: r.reason for r in bad.collect()} == {"b2": "totals", "b3": "raw_key", "b4": "window"}


def test_metric_points_are_never_relabelled(spark):
    df = spark.createDataFrame([("i", "n", "cpu", 1, 1.0), ("j", "n", "cpu", 1, 2.0)], "instance_id string, node_id string, metric string, timestamp_ms long, value double")
    with pytest.raises(Exception, match="another instance"):
        telemetry.read_metric_points(df, instance="i").collect()
    assert telemetry.without_conflicts(df).count() == 0


def test_inventory_and_logs(spark):
    pods = {"items": [{"metadata": {"name": "a", "namespace": "x", "uid": "u", "creationTimestamp": "2024-01-01T00:00:00Z"}, "spec": {"nodeName": "n"}, "status": {"hostIP": "9", "podIPs": [{"ip": "1"}, {"ip": "1"}]}}, {"metadata": {"name": "h"}, "spec": {"hostNetwork": True}, "status": {"podIPs": [{"ip": "2"}]}}]}
    got = telemetry.pod_bindings(spark.createDataFrame([("c", 5, json.dumps(pods))], "cluster string, seen_us long, payload string")).collect()
    assert [(r.ip, r.name, r.created_us) for r in got] == [("1", "a", 1_704_067_200_000_000)]
    hosts = [{"InstanceId": "i", "InstanceName": "h", "PrivateIps": ["1", "2"], "EipAddress": "2", "PublicIps": []}]
    assert sorted(r.ip for r in telemetry.host_addresses(spark.createDataFrame([(json.dumps(hosts),)], "payload string")).collect()) == ["1", "2"]
    lines = [(k * 1_000_000, f'h - "GET /api/list?shop_id=s{k}&page=2 HTTP/1.1" {429 if k == 2 else 200} duration=1m2.5s') for k in range(5)]
    got = logs.http_log_rows(spark.createDataFrame(lines, "ts_us long, line string"), "/api/").collect()
    assert [(r.shop, r.page, r.duration_ms, r.throttled) for r in got] == [("s1", 2, 62500.0, False), ("s2", 2, 62500.0, True), ("s3", 2, 62500.0, False)]
    points = telemetry.performance_points(spark.createDataFrame([("n", 1, "cpu_usage&qps", "150&7")], "node_id string, ts_us long, value_format string, value string"))
    assert [(r.metric, r.value) for r in points.collect()] == [("qps", 7.0)]


def test_mongo_windows_publish_whole(spark):
    text = '{"ns":"d.c","command":{"find":"c","filter":{"a":1}},"millis":3,"docsExamined":9}'
    rows = [(text, "2024-01-01T00:00:01Z", 3, "h:1", "u"), (text, "2024-01-01T00:06:00Z", 3, "h:1", "u"), ("{cut", "2024-01-01T00:06:01Z", 1, "h:2", "u")]
    out = mongo_events(spark.createDataFrame(rows, "SQLText string, ExecutionStartTime string, QueryTimes long, HostAddress string, AccountName string"), "i")
    assert out.filter("error IS NOT NULL").count() == 1
    assert [r.window_us for r in publishable_windows(out).collect()] == [1_704_067_200_000_000]
    cols = "role string, group_id string, count long, overlap_us long, max_us long, docs long, docs_known long"
    now = spark.createDataFrame([("p", "g", 4, 8, 2, 40, 4), ("p", "new", 1, 1, 1, 1, 1)], cols)
    old = spark.createDataFrame([("p", "g", 2, 4, 2, 10, 2)], cols)
    got = {r.group_id: r for r in mongo_analyze(now, old, ("docs",)).collect()}
    assert (got["g"].docs_delta, got["g"].docs_frequency, got["g"].docs_per_call) == (30, 10.0, 20.0)
    assert got["new"].docs_delta is None and not got["new"].baseline


def test_store_sessions_and_provider_events(spark):
    ops = {"inprog": [{"opid": "1", "op": "query", "ns": "d.c", "client": "h:1", "secs_running": 90, "active": True, "waitingForLock": True}, {"opid": "2", "op": "none", "active": False, "transaction": {"timeOpenMicros": 50_000_000}}]}
    got = telemetry.store_sessions(spark.createDataFrame([("i", "n", 1, json.dumps(ops))], "instance_id string, node_id string, ts_us long, payload string")).collect()
    assert {r.session_id: r.kinds for r in got} == {"1": ["long_running", "lock_wait"], "2": ["long_trx", "idle_trx"]}
    events = json.dumps([{"kind": "failover", "secret": "x"}, {"kind": "failover", "secret": "y"}])
    out = telemetry.provider_events(spark.createDataFrame([("n", events)], "node_id string, payload string"), ["kind"]).collect()
    assert [r.fields for r in out] == [{"kind": "failover"}]


def test_default_database_is_never_guessed(spark):
    from changelens.operators.search import with_default_database

    owners = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t2")], "database_name string, table_name string")
    texts = ["select * from x.t9", "select * from t1", "select * from t2", "select 1", "/* db=q */ select * from t2"]
    got = {r.sql_text: (r.default_database, r.database_reason) for r in with_default_database(spark.createDataFrame([(t,) for t in texts], "sql_text string"), owners).collect()}
    assert [got[t] for t in texts] == [("x", "qualified"), ("a", "unique_owner"), (None, "ambiguous"), (None, "unknown"), ("q", "comment")]
