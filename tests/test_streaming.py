import uuid

from pyspark.sql import functions as F

from changelens.operators.changes import agg_5m
from changelens.plans import inputs
from changelens.streaming import key_index, keyed, streams

D = "/root/testdata/sf0.001"


def run(spark, df, tmp_path, mode="append", build=lambda x: x, files=3):
    """All rows of ``df`` through a stream in several files."""
    src = str(tmp_path / "src")
    df.repartition(files).write.parquet(src)
    name = "t" + uuid.uuid4().hex
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_late_slow_events_come_once(spark, tmp_path):
    slow = inputs.slow_events(spark, D)
    got = run(spark, slow, tmp_path, build=lambda s: streams.late_slow_events(s, "60 days"))
    assert got.count() == slow.select("instance_id", "event_id").distinct().count()


def test_change_aggregates_equal_the_batch(spark, tmp_path):
    ev = inputs.derived_events(spark, D, 300_000_000)
    got = run(spark, ev, tmp_path, "complete", lambda s: streams.change_aggregates(s, lateness="60 days"))
    want = agg_5m(ev)
    keys = ["database_name", "table_name", "operation", "first_us", "last_us", "events", "executions", "exec_time_ms"]
    merged = got.groupBy("window", "database_name", "table_name", "operation").agg(F.sum("events").alias("events"), F.sum("executions").alias("executions"), F.sum("exec_time_ms").alias("exec_time_ms"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    assert rows_of(merged, *keys) == rows_of(want, *keys)


def test_insert_only_batches_repeat_safely(spark, tmp_path):
    path = str(tmp_path / "audit")
    write = streams.insert_only(path)
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "event_id string, sql_text string")
    write(a, 0)
    write(spark.createDataFrame([("2", "y"), ("2", "z"), ("3", "w")], "event_id string, sql_text string"), 1)
    want = [("1", "x"), ("2", "y"), ("3", "w")]
    assert rows_of(spark.read.parquet(path), "event_id", "sql_text") == want
    assert rows_of(spark.read.parquet(f"{path}_conflicts"), "event_id", "sql_text") == [("2", "z")]
    write(a, 0)
    write(spark.createDataFrame([("2", "y"), ("2", "z"), ("3", "w")], "event_id string, sql_text string"), 1)
    assert rows_of(spark.read.parquet(path), "event_id", "sql_text") == want
    write(a.limit(0), 2)
    write(a, 3)
    assert rows_of(spark.read.parquet(path), "event_id", "sql_text") == want


def test_insert_only_reads_suspected_folders_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    write = streams.insert_only(path)
    make = lambda low, high, text: spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("event_id"), F.lit(text).alias("sql_text"))
    for batch in range(4):
        write(make(batch * 2000, batch * 2000 + 2000, "x"), batch)
    with_buckets = lambda rows: rows.withColumn("_bucket", key_index.bucket_of("event_id", 16))
    fresh = key_index.suspected(with_buckets(make(90_000, 90_050, "x")), f"{path}_index", 4, "event_id").count()
    assert fresh <= 3  # of 64 folders; the filters of 8,000 keys see 50 new ones
    seen = {(r["batch"], r["_bucket"]) for r in key_index.suspected(with_buckets(make(0, 8000, "x")), f"{path}_index", 4, "event_id").collect()}
    assert seen >= {(b, k) for b in range(4) for k in range(16)}
    assert key_index.suspected(with_buckets(make(6000, 8000, "x")), f"{path}_index", 0, "event_id") is None
    again = make(1000, 1003, "x").unionByName(make(5000, 5002, "y")).unionByName(make(90_000, 90_002, "z"))
    want = [("k5000", "y"), ("k5001", "y")]
    for most in (2000, 0):  # named folders, then all of history
        monkeypatch.setattr(streams, "MAX_FOLDERS", most)
        for _ in range(2):
            write(again, 4)
        own = spark.read.parquet(f"{path}/batch={4:012d}")
        assert rows_of(own, "event_id", "sql_text") == [("k90000", "z"), ("k90001", "z")]
        assert rows_of(spark.read.parquet(f"{path}_conflicts/batch={4:012d}"), "event_id", "sql_text") == want
    assert spark.read.parquet(path).count() == 8002


def test_insert_only_keeps_null_keys(spark, tmp_path):
    path = str(tmp_path / "audit")
    write = streams.insert_only(path)
    rows = spark.createDataFrame([(None, "x"), (None, "y"), ("1", "x")], "event_id string, sql_text string")
    write(rows, 0)
    assert spark.read.parquet(path).count() == 2
    assert spark.read.parquet(f"{path}_conflicts").count() == 1


def test_hours_are_rebuilt_with_late_rows(spark, tmp_path):
    h = 3_600_000_000
    write = streams.rebuild_hours(str(tmp_path / "facts"), str(tmp_path / "hours"), lambda df: df.groupBy("hour_us").agg(F.sum("calls").alias("calls")), "ts_us")
    make = lambda rows: spark.createDataFrame(rows, "ts_us long, calls long")
    write(make([(1, 2), (h + 1, 3)]), 0)
    write(make([(5, 10)]), 1)
    write(make([(5, 10)]), 1)
    assert rows_of(spark.read.parquet(str(tmp_path / "hours")), "hour_us", "calls") == [(0, 12), (h, 3)]


def test_bindings_extend(spark, tmp_path):
    df = spark.createDataFrame([("u", "1", 5), ("u", "1", 9), ("u", "2", 7)], "uid string, ip string, seen_us long")
    path = str(tmp_path / "partials")
    write = keyed.partial_sums(path, keyed.binding_partials)
    for n, part in ((0, df.limit(1)), (1, df.filter("seen_us > 5")), (1, df.filter("seen_us > 5"))):
        write(part, n)
    got = keyed.merged_bindings(spark.read.parquet(path))
    assert rows_of(keyed.merged_bindings(spark.read.parquet(path), 8), "uid", "ip") == [("u", "1")]
    assert rows_of(run(spark, df, tmp_path, "complete", streams.binding_intervals), "uid", "ip", "last_seen_us") == rows_of(got, "uid", "ip", "last_seen_us")
    assert rows_of(got, "uid", "ip", "first_seen_us", "last_seen_us") == [("u", "1", 5, 9), ("u", "2", 7, 7)]


def test_tail_joins_only_where_not_stored(spark):
    a = spark.createDataFrame([("i", "1", "stored")], "instance_id string, event_id string, x string")
    b = spark.createDataFrame([("i", "1", "tail"), ("i", "2", "tail")], "instance_id string, event_id string, x string")
    assert rows_of(streams.stored_and_tail(a, b), "event_id", "x") == [("1", "stored"), ("2", "tail")]
