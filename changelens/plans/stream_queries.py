"""Queries through files and streams: what is written is read back, and streams run over the stored tables until they are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import scratch_folder, stored
from ..operators import attribution as att
from ..operators import changes as ch
from ..operators import counters as cn
from ..operators import mongo
from ..operators import slow as sl
from ..sources import events as src
from ..sources import telemetry
from ..streaming import keyed, stateful, streams
from ..streaming.keyed import KeyedStore
from . import inputs as i
from .registry import DAY, HOUR, START, over_changes, over_slow, register
from .store_queries import _E, _client_rows, _commands, _events
from .text_queries import general_log_rows

# Files


@register(over_changes("SELECT event_id, event_epoch_us, operation, sql_text, strftime(make_timestamp(event_epoch_us), '%Y-%m-%d') AS event_date, 'h' AS host FROM ev"))
def change_event_files(spark, d):
    """Change events as NDJSON files, operations in small letters."""
    path = scratch_folder(spark)
    rows = i.change_events(spark, d)
    rows.withColumn("operation", F.lower("operation")).drop("event_time_utc", "event_date", "gtid").write.json(path)
    out = src.read_change_ndjson(spark, path, file_id="f", instance_id="i", host_id="h", file_name="b.1")
    return out.select("event_id", "event_epoch_us", "operation", "sql_text", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.col("host_instance_id").alias("host"))


@register(over_changes("SELECT event_id, table_name, '' AS gtid, -1 AS statement_index FROM ev"))
def clustered_event_files(spark, d):
    """Parquet by date, written by days in two files and read again; columns that lack get their defaults."""
    path = scratch_folder(spark)
    src.checked_write(i.change_events(spark, d).drop("gtid", "statement_index"), path, files_per_day=2)
    return src.read_change_parquet(spark, path).select("event_id", "table_name", "gtid", "statement_index")


@register(over_changes(f"SELECT event_id FROM ev WHERE event_epoch_us >= {START + 10 * DAY + 5 * HOUR}"))
def retained_events(spark, d):
    """What a cutoff within a day leaves."""
    path = scratch_folder(spark)
    src.write_change_events(i.change_events(spark, d), path)
    src.apply_retention(spark, path, f"{path}-kept", START + 10 * DAY + 5 * HOUR)
    return spark.read.parquet(f"{path}-kept").select("event_id")


@register(over_changes("SELECT event_id, CASE WHEN operation = 'DELETE' THEN '''=1+1' ELSE sql_text END AS sql_text FROM ev ORDER BY event_epoch_us DESC, event_id DESC LIMIT 300"))
def exported_csv(spark, d):
    """An export that a spreadsheet cannot be made to run."""
    path = scratch_folder(spark)
    rows = i.change_events(spark, d).withColumn("sql_text", F.when(F.col("operation") == "DELETE", "=1+1").otherwise(F.col("sql_text")))
    src.export_csv(rows.select("event_id", "event_epoch_us", "sql_text"), path, 300)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("event_id", "sql_text")


@register(over_slow("SELECT strftime(make_timestamp(event_epoch_us), '%Y-%m') AS month, count(*) AS events, CAST(sum(query_time_ms) AS BIGINT) AS query_time_ms FROM slow GROUP BY 1"))
def slow_fact_files(spark, d):
    path = scratch_folder(spark)
    src.write_slow_facts(sl.canonical_slow(i.slow_events(spark, d)), path, 4)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.sum("query_time_ms").alias("query_time_ms"))


@register(over_changes("SELECT operation, count(*) AS events FROM ev WHERE operation <> 'INSERT' GROUP BY 1"))
def row_store_events(spark, d):
    """Rows that the row store takes: sign-ups name no table here."""
    rows = i.change_events(spark, d).withColumn("table_name", F.when(F.col("operation") == "INSERT", "").otherwise(F.col("table_name")))
    return src.row_store_rows(rows).groupBy("operation").agg(F.count(F.lit(1)).alias("events"))


# Streams


LATE_US = 2 * DAY


def _stream(rows: DataFrame, time_us: str, start) -> None:
    """All rows through a stream that is stopped halfway and started again from its checkpoint.

    Rows arrive up to ``LATE_US`` after their time. What has arrived by the middle of the month is stored in several files and read,
    then the rest. ``start`` gets the streaming rows and the checkpoint's folder and returns the writer.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark)
    files = max(4, spark.sparkContext.defaultParallelism)
    arrival = F.col(time_us) + F.pmod(F.xxhash64(*rows.columns), F.lit(LATE_US))
    for part in (arrival < START + 15 * DAY, arrival >= START + 15 * DAY):
        rows.filter(part).repartition(files).write.mode("append").parquet(f"{folder}/rows")
        writer = start(spark.readStream.schema(rows.schema).parquet(f"{folder}/rows"))
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _kept(rows: DataFrame, time_us: str, build, keys: list[str]) -> DataFrame:
    """What a stateful stream leaves in a keyed store."""
    store = KeyedStore(f"{scratch_folder(rows.sparkSession)}/store", keys)
    _stream(rows, time_us, lambda s: build(s).writeStream.outputMode("update").foreachBatch(store.write))
    return store.read(rows.sparkSession)


def _summed(rows: DataFrame, time_us: str, aggregate) -> DataFrame:
    """The partial aggregates that a stream leaves, batch by batch."""
    path = f"{scratch_folder(rows.sparkSession)}/partials"
    _stream(rows, time_us, lambda s: s.writeStream.foreachBatch(keyed.partial_sums(path, aggregate)))
    return rows.sparkSession.read.parquet(path)


@register(over_slow("SELECT event_id, instance_id FROM slow"))
def streamed_slow_events(spark, d):
    """Slow events that come from two parts, once each."""
    path = f"{scratch_folder(spark)}/slow"
    _stream(i.slow_events(spark, d), "event_epoch_us", lambda s: streams.late_slow_events(s, "3 days").writeStream.format("parquet").option("path", path))
    return spark.read.parquet(path).select("event_id", "instance_id")


@register(over_slow("SELECT event_id, CASE WHEN event_epoch_us < {0} THEN 'stored' ELSE 'tail' END AS side FROM slow".format(START + 15 * DAY)))
def stored_and_tail(spark, d):
    """The tail begins a day before the stored rows end."""
    s = sl.canonical_slow(i.slow_events(spark, d)).select("instance_id", "event_id", "event_epoch_us")
    old = s.filter(F.col("event_epoch_us") < START + 15 * DAY).withColumn("side", F.lit("stored"))
    return streams.stored_and_tail(old, s.filter(F.col("event_epoch_us") >= START + 14 * DAY).withColumn("side", F.lit("tail"))).select("event_id", "side")


@register(over_changes(f"SELECT event_epoch_us - event_epoch_us % {HOUR} AS start_us, instance_id, table_name, operation, count(*) AS events, CAST(sum(execution_time_ms) AS BIGINT) AS exec_time_ms, min(event_epoch_us) AS first_us FROM ev GROUP BY 1, 2, 3, 4"))
def streamed_aggregates(spark, d):
    """Partial aggregates of each batch, added up when they are read."""
    got = keyed.merged_changes(_summed(i.change_events(spark, d), "event_epoch_us", lambda b: keyed.change_partials(b, HOUR)))
    return got.select("start_us", "instance_id", "table_name", "operation", "events", "exec_time_ms", "first_us")


@register(f"WITH {_E} SELECT us - us % 60000000 AS start_us, node_id, count(*) AS count, CAST(sum(k) AS BIGINT) AS k, count(CASE WHEN k % 3 > 0 THEN 1 END) AS v_known FROM e GROUP BY 1, 2")
def streamed_minutes(spark, d):
    rows = _events(spark, d).withColumn("v", F.when(F.col("k") % 3 > 0, F.col("v")))
    parts = _summed(rows, "us", lambda b: keyed.minute_partials(b, ["node_id"], ["k", "v"], "us"))
    return keyed.merged_minutes(parts, ["node_id"], ["k", "v"]).select("start_us", "node_id", "count", "k", "v_known")


@register(f"""WITH {i.COUNTER_CTE.lstrip()}, x AS (SELECT node_id, command, ts_us, calls, usec, lag(ts_us) OVER w AS start_us, lag(calls) OVER w AS c, lag(usec) OVER w AS u FROM counter WINDOW w AS (PARTITION BY node_id, command ORDER BY ts_us))
  SELECT node_id, command, start_us, ts_us AS end_us, CASE WHEN calls < c OR usec < u THEN 'counter_reset' ELSE 'ok' END AS status, CASE WHEN calls >= c AND usec >= u THEN calls - c END AS calls FROM x WHERE start_us IS NOT NULL""")
def streamed_counters(spark, d):
    """Each counter against the one before it, held as state."""
    rows = stored(i.counters(spark, d), scratch_folder(spark), "counters")  # both halves read it
    got = _kept(rows, "ts_us", lambda s: stateful.counter_deltas(s, 3 * DAY), ["node_id", "command", "end_us"])
    return got.select("node_id", "command", "start_us", "end_us", "status", "calls")


@register("""WITH e AS (SELECT 'n' || (user_id % 40) AS node_id, epoch_us(ts) AS us, event_type AS state, lag(event_type) OVER (PARTITION BY user_id % 40 ORDER BY ts) AS before FROM events) SELECT node_id, us AS ts_us, state AS value, before FROM e WHERE before IS NOT NULL AND state <> before""")
def streamed_changes(spark, d):
    """What changed on a node since its last snapshot."""
    e = _events(spark, d)
    rows = e.select(F.concat(F.lit("n"), (F.col("user_id") % 40).cast("string")).alias("node_id"), F.col("us").alias("ts_us"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return _kept(rows, "ts_us", lambda s: stateful.snapshot_changes(s, "state", 3 * DAY, seq="seq"), ["node_id", "ts_us", "seq"]).drop("seq")


@register("""WITH g AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, CASE event_type WHEN 'signup' THEN 'shop' WHEN 'purchase' THEN 'db' || (user_id % 3) WHEN 'error' THEN '' END AS mark FROM events),
  h AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS db FROM g)
  SELECT us AS event_epoch_us, user_id AS thread, db AS database_name, 'SELECT ' || event_id AS sql_text FROM h WHERE event_type = 'view'""")
def streamed_reads(spark, d):
    """Reads with the database that their session holds."""
    got = _kept(general_log_rows(spark, d), "event_epoch_us", lambda s: stateful.general_log_reads(s, 3 * DAY), ["server", "thread", "event_epoch_us", "seq"])
    return got.select("event_epoch_us", "thread", "database_name", "sql_text")


@register(f"""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS us FROM events), m AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY session_id ORDER BY us)), r AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY us) AS run FROM m)
  SELECT session_id, min(us) AS first_us, max(us) AS last_us, count(*) AS seen FROM r GROUP BY session_id, run""")
def streamed_sessions(spark, d):
    rows = i.sightings(spark, d)
    got = _kept(rows, "ts_us", lambda s: stateful.abnormal_sessions(s, 6 * HOUR, 3 * DAY), ["instance_id", "node_id", "session_id", "user", "client", "first_us"])
    return got.select("session_id", "first_us", "last_us", "seen")


@register("SELECT CAST(o_custkey AS VARCHAR) AS uid, o_orderpriority AS ip, min(epoch_us(o_orderdate)) AS first_seen_us, max(epoch_us(o_orderdate)) AS last_seen_us FROM orders GROUP BY 1, 2")
def streamed_bindings(spark, d):
    o = i.table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("ip"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seen_us"))
    return keyed.merged_bindings(_summed(rows, "seen_us", keyed.binding_partials))


@register(over_changes("SELECT event_id, sql_text FROM ev"))
def insert_only_events(spark, d):
    """Batches by days that overlap, the first one written twice; what comes again changes nothing."""
    path = scratch_folder(spark)
    write = streams.insert_only(path)
    rows = i.change_events(spark, d).select("event_id", "sql_text", "event_epoch_us")
    cut = [START, START + 10 * DAY, START + 20 * DAY, START + 40 * DAY]
    for batch, (low, high) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        part = rows.filter((F.col("event_epoch_us") >= low - DAY) & (F.col("event_epoch_us") < high))
        write(part, batch)
        if batch == 0:
            write(part, batch)
    return spark.read.parquet(path).select("event_id", "sql_text")


@register(over_changes(f"SELECT event_epoch_us - event_epoch_us % {DAY} AS hour_us, count(*) AS events FROM ev GROUP BY 1"))
def rebuilt_days(spark, d):
    """Days rebuilt as late halves of the events arrive, one batch twice."""
    path = scratch_folder(spark)
    write = streams.rebuild_hours(f"{path}/facts", f"{path}/days", lambda df: df.groupBy("hour_us").agg(F.count(F.lit(1)).alias("events")), "event_epoch_us", DAY)
    rows = i.change_events(spark, d).select("event_id", "event_epoch_us")
    odd = F.col("event_id").cast("bigint") % 2 == 1
    for batch, part in ((0, rows.filter(odd)), (1, rows.filter(~odd)), (1, rows.filter(~odd))):
        write(part, batch)
    return spark.read.parquet(f"{path}/days").select("hour_us", "events")


# What else grew


@register(over_changes("""
, t AS (SELECT *, CASE WHEN operation = 'INSERT' THEN 'INSERT INTO user_# (id, v) VALUES' ELSE replace(normalized, table_name, 'user_#') END AS template FROM ev)
SELECT substr(sha256('original' || chr(0) || template), 1, 32) AS fingerprint, template AS normalized, 'template' AS level, count(*) AS events, count(DISTINCT start_position) AS executions FROM t GROUP BY 2"""))
def statement_templates(spark, d):
    """Too many texts: templates describe them."""
    stats = ch.statement_stats(i.derived_events(spark, d), max_groups=50)
    return stats.groupBy("fingerprint", "normalized", "level").agg(F.sum("events").alias("events"), F.sum("executions").alias("executions"))


_MOVES = """v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, props, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"""


@register(f"""WITH {_MOVES}, f AS (SELECT user_id, max(n) AS most, arg_max(props, n) AS last FROM v GROUP BY 1), c AS (SELECT * FROM v WHERE before IS DISTINCT FROM props OR (n - 1) % 5 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
  SELECT 'user_' || (c.user_id % 8) AS table_name, CAST(NULL AS VARCHAR) AS first_key, c.user_id || '-' || ((most - 1) // 5) AS last_key, before, props AS after, event_id FROM c JOIN f USING (user_id)""")
def moved_rows(spark, d):
    """Events as versions of a user's row, whose key moves at every fifth: its last real change, through all moves."""
    e = i.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    key = lambda n: F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(n / 5).cast("string"))
    rows = e.withColumn("n", F.row_number().over(w) - 1).select(F.concat(F.lit("user_"), (F.col("user_id") % 8).cast("string")).alias("table_name"), F.when(F.col("n") > 0, key(F.col("n") - 1)).alias("before_key"), key(F.col("n")).alias("after_key"), F.lag("props").over(w).alias("before"), F.col("props").alias("after"), "event_id")
    return ch.moving_row_changes(rows, ["table_name"], "event_id")


@register(f"""WITH {i.SLOW_CTE}, f AS (SELECT node_id, fingerprint AS family, CAST(sum(query_time_ms) FILTER (event_epoch_us >= {START + 15 * DAY}) AS BIGINT) AS now, CAST(sum(query_time_ms) FILTER (event_epoch_us < {START + 15 * DAY}) AS BIGINT) AS before FROM slow GROUP BY 1, 2),
  g AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE greatest(now - before, 0) END AS grown FROM f WHERE now IS NOT NULL) SELECT node_id, family, CASE WHEN grown > 0 THEN row_number() OVER (PARTITION BY node_id ORDER BY grown DESC, family) END AS rank FROM g""")
def exact_growth_rank(spark, d):
    """Scores of 38 digits: the product with the growth, divided by the running time, is still ranked exactly."""
    s = sl.canonical_slow(i.slow_events(spark, d)).withColumn("family", F.col("fingerprint"))
    late = F.col("event_epoch_us") >= START + 15 * DAY
    sums = s.groupBy("node_id", "family").agg(F.sum(F.when(late, F.col("query_time_ms"))).alias("runtime_us"), F.sum(F.when(~late, F.col("query_time_ms"))).alias("before")).filter("runtime_us IS NOT NULL")
    score = (F.col("runtime_us").cast("decimal(38,0)") * F.lit("1" + "0" * 29).cast("decimal(30,0)")).cast("decimal(38,0)")
    ranked = sums.select("node_id", "family", score.alias("score"), F.greatest(F.col("runtime_us") - F.coalesce("before", F.col("runtime_us")), F.lit(0)).alias("growth_us"), "runtime_us", F.lit(0).cast("bigint").alias("scan"))
    return att.fraction_rank(ranked)


@register(f"""WITH {_E}, h AS (SELECT unnest(generate_series({START}, {START + 5 * DAY - 1}, {HOUR})) AS window_us), p AS (SELECT us - us % {HOUR} AS window_us, count(*) AS records, count(*) FILTER (event_id % 50 = 49) AS bad FROM e GROUP BY 1), m AS (SELECT CAST(floor(avg(records)) AS BIGINT) + 1 AS capacity FROM p)
  SELECT window_us, coalesce(records, 0) AS records, CASE WHEN records IS NULL THEN 'missing' WHEN records > capacity THEN 'skipped' WHEN bad > 0 THEN 'unreadable' ELSE 'published' END AS status FROM h LEFT JOIN p USING (window_us), m""")
def window_ledger(spark, d):
    """Hours of five days; those with more records than an average hour are over capacity."""
    commands = stored(_commands(spark, d).select("start_us", "error"), scratch_folder(spark), "commands")
    hours = commands.groupBy(F.floor(F.col("start_us") / HOUR).alias("h")).count()
    capacity = int(hours.agg(F.floor(F.avg("count"))).first()[0]) + 1
    return mongo.window_ledger(commands, START, START + 5 * DAY, capacity, HOUR)


@register(f"""WITH {_E}, r AS (SELECT 'd' || (user_id % 2) AS deployment, event_type AS command, user_id % 40 AS path, us >= {START + 29 * DAY} AS now, k FROM e), n AS (SELECT deployment, command, path, CAST(sum(k) AS BIGINT) AS calls FROM r WHERE now GROUP BY 1, 2, 3), b AS (SELECT deployment, command, path, CAST(sum(k) AS BIGINT) AS calls FROM r WHERE NOT now GROUP BY 1, 2, 3)
  SELECT n.*, n.calls - b.calls AS calls_delta, b.calls IS NOT NULL AS baseline FROM n LEFT JOIN b USING (deployment, command, path)""")
def client_comparison(spark, d):
    """The last day against all days before, by user."""
    rows = _client_rows(spark, d)
    users = _events(spark, d).select(F.col("event_id").alias("batch"), (F.col("user_id") % 40).alias("path"))
    rows = rows.drop("path").join(users, "batch")
    late = F.col("end_us") >= START + 29 * DAY
    out = cn.client_comparison(rows.filter(late), rows.filter(~late), ("deployment", "command", "path"))
    return out.select("deployment", "command", "path", "calls", "calls_delta", "baseline")


@register(f"WITH {_E} SELECT node_id, us - us % 60000000 AS minute_us, 'qps' AS metric, CAST(any_value(k) AS DOUBLE) AS value FROM e GROUP BY 1, 2 HAVING count(*) = 1 UNION ALL SELECT node_id, us - us % 60000000, 'qps', CAST(min(k) AS DOUBLE) FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def cloud_rates(spark, d):
    """The least sample of each minute; a metric that is not asked for is dropped."""
    e = _events(spark, d).groupBy("node_id", (F.floor(F.col("us") / 60_000_000) * 60_000_000).cast("bigint").alias("minute_us")).agg(F.min("k").cast("double").alias("k"))
    payload = F.to_json(F.array(F.struct("minute_us", F.create_map(F.lit("qps"), F.col("k"), F.lit("other"), F.lit(1.0)).alias("values"))))
    return telemetry.redis_cloud_rates(e.select("node_id", payload.alias("payload")), ["qps"])

