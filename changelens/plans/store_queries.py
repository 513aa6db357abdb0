"""Queries on counters, key-value, document and OLAP stores, metrics and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket, key_shape
from ..functions.storage import scratch_folder, stored
from ..operators import counters as cn
from ..operators import mongo
from ..sources import telemetry
from . import inputs as i
from .queries import _DELTA
from .registry import DAY, HOUR, START, register


def _events(spark, d) -> DataFrame:
    """Events with the columns that the queries here start from."""
    e = i.table(spark, d, "events")
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.floor(F.col("value") * 100).cast("bigint").alias("v"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"),
    )


_E = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) AS v, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS k, 'n' || (user_id % 3) AS node_id FROM events)"

# Counters

_OK = f"""{_DELTA}, ok AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.node_id = l.node_id AND o.end_us = l.end_us AND (o.calls < 0 OR o.usec < 0)))"""


@register(f"""{_OK}, w AS (SELECT * FROM ok WHERE start_us >= {START} AND end_us <= {START + 15 * DAY}), s AS (SELECT node_id, sum(end_us - start_us) / 1000000 AS seconds FROM (SELECT DISTINCT node_id, start_us, end_us FROM w) GROUP BY 1)
  SELECT node_id, command, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(usec) AS BIGINT) AS usec, round(any_value(seconds), 6) AS seconds, round(sum(calls) / any_value(seconds), 9) AS qps, round(sum(usec) / nullif(sum(calls), 0), 6) AS avg_us FROM w JOIN s USING (node_id) GROUP BY 1, 2""")
def interval_summary(spark, d):
    out = cn.interval_summary(cn.counter_deltas(i.counters(spark, d)), START, START + 15 * DAY)
    return out.select("node_id", "command", "calls", "usec", F.round("seconds", 6).alias("seconds"), F.round("qps", 9).alias("qps"), F.round("avg_us", 6).alias("avg_us"))


@register(f"""{_OK}, p AS (SELECT *, CASE WHEN start_us >= {START + 10 * DAY} AND end_us <= {START + 20 * DAY} THEN 1 WHEN start_us >= {START} AND end_us <= {START + 10 * DAY} THEN 0 END AS p FROM ok),
  s AS (SELECT node_id, p, sum(end_us - start_us) AS seen FROM (SELECT DISTINCT node_id, p, start_us, end_us FROM p WHERE p IS NOT NULL) GROUP BY 1, 2), g AS (SELECT node_id, command, p, CAST(sum(calls) AS BIGINT) AS calls FROM p WHERE p IS NOT NULL GROUP BY 1, 2, 3)
  SELECT a.node_id, a.command, a.calls, b.calls AS calls_before, CASE WHEN x.seen >= 0.6 * {10 * DAY} AND y.seen >= 0.6 * {10 * DAY} THEN a.calls - b.calls END AS calls_delta FROM g a JOIN s x ON x.node_id = a.node_id AND x.p = 1 LEFT JOIN g b ON b.node_id = a.node_id AND b.command = a.command AND b.p = 0 LEFT JOIN s y ON y.node_id = a.node_id AND y.p = 0 WHERE a.p = 1""")
def counter_window(spark, d):
    """Ten days against the ten before, compared where three fifths of both were observed."""
    out = cn.counter_window(cn.counter_deltas(i.counters(spark, d)), START + 10 * DAY, START + 20 * DAY, least_cover=0.6)
    return out.select("node_id", "command", "calls", "calls_before", "calls_delta")


@register(f"""{_OK}, q AS (SELECT *, end_us - end_us % 60000000 + 60000000 AS minute_us FROM ok), s AS (SELECT node_id, minute_us, sum(end_us - start_us) / 1000000 AS seconds FROM (SELECT DISTINCT node_id, minute_us, start_us, end_us FROM q) GROUP BY 1, 2 HAVING seconds BETWEEN 600 AND 6000)
  SELECT node_id, minute_us, command, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(usec) AS BIGINT) AS usec, round(any_value(seconds), 6) AS seconds FROM q JOIN s USING (node_id, minute_us) GROUP BY 1, 2, 3""")
def minute_rates(spark, d):
    """Minutes at whose end between ten and a hundred minutes had been observed."""
    out = cn.minute_rates(cn.counter_deltas(i.counters(spark, d)), 600, 6000)
    return out.select("node_id", "minute_us", "command", "calls", "usec", F.round("seconds", 6).alias("seconds"))


@register(f"""{_OK} SELECT node_id, command, (end_us - 1 + {8 * HOUR}) - (end_us - 1 + {8 * HOUR}) % {DAY} - {8 * HOUR} AS bucket_us, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(usec) AS BIGINT) AS usec, round(sum(end_us - start_us) / 1000000, 6) AS known_s FROM ok GROUP BY 1, 2, 3""")
def counter_daily_rollup(spark, d):
    """Days of a time zone eight hours ahead."""
    out = cn.counter_rollup(cn.counter_deltas(i.counters(spark, d)), DAY, 8 * HOUR)
    return out.withColumn("known_s", F.round("known_s", 6))


@register(f"""WITH {_E}, s AS (SELECT 'n' || (user_id % 6) AS node_id, event_type AS command, sum(v) / count(*) AS avg_us FROM e GROUP BY 1, 2 HAVING count(*) >= 10),
  r AS (SELECT node_id, avg_us / median(avg_us) OVER (PARTITION BY command) AS ratio FROM s QUALIFY count(*) OVER (PARTITION BY command) >= 3) SELECT node_id, round(median(ratio), 6) AS index, count(*) AS commands FROM r GROUP BY 1""")
def node_cost_index(spark, d):
    e = _events(spark, d)
    sums = e.groupBy(F.concat(F.lit("n"), (F.col("user_id") % 6).cast("string")).alias("node_id"), F.col("event_type").alias("command")).agg(F.count(F.lit(1)).alias("calls"), F.sum("v").alias("usec")).withColumn("seconds", F.lit(1.0))
    return cn.node_index(cn.unit_costs(sums, least_calls=10)).select("node_id", F.round("index", 6).alias("index"), "commands")


_NIGHT = f"(us + {8 * HOUR}) % {DAY} >= {3 * HOUR} AND (us + {8 * HOUR}) % {DAY} < {5 * HOUR}"


def _gauges(spark, d) -> DataFrame:
    return _events(spark, d).select("node_id", F.col("event_type").alias("metric"), F.col("us").alias("ts_us"), F.col("v").cast("double").alias("value"))


@register(f"WITH {_E} SELECT node_id, event_type AS metric, round(avg(v), 6) AS baseline, count(*) AS points FROM e WHERE {_NIGHT} GROUP BY 1, 2")
def night_baseline(spark, d):
    return cn.night_baseline(_gauges(spark, d)).withColumn("baseline", F.round("baseline", 6))


@register(f"WITH {_E} SELECT node_id, event_type AS metric, (us + {8 * HOUR}) - (us + {8 * HOUR}) % {DAY} - {8 * HOUR} AS day_us, round(avg(v), 6) AS mean, round(avg(v) FILTER ({_NIGHT}), 6) AS baseline, round(avg(v) - avg(v) FILTER ({_NIGHT}), 6) AS delta FROM e GROUP BY 1, 2, 3")
def against_night(spark, d):
    return cn.against_night(_gauges(spark, d)).select("node_id", "metric", "day_us", *[F.round(c, 6).alias(c) for c in ("mean", "baseline", "delta")])


# Key-value stores


@register(f"WITH {_E} SELECT CASE WHEN user_id % 2 = 0 THEN 'user:*' ELSE event_type || ':*' END AS key_shape, count(*) AS keys, CAST(sum(v) AS BIGINT) AS bytes, CAST(sum(k) AS BIGINT) AS expires, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS types FROM e GROUP BY 1")
def key_shape_profile(spark, d):
    """Keys made of users and event types; numbers become stars."""
    e = _events(spark, d)
    key = F.concat(F.when(F.col("user_id") % 2 == 0, "user").otherwise(F.col("event_type")), F.lit(":"), F.col("event_id").cast("string"))
    rows = e.select(key_shape(key, ["user", "click", "view", "error", "signup", "purchase"]).alias("key_shape"), F.lit(1).alias("keys"), F.col("v").alias("bytes"), F.col("k").alias("expires"), F.col("node_id").alias("type"))
    return cn.prefix_profile(rows).withColumn("types", F.array_join("types", ","))


def _client_rows(spark, d) -> DataFrame:
    """Client counter rows; every third comes twice."""
    e = _events(spark, d)
    rows = e.select(F.lit("i").alias("instance"), F.lit("p").alias("process"), F.col("event_id").alias("batch"), F.lit(0).alias("row_id"), F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("deployment"), F.col("event_type").alias("command"), F.lit("user:*").alias("shape"), F.col("node_id").alias("path"), F.lit("").alias("script"), F.col("k").alias("calls"), (F.col("k") % 3).alias("errors"), F.col("v").alias("client_us"), F.concat(F.lit("pod"), (F.col("user_id") % 5).cast("string")).alias("pod"), F.col("us").alias("end_us"))
    return rows.unionByName(rows.filter("batch % 3 = 0"))


@register(f"WITH {_E} SELECT 'd' || (user_id % 2) AS deployment, event_type AS command, node_id AS path, CAST(sum(k) AS BIGINT) AS calls, CAST(sum(k % 3) AS BIGINT) AS errors, CAST(sum(v) AS BIGINT) AS client_us, count(DISTINCT user_id % 5) AS pods FROM e GROUP BY 1, 2, 3")
def client_summary(spark, d):
    return cn.client_summary(_client_rows(spark, d)).select("deployment", "command", "path", "calls", "errors", "client_us", "pods")


@register(f"WITH {_E}, s AS (SELECT event_type AS command, CAST(sum(v) AS BIGINT) AS server_calls FROM e WHERE event_type <> 'error' GROUP BY 1), c AS (SELECT event_type AS command, CAST(sum(k) AS BIGINT) AS client_calls FROM e WHERE event_type <> 'view' GROUP BY 1) SELECT command, server_calls, client_calls, server_calls - client_calls AS difference, false AS comparable FROM s FULL JOIN c USING (command)")
def reconciled_calls(spark, d):
    e = _events(spark, d)
    server = e.filter("event_type <> 'error'").select(F.col("event_type").alias("command"), F.col("v").alias("calls"))
    return cn.reconcile_calls(server, e.filter("event_type <> 'view'").select(F.col("event_type").alias("command"), F.col("k").alias("calls")))


_HITS = f"""h AS (SELECT node_id, event_type AS key, us - us % {HOUR} AS t, CAST(sum(k) AS BIGINT) AS x FROM e GROUP BY 1, 2, 3), m AS (SELECT node_id, us - us % {HOUR} AS t, CAST(sum(v) AS BIGINT) AS y FROM e GROUP BY 1, 2)"""


def _minutes(us):
    """Hours as minutes, so that neighbouring ones are a minute apart."""
    return (F.floor(us / HOUR) * 60_000_000).cast("bigint")


@register(f"""WITH {_E}, {_HITS}, j AS (SELECT node_id, key, t, x, y, t - lag(t) OVER w = {HOUR} AS near, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM h JOIN m USING (node_id, t) WINDOW w AS (PARTITION BY node_id, key ORDER BY t))
  SELECT node_id, key, CAST(sum(x) AS BIGINT) AS total, count(*) FILTER (near) AS n, CASE WHEN count(*) FILTER (near) >= 6 THEN round(corr(dx, dy) FILTER (near), 6) END AS r FROM j GROUP BY 1, 2""")
def hot_keys(spark, d):
    """Event types as keys against their node's metric, by hour-to-hour changes."""
    e = _events(spark, d)
    hits = e.groupBy("node_id", F.col("event_type").alias("key"), _minutes(F.col("us")).alias("minute_us")).agg(F.sum("k").alias("hits"))
    metric = e.groupBy("node_id", _minutes(F.col("us")).alias("minute_us")).agg(F.sum("v").alias("value"))
    return cn.hot_keys(hits, metric).select("node_id", "key", "total", "n", F.round("r", 6).alias("r"))


@register(f"""WITH {_E}, c AS (SELECT 'd' || (user_id % 2) AS deployment, event_type AS command, us - us % {HOUR} AS t, CAST(sum(v) AS BIGINT) AS x FROM e GROUP BY 1, 2, 3), m AS (SELECT us - us % {HOUR} AS t, CAST(sum(k) AS BIGINT) AS y FROM e GROUP BY 1),
  j AS (SELECT deployment, command, x, t - lag(t) OVER w = {HOUR} AS near, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM c JOIN m USING (t) WINDOW w AS (PARTITION BY deployment, command ORDER BY t))
  SELECT deployment, command, CAST(sum(x) AS BIGINT) AS total, count(*) FILTER (near) AS n, CASE WHEN count(*) FILTER (near) >= 6 THEN round(corr(dx, dy) FILTER (near), 6) END AS r FROM j GROUP BY 1, 2""")
def client_shapes(spark, d):
    e = _events(spark, d)
    calls = e.select(F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("deployment"), F.col("event_type").alias("command"), F.lit("s").alias("shape"), _minutes(F.col("us")).alias("minute_us"), F.col("v").alias("client_us"))
    metric = e.groupBy("node_id", _minutes(F.col("us")).alias("minute_us")).agg(F.sum("k").alias("value"))
    return cn.client_shapes(calls, metric).select("deployment", "command", "total", "n", F.round("r", 6).alias("r"))


def _info(spark, d) -> DataFrame:
    """INFO texts: one a day and node, with running totals of what the events say."""
    e = _events(spark, d)
    daily = e.groupBy("node_id", bucket(F.col("us"), DAY).alias("ts_us")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("k").alias("k"))
    line = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    text = F.concat_ws("\r\n", F.lit("# Server"), F.lit("uptime_in_seconds:5"), F.concat(F.lit("run_id:"), F.col("node_id")), line("used_cpu_sys", "k"), line("used_cpu_user", "n"), line("used_memory", "v"), line("total_commands_processed", "n"), F.concat(F.lit("cmdstat_get:calls="), F.col("n"), F.lit(",usec="), F.col("v"), F.lit(",rejected_calls=0,failed_calls=1")), F.concat(F.lit("db0:keys="), F.col("k"), F.lit(",expires=2")))
    return daily.select("node_id", "ts_us", text.alias("info"))


_INFO = f"i AS (SELECT node_id, us - us % {DAY} AS ts_us, count(*) AS n, CAST(sum(v) AS BIGINT) AS v, CAST(sum(k) AS BIGINT) AS k FROM e GROUP BY 1, 2)"


@register(f"WITH {_E}, {_INFO} SELECT node_id, ts_us, node_id AS epoch, 'get' AS command, n AS calls, v AS usec, 1 AS failed_calls FROM i")
def command_counters(spark, d):
    out = telemetry.command_counters(telemetry.redis_snapshots(_info(spark, d)))
    return out.select("node_id", "ts_us", "epoch", "command", "calls", "usec", "failed_calls")


@register(f"""WITH {_E}, {_INFO}, f AS (SELECT node_id, arg_min(k + n, ts_us) AS cpu_first, arg_max(k + n, ts_us) AS cpu_last, arg_min(n, ts_us) AS n_first, arg_max(n, ts_us) AS n_last, arg_min(v, ts_us) AS memory_first, arg_max(v, ts_us) AS memory_last FROM i GROUP BY 1)
  SELECT node_id, memory_first, memory_last, memory_last - memory_first AS memory_delta, CASE WHEN n_last > n_first THEN round((cpu_last - cpu_first) / (n_last - n_first), 6) END AS cpu_per_command FROM f""")
def store_layers(spark, d):
    out = cn.redis_layers(telemetry.redis_snapshots(_info(spark, d)))
    return out.select("node_id", "memory_first", "memory_last", "memory_delta", F.round("cpu_per_command", 6).alias("cpu_per_command"))


# Metrics and logs


@register(f"""WITH {i.METRIC_CTE.lstrip()}, h AS (SELECT unnest(generate_series({START + HOUR}, {START + 10 * DAY}, {HOUR})) AS end_us), n AS (SELECT DISTINCT node_id FROM metric),
  f AS (SELECT node_id, end_us, value FROM n CROSS JOIN h LEFT JOIN metric USING (node_id, end_us)), s AS (SELECT node_id, count(value) FILTER (end_us > {START + 5 * DAY}) AS n_now, count(value) FILTER (end_us <= {START + 5 * DAY}) AS n_before, round(avg(value * 1000) FILTER (end_us > {START + 5 * DAY}), 3) AS now, round(avg(value * 1000) FILTER (end_us <= {START + 5 * DAY}), 3) AS before FROM f GROUP BY 1)
  SELECT node_id, n_now, n_before, now, before, CASE WHEN n_now = 120 AND n_before = 120 THEN round(now - before, 2) END AS change FROM s""")
def metric_comparison(spark, d):
    """Five days against the five before; a difference only where no hour of either lacks."""
    points = i.metric_points(spark, d).withColumn("epoch", F.lit("e"))
    mid, end = START + 5 * DAY, START + 10 * DAY
    out = cn.metric_comparison(cn.metric_windows(points, mid, end, HOUR), cn.metric_windows(points, START, mid, HOUR))
    return out.select("node_id", "n_now", "n_before", F.round("now", 3).alias("now"), F.round("before", 3).alias("before"), F.round("change", 2).alias("change"))


@register(f"""WITH {_E}, s AS (SELECT node_id, us - us % {HOUR} + {HOUR} AS end_us, count(*) AS queued FROM e WHERE event_type <> 'purchase' GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'error') = 0),
  m AS (SELECT *, CASE WHEN end_us - lag(end_us) OVER (PARTITION BY node_id ORDER BY end_us) = {HOUR} THEN 0 ELSE 1 END AS f FROM s), r AS (SELECT *, sum(f) OVER (PARTITION BY node_id ORDER BY end_us) AS run FROM m)
  SELECT node_id, min(end_us) AS first_us, max(end_us) AS last_us, count(*) AS periods, max(queued) AS peak FROM r GROUP BY node_id, run HAVING count(*) >= 2""")
def pressure_runs(spark, d):
    """Hours without an error as hours without a free ticket, their events as those that queue."""
    e = _events(spark, d).filter("event_type <> 'purchase'")
    frames = e.groupBy("node_id", (bucket(F.col("us"), HOUR) + HOUR).alias("end_us")).agg(F.count_if(F.col("event_type") == "error").alias("available"), F.count(F.lit(1)).alias("queued"))
    return cn.pressure_runs(frames.withColumn("role", F.lit("primary")), HOUR).drop("role")


@register(f"""WITH {_E}, p AS (SELECT node_id, us - us % {DAY} + {DAY} AS end_us, min(k) AS available, max(v) AS queued, max(CASE WHEN event_type = 'error' THEN v END) AS eviction, max(k) AS cache FROM e GROUP BY 1, 2),
  s AS (SELECT node_id, end_us, queued FROM p WHERE available = 0 AND queued > 0), m AS (SELECT *, CASE WHEN end_us - lag(end_us) OVER (PARTITION BY node_id ORDER BY end_us) = {DAY} THEN 0 ELSE 1 END AS f FROM s), r AS (SELECT *, sum(f) OVER (PARTITION BY node_id ORDER BY end_us) AS run FROM m),
  x AS (SELECT node_id, min(end_us) AS saturated_us, max(queued) AS peak_queue FROM (SELECT *, count(*) OVER (PARTITION BY node_id, run) AS n FROM r) WHERE n >= 2 GROUP BY 1),
  c AS (SELECT node_id, arg_min(cache, end_us) AS a, arg_max(cache, end_us) AS b, count(*) AS observed, min(end_us) FILTER (eviction > 0) AS evicted_us FROM p GROUP BY 1)
  SELECT node_id, CASE WHEN saturated_us IS NULL THEN 'not_saturated' WHEN evicted_us <= saturated_us AND b > a THEN 'eviction_then_saturation' ELSE 'saturation' END AS status, saturated_us, peak_queue, evicted_us, observed FROM c LEFT JOIN x USING (node_id)""")
def pressure_evidence(spark, d):
    """Days as periods: the least ``k`` as tickets, the largest value as queue, errors as evictions, the largest ``k`` as cache."""
    e = _events(spark, d)
    at = (bucket(F.col("us"), DAY) + DAY).alias("end_us")
    metrics = {"tickets_available": F.min("k"), "tickets_queued": F.max("v"), "eviction": F.max(F.when(F.col("event_type") == "error", F.col("v"))), "cache_update": F.max("k")}
    wide = e.groupBy("node_id", at).agg(*[v.alias(name) for name, v in metrics.items()])
    points = wide.select(F.lit("primary").alias("role"), "node_id", "end_us", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select("role", "node_id", "end_us", "x.*").filter("value IS NOT NULL")
    return mongo.pressure_evidence(points, DAY).drop("role")


@register(f"""WITH {_E}, s AS (SELECT 'r' || (user_id % 2) AS role, us - 1 - (us - 1) % {HOUR} + {HOUR} AS end_us, node_id, us, v FROM e WHERE event_type = 'click')
  SELECT role, end_us, any_value(node_id) AS node_id, arg_max(v, us) AS value FROM s GROUP BY 1, 2 HAVING count(DISTINCT node_id) = 1""")
def lock_wait_points(spark, d):
    """Clicks as samples of their hour, which one node alone must have."""
    e = _events(spark, d).filter("event_type = 'click'")
    samples = e.select(F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("role"), "node_id", F.col("us").alias("ts_us"), F.col("v").alias("value"))
    return cn.lock_wait_points(samples, HOUR)


@register(f"WITH {_E}, p AS (SELECT event_type AS category, user_id AS pod, count(*) AS n FROM e GROUP BY 1, 2) SELECT category, pod, n, round(n / sum(n) OVER (PARTITION BY category), 6) AS share, row_number() OVER (PARTITION BY category ORDER BY n DESC, pod) AS rank FROM p QUALIFY rank <= 10")
def top_pods(spark, d):
    out = cn.top_emitters(_events(spark, d).select(F.col("event_type").alias("category"), F.col("user_id").alias("pod")), "pod")
    return out.withColumn("share", F.round("share", 6))


@register("""WITH a AS (SELECT CAST(e.event_id // 2 AS VARCHAR) AS query_id, e.event_type AS fingerprint, CAST(floor(value * 100) AS BIGINT) AS query_time_ms, event_id, user_id, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS k FROM events e),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY event_id % 2 = 1 DESC, query_time_ms DESC) AS n FROM a)
  SELECT fingerprint, count(*) AS executions, count(*) FILTER (k % 10 = 0) AS failed, count(*) FILTER (query_time_ms >= 1000) AS slow, max(query_time_ms) AS longest_ms, max(k) AS peak_bytes, CAST(sum(k) FILTER (k % 2 = 0) AS BIGINT) AS scan_rows, count(*) FILTER (k % 2 = 0) AS scan_rows_known, count(DISTINCT user_id % 7) AS clients FROM o WHERE n = 1 GROUP BY 1""")
def olap_workload(spark, d):
    """Two neighbouring events are emissions of one execution; the odd one is the slow-query emission."""
    e = _events(spark, d)
    audit = e.select(F.floor(F.col("event_id") / 2).cast("string").alias("query_id"), F.lit(0).alias("timestamp_us"), F.lit("fe").alias("fe_ip"), F.lit(1).alias("stmt_id"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"), (F.col("user_id") % 7).cast("string").alias("client_ip"), F.lit("s").alias("stmt"), F.when(F.col("event_id") % 2 == 1, "slow_query").otherwise("query").alias("query_type"), F.col("v").alias("query_time_ms"), F.col("event_type").alias("fingerprint"), F.when(F.col("k") % 10 == 0, "err").otherwise("EOF").alias("state"), F.col("k").alias("mem_bytes"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("scan_rows"), F.lit(None).cast("bigint").alias("cpu_ns"))
    return cn.olap_workload(audit).select("fingerprint", "executions", "failed", "slow", "longest_ms", "peak_bytes", "scan_rows", "scan_rows_known", "clients")


# Document stores


def _records(spark, d) -> DataFrame:
    """Slow records of a document store; every 50th is cut off."""
    # parsing is most of the work, and a file's narrow columns make few tasks for it; a number that is given isn't coalesced
    e = _events(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    body = F.concat(F.lit('{"ns":"shop.log_'), (F.col("user_id") % 4).cast("string"), F.lit('","op":"query","command":{"find":"log_'), (F.col("user_id") % 4).cast("string"), F.lit('","filter":{"b":'), F.col("k").cast("string"), F.lit(',"a":"'), F.col("event_type"), F.lit('"},"sort":{"'), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), F.lit('":-1}},"millis":'), F.col("v").cast("string"), F.lit(',"docsExamined":'), F.col("k").cast("string"), F.lit(',"planSummary":"'), F.when(F.col("k") % 5 == 0, "COLLSCAN").otherwise("IXSCAN"), F.lit('","replRole":{"stateStr":"PRIMARY"}}'))
    return e.select(F.when(F.col("event_id") % 50 == 49, F.substring(body, 1, 30)).otherwise(body).alias("SQLText"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ExecutionStartTime"), F.lit(None).cast("bigint").alias("QueryTimes"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string"), F.lit(":27017")).alias("HostAddress"), F.concat(F.lit("acc"), (F.col("user_id") % 5).cast("string")).alias("AccountName"))


_PROFILE = """'{"version":2,"engine":"mongodb","namespace":"shop.log_*","database":"shop","command":"find","kind":"command","shape":{"filter":{"a":"?string","b":"?number"},"find":"log_*","sort":{"$ordered":[["' || CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END || '",-1]]}},"incomplete":false}'"""
_GROUPED = f"g AS (SELECT *, sha256({_PROFILE}) AS group_id FROM e WHERE event_id % 50 <> 49)"


def _commands(spark, d) -> DataFrame:
    return mongo.mongo_events(_records(spark, d), "i", ("log",))


@register(f"WITH {_E}, {_GROUPED} SELECT group_id, 'find' AS op, count(*) AS records, CAST(sum(v * 1000) AS BIGINT) AS duration_us, CAST(sum(k) AS BIGINT) AS docs, count(*) FILTER (k % 5 = 0) AS collscans FROM g GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*), NULL, NULL, 0 FROM e WHERE event_id % 50 = 49")
def command_groups(spark, d):
    m = _commands(spark, d)
    return m.groupBy("group_id", "op").agg(F.count(F.lit(1)).alias("records"), F.sum("duration_us").alias("duration_us"), F.sum("docs").alias("docs"), F.count_if("collscan").alias("collscans"))


@register(f"WITH {_E} SELECT us - us % 300000000 AS window_us, count(*) AS records FROM e GROUP BY 1 HAVING count(*) FILTER (event_id % 50 = 49) = 0")
def publishable_windows(spark, d):
    return mongo.publishable_windows(_commands(spark, d)).drop("revision")


def _minute_costs(spark, d) -> DataFrame:
    m = _commands(spark, d).filter("error IS NULL").withColumn("docs", F.when(F.col("docs") % 4 > 0, F.col("docs")))
    return cn.mongo_rollup(m, ("duration_us", "docs"))


_ROLLED = f"""{_GROUPED}, c AS (SELECT group_id, us AS s, v * 1000 AS took, CASE WHEN k % 4 > 0 THEN k END AS docs FROM g),
b AS (SELECT group_id, s - s % 60000000 AS bucket_us, count(*) AS count, CAST(sum(took) AS BIGINT) AS duration_us, CAST(sum(docs) AS BIGINT) AS docs, count(docs) AS docs_known, max(took) AS max_us FROM c GROUP BY 1, 2)"""


@register(f"WITH {_E}, {_ROLLED} SELECT group_id, bucket_us - bucket_us % {240 * 60_000_000} AS bucket_us, CAST(sum(count) AS BIGINT) AS count, CAST(sum(duration_us) AS BIGINT) AS duration_us, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(docs_known) AS BIGINT) AS docs_known, max(max_us) AS max_us FROM b GROUP BY 1, 2")
def command_window(spark, d):
    """Thirty days in buckets of 240 minutes; minutes in which commands only ran on have no counts."""
    out = cn.mongo_read(_minute_costs(spark, d), START, START + 30 * DAY, ("duration_us", "docs"))
    return out.filter("count > 0").select("group_id", "bucket_us", "count", "duration_us", "docs", "docs_known", "max_us")


_BOTH = f"""n AS (SELECT group_id, sum(count) AS count, sum(duration_us) AS duration_us, sum(docs) AS docs, sum(docs_known) AS docs_known FROM b WHERE bucket_us >= {START + 15 * DAY} GROUP BY 1), o AS (SELECT group_id, sum(count) AS count, sum(duration_us) AS duration_us, sum(docs) AS docs, sum(docs_known) AS docs_known FROM b WHERE bucket_us < {START + 15 * DAY} GROUP BY 1)"""


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    rolled = stored(_minute_costs(spark, d), scratch_folder(spark), "minutes")  # both halves read it, some twice
    return rolled.filter(F.col("bucket_us") >= START + 15 * DAY), rolled.filter(F.col("bucket_us") < START + 15 * DAY)


@register(f"""WITH {_E}, {_ROLLED}, {_BOTH} SELECT group_id, CAST(n.count AS BIGINT) AS count, CAST(n.duration_us - o.duration_us AS BIGINT) AS duration_us_delta, round((n.count - o.count) * (o.duration_us / o.count), 3) AS duration_us_frequency, round(n.duration_us - n.count * (o.duration_us / o.count), 3) AS duration_us_per_call,
  CASE WHEN n.docs_known = n.count AND o.docs_known = o.count THEN CAST(n.docs - o.docs AS BIGINT) END AS docs_delta FROM n LEFT JOIN o USING (group_id)""")
def command_changes(spark, d):
    """Half a month against the one before; documents were not known of all commands, so they have no difference."""
    now, before = _halves(spark, d)
    out = mongo.order_mongo(mongo.mongo_analyze(now, before, ("duration_us", "docs")), "duration_growth")
    return out.select("group_id", "count", "duration_us_delta", F.round("duration_us_frequency", 3).alias("duration_us_frequency"), F.round("duration_us_per_call", 3).alias("duration_us_per_call"), "docs_delta")


@register(f"WITH {_E}, {_ROLLED}, {_BOTH} SELECT group_id, CAST(n.count AS BIGINT) AS count, CAST(coalesce(o.count, 0) AS BIGINT) AS count_before, CAST(n.count - coalesce(o.count, 0) AS BIGINT) AS count_delta FROM n LEFT JOIN o USING (group_id)")
def indexed_workload(spark, d):
    now, before = (h.groupBy("group_id").agg(F.sum("count").alias("count")) for h in _halves(spark, d))
    return cn.indexed_workload(now, before, ("count",), True)


def _three_costs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Halves of the month with read bytes known of three quarters of the commands, cpu time of all."""
    m = _commands(spark, d).filter("error IS NULL")
    m = m.withColumns({"bytes_read": F.when(F.col("docs") % 4 > 0, F.col("docs")), "cpu_ns": F.col("docs")})
    rolled = stored(cn.mongo_rollup(m, ("duration_us", "bytes_read", "cpu_ns")).filter("count > 0"), scratch_folder(spark), "minutes")
    return rolled.filter(F.col("bucket_us") >= START + 15 * DAY), rolled.filter(F.col("bucket_us") < START + 15 * DAY)


@register(f"""WITH {_E}, {_GROUPED}, s AS (SELECT group_id, us - us % 60000000 >= {START + 15 * DAY} AS late, v * 1000 AS took, CASE WHEN k % 4 > 0 THEN k END AS b, k FROM g),
  n AS (SELECT group_id, count(*) AS count, sum(took) AS d, sum(b) AS b, count(b) AS bk, sum(k) AS c FROM s WHERE late GROUP BY 1), o AS (SELECT group_id, count(*) AS count, sum(took) AS d, sum(b) AS b, count(b) AS bk, sum(k) AS c FROM s WHERE NOT late GROUP BY 1)
  SELECT group_id, n.count, coalesce(o.count, 0) AS count_before, CAST(n.b AS BIGINT) AS bytes_read_observed, CAST(n.b - o.b AS BIGINT) AS bytes_read_observed_delta, CASE WHEN n.bk = n.count AND o.bk = o.count THEN CAST(n.b - o.b AS BIGINT) END AS bytes_read_delta, CAST(n.c - o.c AS BIGINT) AS cpu_ns_delta,
    CASE WHEN n.c > o.c THEN 'workload_growth_candidate' WHEN n.b > o.b THEN 'recorded_cost_increased' WHEN n.d > o.d THEN 'latency_growth_only' ELSE 'observed_costs_only' END AS assessment FROM n LEFT JOIN o USING (group_id)""")
def workload_comparison(spark, d):
    now, before = _three_costs(spark, d)
    out = cn.workload_comparison(now, before, ("duration_us", "bytes_read", "cpu_ns"))
    return out.select("group_id", "count", "count_before", "bytes_read_observed", "bytes_read_observed_delta", "bytes_read_delta", "cpu_ns_delta", "assessment")


_ASKED = {"duration_growth": ("duration_growth", ""), "scan_growth": ("scan_total", "ranking_evidence_unavailable"), "cpu_total": ("count", "ranking_field_unavailable"), "max_latency": ("max_latency", ""), "count": ("count", "")}


@register(
    f"WITH {_E}, {_ROLLED}, {_BOTH}, x AS (SELECT group_id, max(max_us) AS max_us FROM b WHERE bucket_us >= {START + 15 * DAY} GROUP BY 1), a AS (SELECT n.group_id, n.count, n.docs, max_us, n.duration_us - o.duration_us AS growth FROM n LEFT JOIN o USING (group_id) JOIN x ON x.group_id = n.group_id) "
    + " UNION ALL ".join(f"SELECT '{asked}' AS asked, '{order}' AS used, '{why}' AS reason, (SELECT group_id FROM a ORDER BY {({'duration_growth': 'coalesce(growth, -1)', 'scan_total': 'docs', 'count': 'count', 'max_latency': 'max_us'})[order]} DESC, group_id LIMIT 1) AS first_group FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM a)" for asked, (order, why) in _ASKED.items())
)
def command_orders(spark, d):
    """Orders asked for and used: scans were not known of all commands, cpu time of none."""
    now, before = _halves(spark, d)
    groups = stored(mongo.mongo_analyze(now, before, ("duration_us", "docs")), scratch_folder(spark), "groups")
    parts = []
    for asked in _ASKED:
        used, reason = mongo.effective_order(groups, asked)
        parts.append(mongo.order_mongo(groups, used, 1).select(F.lit(asked).alias("asked"), F.lit(used).alias("used"), F.lit(reason).alias("reason"), F.col("group_id").alias("first_group")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(f"WITH {_E}, {_GROUPED} SELECT '10.0.0.' || (user_id % 9) AS client, 'acc' || (user_id % 5) AS account, count(*) AS n FROM g WHERE group_id = (SELECT min(group_id) FROM g) GROUP BY 1, 2")
def command_sources(spark, d):
    m = _commands(spark, d)
    first = m.filter("error IS NULL").agg(F.min("group_id")).first()[0]
    return mongo.raw_sources(m, first)


@register(f"WITH {_E}, {_GROUPED} SELECT CAST(v * 1000 AS BIGINT) AS duration_us, group_id FROM g ORDER BY v DESC LIMIT 3")
def longest_commands(spark, d):
    return mongo.longest(_commands(spark, d)).select("duration_us", "group_id")


@register(f"WITH {_E}, {_GROUPED}, m AS (SELECT group_id, 'acc' || (user_id % 5) AS name, count(*) AS n FROM g GROUP BY 1, 2) SELECT group_id, string_agg(name || '=' || n, ',' ORDER BY name) AS accounts FROM m GROUP BY 1")
def merged_account_counts(spark, d):
    """Counts of accounts by day as maps, merged over the month."""
    m = _commands(spark, d).filter("error IS NULL")
    daily = m.groupBy("group_id", bucket(F.col("start_us"), DAY).alias("day"), "account").agg(F.count(F.lit(1)).alias("n"))
    maps = daily.groupBy("group_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("account", "n"))).alias("accounts"))
    merged = cn.merge_counts(maps, ["group_id"], "accounts")
    return merged.select("group_id", F.array_join(F.transform(F.array_sort(F.map_entries("accounts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("accounts"))


@register(f"""WITH {_E}, x AS (SELECT event_type AS metric, CAST(sum(v) AS BIGINT) AS value FROM e GROUP BY 1) SELECT metric, CASE WHEN metric = 'click' THEN 'direct' WHEN metric = 'error' THEN 'related' ELSE 'outcome' END AS grade, value FROM x""")
def graded_costs(spark, d):
    sums = _events(spark, d).groupBy(F.col("event_type").alias("metric")).agg(F.sum("v").alias("value"))
    return sums.select("metric", cn.grade(F.col("metric"), ["click"], ["error"]).alias("grade"), "value")
