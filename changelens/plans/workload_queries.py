"""Queries on statements, transactions, rollups, the slow log, attribution and replication lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket, fingerprint, normalize_sql
from ..functions.storage import scratch_folder, stored
from ..operators import attribution as att
from ..operators import changes as ch
from ..operators import lag
from ..operators import slow as sl
from . import inputs as i
from .queries import _TXN
from .registry import DAY, END, HOUR, START, over_changes, over_slow, register

# Statements and transactions

_ORDERS = {"executions": "executions", "events": "events", "row_events": "row_events", "payload_bytes": "payload_bytes", "exec_time_ms": "exec_time_ms", "recent": "last_us", "scan_rows": "scan_rows"}


@register(
    over_changes(f"""
, s AS (SELECT fingerprint, any_value(normalized) AS normalized, count(*) AS executions, count(*) AS events, count(*) FILTER (row_event) AS row_events, sum(payload_bytes) AS payload_bytes, sum(execution_time_ms) AS exec_time_ms, max(event_epoch_us) AS last_us FROM ev GROUP BY 1),
e AS (SELECT *, CASE WHEN contains(normalized, 'WHERE') THEN executions * length(normalized) END AS scan_rows FROM s),
r AS (SELECT fingerprint, {", ".join(f"row_number() OVER (ORDER BY {c} DESC NULLS LAST, fingerprint) AS r_{o}" for o, c in _ORDERS.items())} FROM e)
SELECT fingerprint, {", ".join(f"CASE WHEN r_{o} <= 5 THEN r_{o} END AS r_{o}" for o in _ORDERS)} FROM r WHERE least({", ".join(f"r_{o}" for o in _ORDERS)}) <= 5""")
)
def statement_orders(spark, d):
    """The first five statements under each of the seven orders; plans are known of statements with a condition."""
    stats = stored(ch.statement_stats(i.derived_events(spark, d)), scratch_folder(spark), "stats")  # read for the plans and for the orders
    explain = ch.statement_dim(stats).filter(F.col("normalized").contains("WHERE")).select("fingerprint", F.lit("ok").alias("status"), F.length("normalized").cast("bigint").alias("est_rows"))
    out = ch.top_statements(ch.by_statement(stats, explain), 5)
    return out.select("fingerprint", *[F.col(f"r_{o}").cast("bigint").alias(f"r_{o}") for o in _ORDERS])


@register(over_changes("SELECT fingerprint, any_value(normalized) AS normalized, min(event_epoch_us) AS first_seen_us, max(event_epoch_us) AS last_seen_us, CASE WHEN any_value(operation) = 'QUERY' THEN 'SELECT' ELSE any_value(operation) END AS action FROM ev GROUP BY 1"))
def statement_dimension(spark, d):
    return ch.statement_dim(ch.statement_stats(i.derived_events(spark, d))).select("fingerprint", "normalized", "first_seen_us", "last_seen_us", "action")


@register(over_changes("SELECT bucket_us - bucket_us % 7200000000 AS bucket_us, count(*) AS events, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes FROM ev GROUP BY 1"))
def statement_trend(spark, d):
    """The trend of a month: with at most 480 buckets each is two hours wide."""
    stats = ch.statement_stats(i.derived_events(spark, d))
    trend = ch.sql_summary(stats, START, START + 40 * DAY - 1)["trend"]
    return trend.select("bucket_us", "events", "payload_bytes")


@register(over_changes("SELECT operation, count(*) AS events, CAST(sum(execution_time_ms) AS BIGINT) AS exec_time_ms FROM ev GROUP BY 1"))
def statement_operations(spark, d):
    stats = ch.statement_stats(i.derived_events(spark, d))
    return ch.sql_summary(stats, START, START + 40 * DAY)["operations"].select("operation", "events", "exec_time_ms")


_SUMS = "count(*) AS transactions, CAST(sum(row_events) AS BIGINT) AS row_events, max(row_events) AS largest, max(duration_us) AS longest_us, count(*) FILTER (table_count > 1) AS multi_table"


@register(
    f"""WITH {i.CHANGE_CTE}{_TXN} SELECT {_SUMS}, round_even(sum(depth) FILTER (depth <> 0) / count(*) FILTER (depth > 0), 1) AS depth_avg,
  CAST(floor(sum(duration_us) / count(*) FILTER (duration_us > 0)) AS BIGINT) AS duration_avg_us FROM t"""
)
def transaction_totals(spark, d):
    totals = ch.txn_summary(ch.transactions(i.derived_events(spark, d)), START, START + 40 * DAY)["totals"]
    return totals.select("transactions", "row_events", "largest", "longest_us", "multi_table", "depth_avg", "duration_avg_us")


@register(f"WITH {i.CHANGE_CTE}{_TXN} SELECT end_us - end_us % {DAY} AS bucket_us, {_SUMS}, count(*) FILTER (row_events > 1 AND row_events <= 10) AS size_1 FROM t GROUP BY 1")
def transaction_daily_rollup(spark, d):
    hourly = ch.txn_buckets(ch.transactions(i.derived_events(spark, d)), HOUR)
    return ch.transaction_rollup(hourly, DAY).select("bucket_us", "transactions", "row_events", "largest", "longest_us", "multi_table", "size_1")


@register(f"WITH {i.CHANGE_CTE}{_TXN} SELECT txn_key, row_events, duration_us FROM t ORDER BY row_events DESC, duration_us DESC, txn_key LIMIT 20")
def largest_transactions(spark, d):
    return ch.top_transactions(ch.transactions(i.derived_events(spark, d)), "largest").select("txn_key", "row_events", "duration_us")


def _with_ddl(spark, d) -> DataFrame:
    """Inserts stand for ALTER TABLE statements."""
    ddl = F.concat(F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" ADD c"), F.col("event_id"), F.lit(" INT"))
    return ch.derive_event_columns(i.change_events(spark, d).withColumn("sql_text", F.when(F.col("operation") == "INSERT", ddl).otherwise(F.col("sql_text"))), HOUR)


_DDL_TXN = ", d AS (SELECT txn_key, min(event_epoch_us) AS start_us, max(event_epoch_us) AS end_us, count(*) FILTER (operation = 'INSERT') AS ddl_count, count(*) FILTER (row_event) AS row_events, count(DISTINCT table_name) FILTER (row_event) AS table_count, CASE WHEN max(commit_epoch_us) - min(header_epoch_us) >= 1000000 THEN max(commit_epoch_us) - min(header_epoch_us) ELSE 0 END AS duration_us FROM ev GROUP BY 1)"


@register(over_changes(f"{_DDL_TXN} SELECT txn_key, ddl_count FROM d WHERE ddl_count > 0 ORDER BY start_us DESC, txn_key LIMIT 20"))
def ddl_transactions(spark, d):
    return ch.top_transactions(ch.transactions(_with_ddl(spark, d)), "ddl").select("txn_key", "ddl_count")


@register(over_changes(f"""{_DDL_TXN}, r AS (SELECT *, row_number() OVER (ORDER BY row_events DESC, duration_us DESC, txn_key) AS a, row_number() OVER (ORDER BY duration_us DESC, row_events DESC, txn_key) AS b FROM d)
  SELECT txn_key, row_events, ddl_count FROM r WHERE a <= 10 OR b <= 10 OR ddl_count > 0 OR table_count > 3 OR start_us < {START + DAY} OR end_us > {START + 25 * DAY}"""))
def notable_transactions(spark, d):
    """Transactions of more than three tables stand for those of several."""
    txn = ch.transactions(_with_ddl(spark, d)).withColumn("table_count", F.when(F.col("table_count") > 3, F.col("table_count")).otherwise(1))
    return ch.notable_transactions(txn, START + DAY, START + 25 * DAY, 10).select("txn_key", "row_events", "ddl_count")


@register(over_changes("SELECT event_id, 'ALTER TABLE ' || table_name || ' ADD c' || event_id || ' INT' AS sql_text, 'DDL' AS action FROM ev WHERE operation = 'INSERT'"))
def ddl_statements(spark, d):
    return ch.ddl_events(_with_ddl(spark, d)).select("event_id", "sql_text", "action")


_DDL_DML = f"""
, dml AS (SELECT table_name, bucket_us, count(*) AS n FROM ev WHERE row_event GROUP BY ALL),
w AS (SELECT d.event_id, d.table_name, d.event_epoch_us, CAST(coalesce(sum(n), 0) AS BIGINT) AS dml_events FROM ev d LEFT JOIN dml m ON m.table_name = d.table_name
  AND m.bucket_us BETWEEN (d.event_epoch_us - {HOUR}) - (d.event_epoch_us - {HOUR}) % {HOUR} AND (d.event_epoch_us + {HOUR}) - (d.event_epoch_us + {HOUR}) % {HOUR} WHERE d.operation = 'INSERT' GROUP BY ALL)"""


@register(over_changes(f"{_DDL_DML} SELECT event_epoch_us - event_epoch_us % {DAY} AS bucket_us, table_name, count(*) AS ddl, CAST(sum(dml_events) AS BIGINT) AS dml_events, max(dml_events) AS dml_most FROM w GROUP BY 1, 2"))
def ddl_daily_rollup(spark, d):
    ev = _with_ddl(spark, d)
    windows = ch.ddl_windows(ch.ddl_events(ev), ch.statement_stats(ev), HOUR, HOUR)
    return ch.ddl_rollup(windows, DAY).drop("database_name")


@register(over_changes(f"""
, per AS (SELECT bucket_us, database_name, table_name, count(*) AS events, count(DISTINCT txn_key) AS transactions FROM ev WHERE row_event GROUP BY ALL),
t AS (SELECT CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(events) AS BIGINT) AS events FROM per GROUP BY table_name ORDER BY events DESC, transactions DESC LIMIT 20),
dml AS (SELECT table_name, bucket_us, count(*) AS n FROM ev WHERE row_event GROUP BY ALL),
w AS (SELECT d.event_id, coalesce(sum(n), 0) AS dml_events FROM ev d LEFT JOIN dml m ON m.table_name = d.table_name AND m.bucket_us BETWEEN (d.event_epoch_us - 300000000) - (d.event_epoch_us - 300000000) % 300000000 AND d.event_epoch_us + 300000000 AND m.bucket_us % 300000000 = 0 WHERE d.operation = 'INSERT' GROUP BY 1)
SELECT (SELECT max(transactions) FROM t) AS max_transactions, (SELECT max(events) FROM t) AS max_events, count(*) AS ddl, CAST(max(dml_events) AS BIGINT) AS max_dml_events FROM w"""))
def lock_risk(spark, d):
    ev = _with_ddl(spark, d)
    return ch.lock_summary(ev, ch.statement_stats(ev))["risk"]


@register(over_changes(f"""
, per AS (SELECT bucket_us, table_name, count(*) AS events, count(DISTINCT txn_key) AS transactions FROM ev WHERE row_event GROUP BY ALL)
SELECT bucket_us - bucket_us % {DAY} AS bucket_us, table_name, CAST(sum(events) AS BIGINT) AS events, CAST(sum(transactions) AS BIGINT) AS transactions FROM per GROUP BY 1, 2"""))
def hotspot_daily_rollup(spark, d):
    return ch.hotspot_rollup(i.derived_events(spark, d), DAY).drop("database_name")


@register(over_changes(f"""
, s AS (SELECT bucket_us - bucket_us % {DAY} AS bucket_us, fingerprint, count(*) AS events, CAST(sum(execution_time_ms) AS BIGINT) AS exec_time_ms FROM ev GROUP BY 1, 2)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY bucket_us ORDER BY events DESC, fingerprint) <= 3 OR row_number() OVER (PARTITION BY bucket_us ORDER BY exec_time_ms DESC, fingerprint) <= 3"""))
def top_of_each_day(spark, d):
    daily = ch.rollup(ch.statement_stats(i.derived_events(spark, d)), DAY).groupBy("bucket_us", "fingerprint").agg(F.sum("events").alias("events"), F.sum("exec_time_ms").alias("exec_time_ms"))
    return ch.top_each_bucket(daily, ["events", "exec_time_ms"], "fingerprint", 3)


@register(over_changes("SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN bool_and(keyed) THEN 'primary-key' WHEN bool_or(keyed) THEN 'mixed' ELSE 'table-only' END AS mode FROM (SELECT table_name, bool_or(operation IN ('UPDATE', 'DELETE')) AND table_name <> 'user_3' AS keyed FROM ev WHERE row_event GROUP BY 1)"))
def hotspot_mode(spark, d):
    """One table has no key."""
    ev = i.derived_events(spark, d)
    rows = ev.filter("operation IN ('UPDATE', 'DELETE') AND table_name <> 'user_3'").select("database_name", "table_name")
    mode = ch.hotspot_mode(rows, ch.table_hotspots(ev))
    return ev.groupBy().agg(F.lit(mode).alias("mode"))


@register(over_changes(f"""
, part AS (SELECT instance_id, bucket_us - bucket_us % {DAY} AS part_id, count(*) AS events FROM ev GROUP BY 1, 2)
SELECT instance_id, part_id, events, CASE WHEN events % 2 = 0 THEN 2 ELSE 1 END AS revision FROM part"""))
def parts_in_scope(spark, d):
    """Parts come in two revisions; days with an even number of events have the second as the current one."""
    agg = i.derived_events(spark, d).groupBy("instance_id", bucket(F.col("bucket_us"), DAY).alias("part_id")).agg(F.count(F.lit(1)).alias("events"))
    parts = agg.withColumn("revision", F.explode(F.array(F.lit(1), F.lit(2))))
    scope = agg.withColumn("revision", F.when(F.col("events") % 2 == 0, 2).otherwise(1))
    return ch.scope_parts(parts, scope)


@register(
    """WITH e AS (SELECT event_id, user_id, 'user_' || (user_id % 8) AS table_name, props AS after, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
  f AS (SELECT user_id, arg_min(props, event_id) AS first, arg_max(props, event_id) AS last FROM events GROUP BY 1),
  c AS (SELECT * FROM e WHERE before IS DISTINCT FROM after QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
  SELECT table_name, CAST(user_id AS VARCHAR) AS row_key, before, after, event_id FROM c"""
)
def last_changes(spark, d):
    """Events as versions of a user's row: the last version that changed anything."""
    e = i.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = e.select(F.concat(F.lit("user_"), (F.col("user_id") % 8).cast("string")).alias("table_name"), F.col("user_id").cast("string").alias("row_key"), F.lag("props").over(w).alias("before"), F.col("props").alias("after"), "event_id")
    return ch.last_effective_change(rows, ["table_name"], ["event_id"])


# Slow log


@register(over_slow("SELECT fingerprint, any_value(normalized_sql) AS normalized_sql, count(*) AS executions, 'SELECT' AS action FROM slow GROUP BY 1"))
def slow_profiles(spark, d):
    """Profiles of two instances; over both the smaller action counts."""
    s = sl.canonical_slow(i.slow_events(spark, d))
    profiles = s.select("fingerprint", "normalized_sql").distinct().withColumn("action", F.explode(F.array(F.lit("UPDATE"), F.lit("SELECT"))))
    sums = s.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("executions"))
    return sl.with_profiles(sums, profiles)


_SLOW_ORDERS = {"executions": "executions", "query_time_ms": "query_time_ms", "query_time_max_ms": "query_time_max_ms", "rows_examined": "rows_examined", "rows_examined_max": "rows_examined_max", "lock_time_ms": "lock_time_ms", "rows_sent": "rows_sent"}


@register(
    over_slow(
        ", s AS (SELECT fingerprint, count(*) AS executions, CAST(sum(query_time_ms) AS BIGINT) AS query_time_ms, max(query_time_ms) AS query_time_max_ms, CAST(sum(rows_examined) AS BIGINT) AS rows_examined, max(rows_examined) AS rows_examined_max, CAST(sum(lock_time_ms) AS BIGINT) AS lock_time_ms, CAST(sum(rows_sent) AS BIGINT) AS rows_sent FROM slow GROUP BY 1) "
        + " UNION ALL ".join(f"SELECT * FROM (SELECT '{o}' AS ranked_by, fingerprint, {o} AS value FROM s ORDER BY {o} DESC, fingerprint DESC LIMIT 5)" for o in _SLOW_ORDERS)
    )
)
def slow_orders(spark, d):
    summary = sl.slow_summary(sl.canonical_slow(i.slow_events(spark, d)), HOUR)
    parts = [sl.rank_slow(summary, o, 5).select(F.lit(o).alias("ranked_by"), "fingerprint", F.col(o).alias("value")) for o in sl.SLOW_ORDERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(over_slow(f"""
, g AS (SELECT unnest(generate_series({START}, {START + 29 * DAY + 23 * HOUR}, {HOUR})) AS ts),
c AS (SELECT fingerprint, bucket_us AS ts, count(*) AS x FROM slow GROUP BY 1, 2), f AS (SELECT DISTINCT fingerprint FROM slow),
y AS (SELECT ts, coalesce(sum(x), 0) AS y FROM g LEFT JOIN c USING (ts) GROUP BY ts),
dense AS (SELECT fingerprint, ts, coalesce(x, 0) AS x, y FROM f CROSS JOIN y LEFT JOIN c USING (fingerprint, ts)),
r AS (SELECT fingerprint, round(corr(x, y), 6) AS r_level, round(sum(x) / sum(y), 6) AS share FROM dense GROUP BY 1)
SELECT * FROM r ORDER BY r_level DESC NULLS LAST, fingerprint LIMIT 10"""))
def closest_statements(spark, d):
    """The ten statements whose counts follow the total most closely."""
    out = sl.slow_correlation(sl.canonical_slow(i.slow_events(spark, d)), START, END, HOUR)
    rounded = out.select("fingerprint", F.round("r_level", 6).alias("r_level"), F.round("share", 6).alias("share"))
    return sl.order_by_correlation(rounded, "r_level").limit(10)


# Attribution


@register(over_slow("""
SELECT event_id, CASE WHEN query_time_ms > 0 THEN CAST((CAST(query_time_ms * 700 AS HUGEINT) * greatest(query_time_ms * 1000 - least(lock_time_ms * 500, query_time_ms * 1000), 0)) // (query_time_ms * 1000) AS BIGINT) ELSE 0 END AS free_us FROM slow"""))
def lock_free_time(spark, d):
    """Seven tenths of each statement's time lie in the window; half of ``lock_time_ms`` was waited."""
    s = sl.canonical_slow(i.slow_events(spark, d))
    took = F.col("query_time_ms") * 1000
    return s.select("event_id", att.lock_free_us(F.col("query_time_ms") * 700, took, F.col("lock_time_ms") * 500).alias("free_us"))


@register(over_slow("SELECT n.node_id, s.event_id || '@' || n.node_id AS event_id, 'primary' AS origin FROM slow s CROSS JOIN (VALUES ('n1'), ('n2')) n(node_id) WHERE s.node_id = 'n0'"))
def lag_candidates(spark, d):
    s = sl.canonical_slow(i.slow_events(spark, d))
    replicas = s.filter("node_id <> 'n0'").select("node_id").distinct()
    return att.lag_candidates(s, ["n0"], replicas).select("node_id", "event_id", "origin")


@register(over_changes("""
, t AS (SELECT event_id, database_name, fingerprint, CASE WHEN operation = 'INSERT' THEN 'INSERT INTO user_# (id, v) VALUES' ELSE replace(normalized, table_name, 'user_#') END AS template FROM ev),
m AS (SELECT database_name, template, count(DISTINCT fingerprint) AS n FROM t GROUP BY 1, 2)
SELECT event_id, CASE WHEN n >= 2 THEN substr(sha1(database_name || chr(10) || template), 1, 16) ELSE database_name || '/' || fingerprint END AS family FROM t JOIN m USING (database_name, template)"""))
def statement_families(spark, d):
    """Statements that differ by the number of their table only are one family."""
    ev = i.change_events(spark, d)
    rows = ev.select("event_id", "database_name", F.lit("").alias("sql_id"), normalize_sql(F.col("sql_text")).alias("normalized_sql"))
    return att.assign_families(rows.withColumn("fingerprint", fingerprint(F.lit("original"), F.col("normalized_sql")))).select("event_id", "family")


@register(over_slow(f"""
, {i.METRIC_CTE.lstrip()}, s AS (SELECT node_id, fingerprint AS family, bucket_us + {HOUR} AS end_us, CAST(sum(query_time_ms) AS BIGINT) AS runtime_us FROM slow GROUP BY 1, 2, 3)
SELECT node_id, family, count(*) AS n, CASE WHEN count(*) >= 6 THEN round(corr(runtime_us, value), 6) END AS r FROM s JOIN metric USING (node_id, end_us) GROUP BY 1, 2"""))
def observed_correlation(spark, d):
    """Correlation over the hours in which both a statement and the metric were observed."""
    out = att.exact_r(att.align(_hourly(spark, d), i.metric_points(spark, d)), ["node_id", "family"], "runtime_us", "value")
    return out.select("node_id", "family", "n", F.round("r", 6).alias("r"))


@register(over_slow(f"""
, {i.METRIC_CTE.lstrip()}, s AS (SELECT node_id, fingerprint AS family, bucket_us + {HOUR} AS end_us, CAST(sum(query_time_ms) AS BIGINT) AS runtime_us FROM slow GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT node_id, family FROM s), g AS (SELECT unnest(generate_series({START + HOUR}, {START + 10 * DAY}, {HOUR})) AS end_us),
dense AS (SELECT k.node_id, k.family, coalesce(runtime_us, 0) AS x, value AS y FROM k CROSS JOIN g LEFT JOIN s USING (node_id, family, end_us) JOIN metric m ON m.node_id = k.node_id AND m.end_us = g.end_us)
SELECT node_id, family, count(*) AS n, CASE WHEN count(*) >= 6 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS r FROM dense GROUP BY 1, 2"""))
def dense_correlation(spark, d):
    """The same over all hours of ten days, hours without the statement as zero."""
    hours = spark.range(START + HOUR, START + 10 * DAY + 1, HOUR).select(F.col("id").alias("end_us"))
    out = att.dense_r(_hourly(spark, d), i.metric_points(spark, d), hours)
    return out.select("node_id", "family", "n", F.round("r", 6).alias("r"))


def _hourly(spark, d) -> DataFrame:
    s = sl.canonical_slow(i.slow_events(spark, d))
    return s.groupBy("node_id", F.col("fingerprint").alias("family"), (bucket(F.col("event_epoch_us"), HOUR) + HOUR).alias("end_us")).agg(F.sum("query_time_ms").alias("runtime_us"))


def _rates(spark, d, low: int, high: int) -> DataFrame:
    """Hourly rates of each operation on each node, in events an hour times a hundred."""
    s = sl.canonical_slow(i.slow_events(spark, d)).filter(F.col("event_epoch_us").between(low, high - 1))
    return s.groupBy("node_id", F.col("operation").alias("metric"), bucket(F.col("event_epoch_us"), HOUR).alias("ts")).agg((F.count(F.lit(1)) * 100).alias("value"))


_EVIDENCE = f"""
, h AS (SELECT node_id, operation AS metric, bucket_us, count(*) * 100 AS value FROM slow WHERE event_epoch_us >= {START} AND event_epoch_us < {START + 20 * DAY} GROUP BY 1, 2, 3),
a AS (SELECT node_id, metric, avg(value) AS now, count(*) AS now_points FROM h WHERE bucket_us >= {START + 10 * DAY} GROUP BY 1, 2), b AS (SELECT node_id, metric, avg(value) AS before, count(*) AS before_points FROM h WHERE bucket_us < {START + 10 * DAY} GROUP BY 1, 2),
ev AS (SELECT *, now - before AS change FROM a LEFT JOIN b USING (node_id, metric))"""


def _evidence(spark, d) -> DataFrame:
    return att.node_evidence(_rates(spark, d, START + 10 * DAY, START + 20 * DAY), _rates(spark, d, START, START + 10 * DAY))


@register(over_slow(_EVIDENCE + " SELECT node_id, metric, round(now, 6) AS now, now_points, round(before, 6) AS before, before_points, round(change, 6) AS change FROM ev"))
def node_evidence(spark, d):
    return _evidence(spark, d).select("node_id", "metric", *[F.round(c, 6).alias(c) for c in ("now", "before", "change")], "now_points", "before_points")


@register(over_slow(_EVIDENCE + " SELECT node_id, metric FROM ev WHERE change >= 1 AND change >= 0.01 * before QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(change, 6) DESC, metric) = 1"))
def lead_statement_type(spark, d):
    rounded = _evidence(spark, d).withColumn("change", F.when(F.col("change") >= 1, F.round("change", 6)))
    return att.lead_statement_type(rounded, 0.01, 1.0).select("node_id", "metric")


@register(over_slow(_EVIDENCE + ", c AS (SELECT node_id, CAST(count(*) AS DOUBLE) AS added FROM slow GROUP BY 1) SELECT node_id, round(change, 6) AS rise, added, round(added / change, 6) AS share FROM ev LEFT JOIN c USING (node_id) WHERE metric = 'UPDATE' AND change >= 1"))
def explained_share(spark, d):
    added = sl.canonical_slow(i.slow_events(spark, d)).groupBy("node_id").agg(F.count(F.lit(1)).cast("double").alias("added"))
    out = att.explained_share(_evidence(spark, d), added, "UPDATE")
    return out.select("node_id", F.round("rise", 6).alias("rise"), "added", F.round("share", 6).alias("share"))


# Replication lag


def _episodes(spark, d) -> DataFrame:
    """Errors as episodes of their node: two hours long, every other a stall that was released at the error."""
    e = i.table(spark, d, "events").filter("event_type = 'error'")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stall = F.col("event_id") % 2 == 0
    return e.select(
        F.concat(F.lit("i"), (F.col("user_id") % 2).cast("string")).alias("instance_id"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"),
        F.when(stall, "stall").otherwise("behind").alias("kind"),
        (at - 2 * HOUR).alias("start_us"),
        at.alias("end_us"),
        F.floor("value").cast("double").alias("peak_s"),
        F.when(stall, at - 2 * HOUR).alias("origin_us"),
        F.when(stall, at).alias("release_us"),
    )


_EPISODES = f"""ep AS (SELECT 'i' || (user_id % 2) AS instance_id, 'n' || (user_id % 3) AS node_id, CASE WHEN event_id % 2 = 0 THEN 'stall' ELSE 'behind' END AS kind, epoch_us(ts) - {2 * HOUR} AS start_us, epoch_us(ts) AS end_us,
  floor(value) AS peak_s, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) - {2 * HOUR} END AS origin_us, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) END AS release_us FROM events WHERE event_type = 'error')"""


@register(over_slow(f"""
, {_EPISODES}, s AS (SELECT *, event_epoch_us AS start_at, query_time_ms * 10000000 AS took FROM slow),
h AS (SELECT s.instance_id, s.node_id, ep.origin_us, CASE WHEN start_at >= ep.origin_us - {HOUR} THEN 'queued' ELSE 'possible_holder' END AS role, s.event_id, took, row_number() OVER (PARTITION BY s.instance_id, s.node_id, ep.origin_us, CASE WHEN start_at >= ep.origin_us - {HOUR} THEN 'queued' ELSE 'possible_holder' END ORDER BY took DESC, s.event_id) AS n
  FROM s JOIN ep ON ep.kind = 'stall' AND ep.instance_id = s.instance_id AND ep.node_id = s.node_id AND abs(start_at + took - release_us) <= {HOUR} WHERE took >= 60000000)
SELECT instance_id, node_id, origin_us, role, count(*) AS statements, string_agg(event_id, ',' ORDER BY n) FILTER (n <= 5) AS samples FROM h GROUP BY 1, 2, 3, 4"""))
def held_statements(spark, d):
    """Statements of a minute or more that ended within an hour of a stall's release."""
    s = sl.canonical_slow(i.slow_events(spark, d))
    events = s.select("event_id", "instance_id", "node_id", F.col("event_epoch_us").alias("start_us"), (F.col("query_time_ms") * 10_000_000).alias("duration_us"))
    out = lag.held_statements(events, _episodes(spark, d), slack_us=HOUR)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: x["event_id"]), ","))


@register(over_changes(f"""
, {_EPISODES}, w AS (SELECT instance_id, node_id, start_us, end_us, (start_us - {HOUR}) - (start_us - {HOUR}) % {HOUR} AS a, end_us + (-end_us % {HOUR} + {HOUR}) % {HOUR} AS b FROM ep WHERE kind <> 'stall'),
g AS (SELECT instance_id, bucket_us, table_name, count(*) FILTER (row_event) AS n FROM ev GROUP BY ALL),
f AS (SELECT w.*, table_name, CAST(sum(n) FILTER (bucket_us >= a) AS BIGINT) AS row_events, CAST(sum(n) FILTER (bucket_us < a) AS BIGINT) AS row_events_before FROM w JOIN g ON g.instance_id = w.instance_id AND bucket_us >= a - (b - a) AND bucket_us < b GROUP BY ALL)
SELECT node_id, start_us, table_name, row_events, row_events_before, row_number() OVER (PARTITION BY instance_id, node_id, start_us, end_us ORDER BY row_events DESC, table_name) AS rank FROM f WHERE row_events IS NOT NULL QUALIFY rank <= 5"""))
def episode_writes(spark, d):
    ev = i.derived_events(spark, d)
    agg = ev.groupBy("instance_id", "bucket_us", "database_name", "table_name").agg(F.count_if("row_event").alias("row_events"))
    return lag.episode_writes(_episodes(spark, d), agg, 5, HOUR, HOUR).select("node_id", "start_us", "table_name", "row_events", "row_events_before", "rank")


_LAG = f"""p AS (SELECT 'n' || (user_id % 3) AS node_id, (epoch_us(ts) - {START}) // {HOUR} AS h, count(*) AS c FROM events GROUP BY 1, 2),
x AS (SELECT node_id, {START} + h * {HOUR} AS end_us, CAST(CASE WHEN h % 24 BETWEEN 6 AND 14 THEN (h % 24 - 5) * 3600 + c % 20 WHEN h % 24 = 15 THEN 500 ELSE c % 40 END AS DOUBLE) AS lag_s FROM p)"""


@register(f"""WITH {_LAG}, y AS (SELECT *, coalesce(end_us - lag(end_us) OVER w = {HOUR} AND lag(lag_s) OVER w > 0.5, false) AS follows, lag(lag_s) OVER w AS pl FROM x WINDOW w AS (PARTITION BY node_id ORDER BY end_us)),
z AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN follows AND pl <= lag_s THEN 0 ELSE 1 END) OVER w AS climb FROM y WHERE lag_s > 0.5 OR follows WINDOW w AS (PARTITION BY node_id ORDER BY end_us)),
f AS (SELECT node_id, run, arg_min(climb, end_us) AS climb FROM z WHERE lag_s >= 30 GROUP BY 1, 2),
m AS (SELECT z.*, (lag_s - pl) / 3600.0 AS slope FROM z JOIN f USING (node_id, run) WHERE z.climb >= f.climb),
n AS (SELECT *, row_number() OVER w AS i, CASE WHEN row_number() OVER w > 1 THEN slope END AS s FROM m WINDOW w AS (PARTITION BY node_id, run ORDER BY end_us)),
e AS (SELECT node_id, run, min(end_us) AS start_us, max(end_us) AS end_us, max(lag_s) AS peak_s, count(*) AS minutes, min(i) FILTER (lag_s = (SELECT max(lag_s) FROM n b WHERE b.node_id = n.node_id AND b.run = n.run)) AS peak_i FROM n GROUP BY 1, 2),
g AS (SELECT n.*, peak_i, i - row_number() OVER (PARTITION BY n.node_id, n.run, coalesce(s >= 0.85, false) ORDER BY i) AS steep FROM n JOIN e USING (node_id, run)),
r AS (SELECT node_id, run, min(i) - 1 AS a, max(i) AS b FROM g WHERE s >= 0.85 GROUP BY node_id, run, steep HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY node_id, run ORDER BY count(*) DESC, min(i)) = 1),
o AS (SELECT g.node_id, g.run, end_us, i, b, end_us - 30000000 - lag_s * 1e6 AS origin, median(end_us - 30000000 - lag_s * 1e6) OVER (PARTITION BY g.node_id, g.run) AS mid FROM g JOIN r ON r.node_id = g.node_id AND r.run = g.run AND i BETWEEN a AND b),
q AS (SELECT node_id, run, CAST(trunc(median(origin) FILTER (abs(origin - mid) <= 60e6)) AS BIGINT) AS origin_us, max(end_us) AS release_us FROM o GROUP BY 1, 2 HAVING count(*) FILTER (abs(origin - mid) <= 60e6) >= 3),
v AS (SELECT node_id, run, round(median(s) FILTER (i <= peak_i), 9) AS growth, round(median(s) FILTER (i > peak_i), 9) AS recovery, min(end_us) FILTER (i = peak_i) AS peak_us FROM g GROUP BY 1, 2)
SELECT node_id, CASE WHEN origin_us IS NOT NULL THEN 'stall' WHEN minutes >= 3 THEN 'behind' ELSE 'spike' END AS kind, start_us, end_us, peak_s, peak_us, growth, recovery, origin_us, release_us FROM e LEFT JOIN q USING (node_id, run) JOIN v USING (node_id, run)""")
def lag_episodes(spark, d):
    """Lag by the hour: from six in the morning it grows with the clock until three in the afternoon, else it follows the events' number."""
    e = i.table(spark, d, "events")
    h = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - START) / HOUR).cast("bigint")
    p = e.groupBy(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), h.alias("h")).agg(F.count(F.lit(1)).alias("c"))
    hour = F.col("h") % 24
    value = F.when(hour.between(6, 14), (hour - 5) * 3600 + F.col("c") % 20).when(hour == 15, 500).otherwise(F.col("c") % 40)
    samples = p.select(F.lit("i").alias("instance_id"), "node_id", (F.col("h") * HOUR + START).alias("end_us"), value.cast("double").alias("lag_s"))
    out = lag.lag_episodes(samples, HOUR, 5 * DAY)
    return out.drop("instance_id").withColumns({c: F.round(c, 9) for c in ("growth", "recovery")})


@register(f"""WITH {_EPISODES}, ddl AS (SELECT 'i' || (user_id % 2) AS instance_id, epoch_us(ts) AS at_us, CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_type = 'signup'),
t AS (SELECT ep.instance_id, node_id, start_us, ddl.event_id, ddl.at_us - origin_us AS apart FROM ep JOIN ddl ON ddl.instance_id = ep.instance_id AND abs(ddl.at_us - origin_us) <= 90000000 QUALIFY row_number() OVER (PARTITION BY ep.instance_id, node_id, start_us ORDER BY abs(ddl.at_us - origin_us), ddl.at_us) = 1),
o AS (SELECT a.instance_id, a.node_id, a.start_us, max(b.peak_s) AS other FROM ep a JOIN ep b ON a.instance_id = b.instance_id AND a.node_id <> b.node_id AND b.start_us <= a.end_us AND b.end_us >= a.start_us GROUP BY 1, 2, 3)
SELECT ep.instance_id, ep.node_id, ep.start_us, peak_s, t.event_id AS ddl_event, apart AS ddl_distance_us, coalesce(other < 30, true) AS node_local, row_number() OVER (PARTITION BY ep.instance_id ORDER BY peak_s DESC, ep.start_us, ep.node_id) AS rank FROM ep LEFT JOIN t USING (instance_id, node_id, start_us) LEFT JOIN o USING (instance_id, node_id, start_us) QUALIFY rank <= 20""")
def worst_episodes(spark, d):
    """The worst episodes of each instance with the change of a table nearest to their origin; sign-ups stand for DDL."""
    e = i.table(spark, d, "events").filter("event_type = 'signup'")
    ddl = e.select(F.concat(F.lit("i"), (F.col("user_id") % 2).cast("string")).alias("instance_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_epoch_us"), F.col("event_id").cast("string").alias("event_id"))
    out = lag.describe_lag(_episodes(spark, d), ddl, 20)
    return out.select("instance_id", "node_id", "start_us", "peak_s", "ddl_event", "ddl_distance_us", "node_local", "rank")


def _reads(spark, d) -> DataFrame:
    e = i.table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy(F.lit("i").alias("instance_id"), F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("node_id"), F.floor((us - START) / DAY).cast("bigint").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "error").alias("slow")).withColumn("end_us", F.col("day") * 60_000_000)


_READS = "r AS (SELECT 'n' || (user_id % 4) AS node_id, ((epoch_us(ts) - {0}) // {1}) * 60000000 AS end_us, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'error') AS slow FROM events GROUP BY 1, 2)".format(START, DAY)


@register(f"""WITH {_READS}, q AS (SELECT node_id, end_us FROM r WHERE reads % 7 IN (0, 1, 2)), m AS (SELECT *, CASE WHEN end_us - lag(end_us) OVER (PARTITION BY node_id ORDER BY end_us) <= 120000000 THEN 0 ELSE 1 END AS f FROM q),
  s AS (SELECT *, sum(f) OVER (PARTITION BY node_id ORDER BY end_us) AS run FROM m) SELECT node_id, min(end_us) AS first_us, max(end_us) AS last_us, count(*) AS minutes FROM s GROUP BY node_id, run HAVING count(*) >= 3""")
def readless_runs(spark, d):
    """Days as minutes; days whose reads are 0, 1 or 2 modulo 7 count as without reads."""
    series = _reads(spark, d).withColumn("reads", F.when(F.col("reads") % 7 < 3, 0).otherwise(F.col("reads")))
    return lag.readless_runs(series).drop("instance_id")


@register(f"""WITH {_READS}, j AS (SELECT a.node_id, a.end_us, a.reads, a.slow, median(b.reads) AS peer_reads, median(b.slow / nullif(b.reads, 0)) AS peer_ratio FROM r a JOIN r b ON a.end_us = b.end_us AND a.node_id <> b.node_id GROUP BY ALL),
  u AS (SELECT * FROM j WHERE peer_reads >= 1 AND reads >= 0.05 * peer_reads),
  w AS (SELECT node_id, end_us, sum(slow) OVER x AS s, sum(reads) OVER x AS r, avg(peer_ratio) OVER x AS p FROM u WINDOW x AS (PARTITION BY node_id ORDER BY end_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  b AS (SELECT node_id, end_us, CASE WHEN end_us - lag(end_us) OVER (PARTITION BY node_id ORDER BY end_us) <= 180000000 THEN 0 ELSE 1 END AS f FROM w WHERE s >= 2 AND s / r >= 0.9 * p),
  i AS (SELECT *, sum(f) OVER (PARTITION BY node_id ORDER BY end_us) AS run FROM b) SELECT node_id, min(end_us) AS since_us, max(end_us) AS until_us FROM i GROUP BY node_id, run QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY run DESC) = 1""")
def diverged_nodes(spark, d):
    """Since when a node had nine tenths of its peers' errors for each read, over five days."""
    health = lag.peer_health(_reads(spark, d), 1.0)
    return lag.diverged_since(health, 0.9, 2).drop("instance_id")


@register("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT) % 4 + 1.0 AS rows, CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 1.0 END AS f, l_linestatus = 'O' AS full_scan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, floor(l_quantity), l_returnflag, l_partkey) AS step FROM lineitem),
  p AS (SELECT *, coalesce(product(rows * f) OVER (PARTITION BY l_orderkey ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS fan FROM s)
  SELECT l_orderkey AS plan_id, CAST(floor(sum(fan * rows)) AS BIGINT) AS est_rows, bool_or(full_scan) AS full_scan FROM p GROUP BY 1""")
def plan_estimates(spark, d):
    """Orders as plans, their lines as steps: quantity modulo 4 as rows, of which half or all are kept."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.floor("l_quantity"), "l_returnflag", "l_partkey")
    steps = i.table(spark, d, "lineitem").withColumn("step", F.row_number().over(w))
    plans = steps.select(F.col("l_orderkey").alias("plan_id"), F.lit(1).alias("select_id"), "step", (F.floor("l_quantity").cast("bigint") % 4 + 1).alias("rows"), F.when(F.col("l_returnflag") == "N", 50.0).alias("filtered"), F.when(F.col("l_linestatus") == "O", "all").otherwise("ref").alias("access"))
    return lag.estimate_rows(plans)
