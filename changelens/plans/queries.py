"""The registered queries over the given tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket
from ..functions.series import carried, islands, merge_intervals
from ..functions.udf import statement_verb
from ..operators import attribution as att
from ..operators import changes as ch
from ..operators import counters as cn
from ..operators import coverage as cov
from ..operators import filters as fl
from ..operators import lag, schema_diff, search, sessions
from ..operators import slow as sl
from ..sources import events as src
from . import inputs as i
from .registry import DAY, END, HOUR, ORACLES, START, register
from .registry import over_changes as _ce
from .registry import over_slow as _slow

# Filters and pages


@register(_ce(f"SELECT event_id, operation, table_name FROM ev WHERE event_epoch_us BETWEEN {START + 5 * DAY} AND {START + 9 * DAY} AND operation IN ('UPDATE', 'DELETE')"))
def filter_window_operations(spark, d):
    rows = fl.in_window(i.change_events(spark, d), START + 5 * DAY, START + 9 * DAY)
    return fl.by_operations(rows, ["update", "delete"]).select("event_id", "operation", "table_name")


@register(_ce("SELECT event_id, table_name, database_account FROM ev WHERE contains(lower(table_name), 'r_3') AND contains(lower(database_account), 'acc1') AND lower(instance_id) = 'i1'"))
def filter_dimensions(spark, d):
    return fl.by_dimensions(i.change_events(spark, d), instance="I1", table="R_3", account="ACC1").select("event_id", "table_name", "database_account")


@register(_ce("SELECT event_id, transaction_id FROM ev WHERE transaction_id = '7'"))
def filter_transaction(spark, d):
    return fl.by_transaction(i.change_events(spark, d), "7").select("event_id", "transaction_id")


@register(_ce("SELECT event_id FROM ev WHERE contains(lower(sql_text), 'update') AND contains(lower(sql_text), 'user_5') AND contains(lower(sql_text), 'v')"))
def filter_keyword_and(spark, d):
    return fl.keyword_contains(i.change_events(spark, d), "UPDATE user_5 V", "AND", ("sql_text",)).select("event_id")


@register(_ce("SELECT event_id FROM ev WHERE contains(lower(sql_text), 'user_5') OR contains(lower(database_account), 'user_5') OR contains(lower(sql_text), 'acc3') OR contains(lower(database_account), 'acc3')"))
def filter_keyword_or(spark, d):
    return fl.keyword_contains(i.change_events(spark, d), "user_5 ACC3", "or", ("sql_text", "database_account")).select("event_id")


@register("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(text), '100%_')")
def filter_keyword_documents(spark, d):
    docs = i.table(spark, d, "documents")
    return docs.filter(fl.literal_in("text", "Licensed under") | fl.literal_in("text", "100%_")).select("doc_id")


@register(_ce("SELECT event_id FROM ev WHERE list_contains(regexp_extract_all(lower(after_json), '[a-z0-9]+'), '42')"))
def filter_keyword_tokens(spark, d):
    return fl.keyword_tokens(i.change_events(spark, d).withColumn("transaction_id", F.lit("")), "42").select("event_id")


@register(_ce("SELECT event_id FROM ev WHERE json_extract_string(after_json, '$.k') = '17'"))
def filter_image_key(spark, d):
    return fl.by_image_key(i.change_events(spark, d), "k", "17").select("event_id")


@register(_slow("SELECT event_id FROM slow WHERE list_contains(list_transform(string_split(lower(table_name), ','), lambda x: trim(x)), 'log_2')"))
def filter_table_member(spark, d):
    return fl.by_table_member(sl.canonical_slow(i.slow_events(spark, d)), "LOG_2").select("event_id")


@register(_ce("SELECT instance_id, database_name, table_name, count(*) AS rows FROM ev WHERE contains(table_name, 'user_') GROUP BY ALL"))
def resolve_names(spark, d):
    return fl.resolve_names(i.change_events(spark, d), table="USER_")


@register(_ce("SELECT event_id, event_epoch_us, operation, table_name FROM ev ORDER BY event_epoch_us DESC, start_position DESC, event_id DESC LIMIT 101 OFFSET 50"))
def event_page(spark, d):
    rows = i.change_events(spark, d)
    copies = rows.unionByName(rows.withColumn("operation", F.lit("STALE")).withColumn("_content_revision", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    copies = copies.withColumns({"_content_revision": F.coalesce("_content_revision", F.lit(1)), "_source_part_key": F.lit("p")})
    return search.search_events(copies, 100, 50, ["event_id", "event_epoch_us", "operation", "table_name"])


@register(_ce("SELECT event_id, event_epoch_us FROM ev ORDER BY event_epoch_us DESC, start_position DESC, event_id DESC LIMIT 21"))
def merged_page(spark, d):
    rows = i.change_events(spark, d).withColumns({"_content_revision": F.lit(1).cast("bigint"), "_source_part_key": F.lit("p")})
    odd = F.col("start_position") % 2 == 1
    return search.merge_pages(rows.filter(~odd), rows.filter(odd), 20).select("event_id", "event_epoch_us")


@register(_slow("SELECT event_id, event_epoch_us, query_time_ms FROM slow ORDER BY event_epoch_us DESC, event_id DESC LIMIT 51"))
def slow_page(spark, d):
    return search.search_slow(sl.canonical_slow(i.slow_events(spark, d)), 50).select("event_id", "event_epoch_us", "query_time_ms")


@register(_ce("""SELECT event_id, CASE operation
  WHEN 'INSERT' THEN 'INSERT INTO `shop`.`' || table_name || '` (`k`) VALUES (' || json_extract_string(after_json, '$.k') || ');'
  WHEN 'UPDATE' THEN 'UPDATE `shop`.`' || table_name || '` SET `k` = ' || json_extract_string(after_json, '$.k') || ' WHERE `k` <=> ' || json_extract_string(after_json, '$.k') || ' LIMIT 1;'
  ELSE 'DELETE FROM `shop`.`' || table_name || '` WHERE `k` <=> ' || json_extract_string(after_json, '$.k') || ' LIMIT 1;' END AS statement
  FROM ev WHERE operation IN ('INSERT', 'UPDATE', 'DELETE')"""))
def row_image_sql(spark, d):
    rows = i.change_events(spark, d).withColumn("before_json", F.col("after_json"))
    return rows.filter(F.col("operation").isin("INSERT", "UPDATE", "DELETE")).select("event_id", search.render_sql("parser").alias("statement"))


# Statements


@register(_ce("""SELECT fingerprint, any_value(normalized) AS normalized, count(*) AS events, count(*) AS executions, CAST(count(*) FILTER (row_event) AS BIGINT) AS row_events,
  CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, CAST(sum(execution_time_ms) AS BIGINT) AS exec_time_ms, max(execution_time_ms) AS exec_max_ms FROM ev GROUP BY fingerprint ORDER BY executions DESC, fingerprint LIMIT 20"""))
def top_statements(spark, d):
    """Which statements ran most: the flagship."""
    stats = ch.statement_stats(i.derived_events(spark, d))
    out = ch.sql_summary(stats, START, END, "executions", 20)["statements"]
    return out.select("fingerprint", "normalized", "events", "executions", "row_events", "payload_bytes", "exec_time_ms", "exec_max_ms")


@register(_ce("""SELECT bucket_us, database_name, table_name, operation, fingerprint, count(*) AS events, count(DISTINCT start_position) AS executions,
  CAST(sum(execution_time_ms) AS BIGINT) AS exec_time_ms, min(event_epoch_us) AS first_us, max(event_epoch_us) AS last_us, min(event_id) AS min_event_id FROM ev GROUP BY ALL"""))
def statement_statistics(spark, d):
    return ch.statement_stats(i.derived_events(spark, d)).select("bucket_us", "database_name", "table_name", "operation", "fingerprint", "events", "executions", "exec_time_ms", "first_us", "last_us", "min_event_id")


@register(_ce("""SELECT count(*) AS events, count(*) AS executions, count(DISTINCT fingerprint) AS statements, CAST(0 AS BIGINT) AS boundary_events FROM ev"""))
def statement_totals(spark, d):
    return ch.sql_summary(ch.statement_stats(i.derived_events(spark, d)), START, END)["totals"].select("events", "executions", "statements", "boundary_events")


@register(_ce("""SELECT database_name, table_name, count(*) AS events, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, count(DISTINCT fingerprint) AS statements FROM ev GROUP BY ALL ORDER BY events DESC, database_name, table_name LIMIT 20"""))
def statement_objects(spark, d):
    return ch.sql_summary(ch.statement_stats(i.derived_events(spark, d)), START, END)["objects"].select("database_name", "table_name", "events", "payload_bytes", "statements")


@register(_ce(f"""SELECT event_epoch_us - event_epoch_us % {DAY} AS bucket_us, table_name, fingerprint, count(*) AS events, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, max(execution_time_ms) AS exec_max_ms FROM ev GROUP BY ALL"""))
def statement_daily_rollup(spark, d):
    hourly = ch.statement_stats(i.derived_events(spark, d))
    return ch.rollup(hourly, DAY).select("bucket_us", "table_name", "fingerprint", "events", "payload_bytes", "exec_max_ms")


@register(_ce("""SELECT bucket_us, database_name, table_name, operation, count(*) AS events, CAST(count(*) FILTER (execution_time_ms > 0) AS BIGINT) AS slow, CAST(sum(execution_time_ms) AS BIGINT) AS exec_time_ms FROM ev GROUP BY ALL"""))
def mergeable_aggregates(spark, d):
    return ch.agg_5m(i.derived_events(spark, d)).select("bucket_us", "database_name", "table_name", "operation", "events", "slow", "exec_time_ms")


@register(_ce("""SELECT bucket_us, database_name, table_name, count(DISTINCT transaction_id) AS transactions FROM ev GROUP BY ALL
  UNION ALL SELECT bucket_us, '*', '*', count(DISTINCT transaction_id) FROM ev GROUP BY bucket_us"""))
def transaction_counts(spark, d):
    return ch.agg_txn_5m(i.derived_events(spark, d))


_TXN = """, txn AS (SELECT txn_key, min(event_epoch_us) AS start_us, max(event_epoch_us) AS end_us, max(commit_epoch_us) - min(header_epoch_us) AS took, max(seq) AS seq, max(committed) AS committed,
  count(*) FILTER (row_event) AS row_events, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, count(DISTINCT table_name) FILTER (row_event) AS table_count,
  count(*) FILTER (operation = 'UPDATE') AS updates FROM ev GROUP BY txn_key),
t AS (SELECT *, CASE WHEN took >= 1000000 THEN took ELSE 0 END AS duration_us, CASE WHEN seq > 0 THEN seq - committed ELSE 0 END AS depth FROM txn)"""


@register(f"WITH {i.CHANGE_CTE}{_TXN} SELECT txn_key, start_us, end_us, duration_us, depth, row_events, payload_bytes, table_count, updates FROM t")
def transaction_fold(spark, d):
    return ch.transactions(i.derived_events(spark, d)).select("txn_key", "start_us", "end_us", "duration_us", "depth", "row_events", "payload_bytes", "table_count", "updates")


@register(f"WITH {i.CHANGE_CTE}{_TXN} SELECT txn_key, duration_us, row_events FROM t ORDER BY duration_us DESC, row_events DESC, txn_key LIMIT 20")
def longest_transactions(spark, d):
    return ch.top_transactions(ch.transactions(i.derived_events(spark, d)), "longest").select("txn_key", "duration_us", "row_events")


@register(f"WITH {i.CHANGE_CTE}{_TXN} SELECT txn_key, table_count, row_events FROM t WHERE table_count > 1 ORDER BY table_count DESC, row_events DESC, txn_key LIMIT 20")
def multi_table_transactions(spark, d):
    return ch.top_transactions(ch.transactions(i.derived_events(spark, d)), "multi_table").select("txn_key", "table_count", "row_events")


@register(f"""WITH {i.CHANGE_CTE}{_TXN} SELECT end_us - end_us % {HOUR} AS bucket_us, count(*) AS transactions, CAST(sum(row_events) AS BIGINT) AS row_events, max(duration_us) AS longest_us,
  count(*) FILTER (row_events <= 1) AS size_0, count(*) FILTER (row_events > 1 AND row_events <= 10) AS size_1, count(*) FILTER (duration_us <= 0) AS took_0, count(*) FILTER (duration_us > 30000000) AS took_4 FROM t GROUP BY 1""")
def transaction_buckets(spark, d):
    return ch.txn_buckets(ch.transactions(i.derived_events(spark, d)), HOUR).select("bucket_us", "transactions", "row_events", "longest_us", "size_0", "size_1", "took_0", "took_4")


@register(f"""WITH {i.CHANGE_CTE}, per AS (SELECT bucket_us, table_name, json_extract_string(after_json, '$.k') AS row_key, count(*) AS events, count(DISTINCT txn_key) AS transactions FROM ev WHERE operation IN ('UPDATE', 'DELETE') GROUP BY ALL)
  SELECT table_name, row_key, CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(events) AS BIGINT) AS events, count(*) AS buckets FROM per WHERE transactions > 1 GROUP BY ALL ORDER BY transactions DESC, events DESC, table_name, row_key LIMIT 20""")
def hot_rows(spark, d):
    meta = '[{"index":1,"name":"k","type_id":3,"metadata":0,"nullable_known":true,"nullable":false,"primary_key":true}]'
    keyed = ch.with_row_keys(i.derived_events(spark, d).withColumn("columns_json", F.lit(meta)))
    return ch.row_hotspots(keyed).select("table_name", "row_key", "transactions", "events", "buckets")


@register(f"""WITH {i.CHANGE_CTE}, per AS (SELECT bucket_us, database_name, table_name, count(*) AS events, count(DISTINCT txn_key) AS transactions FROM ev WHERE row_event GROUP BY ALL)
  SELECT database_name, table_name, CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(events) AS BIGINT) AS events FROM per GROUP BY ALL""")
def hot_tables(spark, d):
    return ch.table_hotspots(i.derived_events(spark, d))


_LINE_CTE = f"""
lines AS (SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'N' THEN 'INSERT' WHEN 'R' THEN 'UPDATE' ELSE 'DELETE' END AS operation, epoch_us(l_shipdate) - epoch_us(l_shipdate) % {DAY} AS bucket_us FROM lineitem)"""


@register(f"""WITH {_LINE_CTE}, per AS (SELECT bucket_us, l_partkey, count(*) AS events, count(DISTINCT l_orderkey) AS transactions FROM lines GROUP BY ALL)
  SELECT CAST(l_partkey AS VARCHAR) AS row_key, CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(events) AS BIGINT) AS events FROM per WHERE transactions > 1 GROUP BY 1 ORDER BY transactions DESC, events DESC, row_key LIMIT 20""")
def hot_parts(spark, d):
    """Hot rows at bulk: line items as changes of parts, orders as transactions, in day buckets."""
    lines = i.table(spark, d, "lineitem")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    keyed = lines.select(bucket(us, DAY).alias("bucket_us"), F.lit("shop").alias("database_name"), F.lit("part").alias("table_name"), F.col("l_partkey").cast("string").alias("row_key"), F.col("l_orderkey").cast("string").alias("txn_key"))
    return ch.row_hotspots(keyed).select("row_key", "transactions", "events")


@register(f"""WITH {i.CHANGE_CTE}, ddl AS (SELECT event_id, event_epoch_us, table_name FROM ev WHERE operation = 'INSERT'),
  dml AS (SELECT table_name, bucket_us, count(*) AS n FROM ev WHERE row_event GROUP BY ALL)
  SELECT d.event_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS dml_events FROM ddl d LEFT JOIN dml m ON m.table_name = d.table_name
   AND m.bucket_us BETWEEN (d.event_epoch_us - {HOUR}) - (d.event_epoch_us - {HOUR}) % {HOUR} AND (d.event_epoch_us + {HOUR}) - (d.event_epoch_us + {HOUR}) % {HOUR} GROUP BY 1""")
def ddl_concurrency(spark, d):
    """Events near each DDL; inserts stand for DDL here."""
    ev = i.derived_events(spark, d)
    ddl = ev.filter("operation = 'INSERT'").select("event_id", "event_epoch_us", "database_name", "table_name")
    return ch.ddl_windows(ddl, ch.statement_stats(ev), HOUR, HOUR).select("event_id", "dml_events")


@register(f"""WITH {i.CHANGE_CTE}, a AS (SELECT table_name, count(*) FILTER (row_event) AS row_events FROM ev WHERE bucket_us >= {START + 15 * DAY} AND bucket_us < {START + 20 * DAY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
  b AS (SELECT table_name, count(*) FILTER (row_event) AS row_events_before FROM ev WHERE bucket_us >= {START + 10 * DAY} AND bucket_us < {START + 15 * DAY} GROUP BY 1) SELECT * FROM a LEFT JOIN b USING (table_name)""")
def write_before_after(spark, d):
    return ch.write_hotspots(ch.agg_5m(i.derived_events(spark, d)), START + 15 * DAY, START + 20 * DAY).drop("database_name")


# Slow log


@register(_slow("SELECT event_id, instance_id, query_time_ms, fingerprint FROM slow"))
def canonical_slow_events(spark, d):
    return sl.canonical_slow(i.slow_events(spark, d)).select("event_id", "instance_id", "query_time_ms", "fingerprint")


_MEASURES = """count(*) AS executions, CAST(sum(rows_examined) AS BIGINT) AS rows_examined, max(rows_examined) AS rows_examined_max, CAST(sum(query_time_ms) AS BIGINT) AS query_time_ms,
  max(query_time_ms) AS query_time_max_ms, min(event_epoch_us) AS first_us, max(event_epoch_us) AS last_us, arg_max(event_id, row(rows_examined, query_time_ms, event_epoch_us, event_id)) AS max_scan_event, count(DISTINCT fingerprint) AS fingerprints"""


@register(_slow(f"""SELECT fingerprint AS g_fingerprint, CASE WHEN g IN (19) THEN table_name END AS g_table, operation AS g_operation, bucket_us AS ts, CAST(g AS BIGINT) AS mask, * EXCLUDE (fingerprint, database_name, table_name, operation, bucket_us, g)
  FROM (SELECT fingerprint, database_name, table_name, operation, bucket_us, grouping(fingerprint, database_name, table_name, operation, bucket_us) AS g, {_MEASURES} FROM slow
  GROUP BY GROUPING SETS ((fingerprint), (database_name, table_name), (operation), (bucket_us)))"""))
def slow_grouping_sets(spark, d):
    out = sl.slow_summary(sl.canonical_slow(i.slow_events(spark, d)), HOUR)
    return out.select("g_fingerprint", "g_table", "g_operation", "ts", F.col("mask").cast("bigint").alias("mask"), "executions", "rows_examined", "rows_examined_max", "query_time_ms", "query_time_max_ms", "first_us", "last_us", "max_scan_event", "fingerprints")


@register(_slow("SELECT fingerprint, count(*) AS executions, CAST(sum(query_time_ms) AS BIGINT) AS query_time_ms, CAST(round_even(sum(rows_examined) / count(*), 0) AS BIGINT) AS rows_examined_avg FROM slow GROUP BY 1 ORDER BY query_time_ms DESC, fingerprint DESC LIMIT 20"))
def slow_ranking(spark, d):
    out = sl.rank_slow(sl.slow_summary(sl.canonical_slow(i.slow_events(spark, d)), HOUR))
    return out.select("fingerprint", "executions", "query_time_ms", "rows_examined_avg")


@register(_slow("""SELECT fingerprint, count(*) AS accounts, string_agg(database_account, ',' ORDER BY r) FILTER (r <= 3) AS top_accounts FROM
  (SELECT fingerprint, database_account, row_number() OVER (PARTITION BY fingerprint ORDER BY count(*) DESC, database_account) AS r FROM slow GROUP BY 1, 2) GROUP BY 1"""))
def statement_accounts(spark, d):
    return sl.top_accounts(sl.canonical_slow(i.slow_events(spark, d))).withColumn("top_accounts", F.array_join("top_accounts", ","))


@register(_slow(f"""
, g AS (SELECT unnest(generate_series({START}, {START + 29 * DAY + 23 * HOUR}, {HOUR})) AS ts),
c AS (SELECT fingerprint, bucket_us AS ts, count(*) AS x FROM slow GROUP BY 1, 2), f AS (SELECT DISTINCT fingerprint FROM slow),
y AS (SELECT ts, coalesce(sum(x), 0) AS y FROM g LEFT JOIN c USING (ts) GROUP BY ts),
dense AS (SELECT fingerprint, ts, coalesce(x, 0) AS x, y FROM f CROSS JOIN y LEFT JOIN c USING (fingerprint, ts)),
ch AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM dense WINDOW w AS (PARTITION BY fingerprint ORDER BY ts))
SELECT fingerprint, round(corr(dx, dy), 6) AS r_change, round(corr(x, y), 6) AS r_level, round(corr(x, y - x), 6) AS r_rest, round(sum(x) / sum(y), 6) AS share, count(*) FILTER (x > 0) AS active_buckets FROM ch GROUP BY 1"""))
def slow_statement_correlation(spark, d):
    out = sl.slow_correlation(sl.canonical_slow(i.slow_events(spark, d)), START, END, HOUR)
    return out.select("fingerprint", *[F.round(c, 6).alias(c) for c in ("r_change", "r_level", "r_rest", "share")], "active_buckets")


# Attribution


def _executions(spark, d) -> DataFrame:
    s = sl.canonical_slow(i.slow_events(spark, d))
    return s.select("event_id", F.col("fingerprint").alias("family"), "node_id", F.col("event_epoch_us").alias("start_us"), (F.col("query_time_ms") * 10_000_000).alias("duration_us"))


_SERIES = f"""
, x AS (SELECT event_id, fingerprint AS family, node_id, event_epoch_us AS a, least(event_epoch_us + query_time_ms * 10000000, {START + 30 * DAY}) AS b FROM slow WHERE event_epoch_us >= {START} AND event_epoch_us < {START + 30 * DAY}),
p AS (SELECT node_id, family, a, b, unnest(generate_series(a - a % {HOUR}, b - 1 - (b - 1) % {HOUR}, {HOUR})) AS p FROM x WHERE a < b),
series AS (SELECT node_id, family, p + {HOUR} AS end_us, CAST(sum(least(b, p + {HOUR}) - greatest(a, p)) AS BIGINT) AS runtime_us, count(*) AS executions FROM p GROUP BY 1, 2, 3)"""


@register(_slow(_SERIES.lstrip("\n") + " SELECT * FROM series"))
def execution_time_series(spark, d):
    return att.execution_series(_executions(spark, d), START, START + 30 * DAY, HOUR)


@register()
def resource_overlap(spark, d):
    """Overlap of statements with a metric; hours without a sample are filled with the node's mean, as gaps refuse a score."""
    points = i.metric_points(spark, d)
    hours = spark.range(START + HOUR, START + 30 * DAY + 1, HOUR).select(F.col("id").alias("end_us"))
    mean = points.groupBy("node_id").agg(F.floor(F.avg("value")).cast("bigint").alias("mean"))
    filled = mean.crossJoin(F.broadcast(hours)).join(points, ["node_id", "end_us"], "left").select("node_id", "end_us", F.coalesce("value", "mean").alias("value"))
    series = att.execution_series(_executions(spark, d), START, START + 30 * DAY, HOUR)
    out = att.resource_overlap(series, filled, START, START + 30 * DAY, HOUR)
    return out.select("node_id", "family", "status", F.col("score").cast("string").alias("score"), F.col("runtime_us").cast("bigint").alias("runtime_us"), F.round("share", 6).alias("share"), F.round("r", 6).alias("r"))


ORACLES["resource_overlap"] = f"""WITH {i.SLOW_CTE}{_SERIES}, {i.METRIC_CTE.lstrip()},
h AS (SELECT unnest(generate_series({START + HOUR}, {START + 30 * DAY}, {HOUR})) AS end_us),
mean AS (SELECT node_id, CAST(floor(avg(value)) AS BIGINT) AS mean FROM metric GROUP BY 1),
filled AS (SELECT mean.node_id, h.end_us, coalesce(value, mean) AS value FROM mean CROSS JOIN h LEFT JOIN metric ON metric.node_id = mean.node_id AND metric.end_us = h.end_us),
ref AS (SELECT node_id, list_sort(list(value))[(count(*) - 1) // 5 + 1] AS reference FROM filled GROUP BY 1),
dense AS (SELECT f.node_id, f.end_us, k.family, coalesce(s.runtime_us, 0) AS x, f.value AS y, greatest(f.value - reference, 0) AS above
  FROM filled f JOIN ref USING (node_id) JOIN (SELECT DISTINCT node_id, family FROM series) k ON k.node_id = f.node_id LEFT JOIN series s ON s.node_id = f.node_id AND s.family = k.family AND s.end_us = f.end_us),
scored AS (SELECT node_id, family, sum(CAST(x AS HUGEINT) * above) AS score, sum(x) AS runtime, corr(x, y) AS r FROM dense GROUP BY 1, 2)
SELECT node_id, family, 'ok' AS status, CAST(score AS VARCHAR) AS score, CAST(runtime AS BIGINT) AS runtime_us, round(CAST(score AS DOUBLE) / sum(CAST(score AS DOUBLE)) OVER (PARTITION BY node_id), 6) AS share, round(r, 6) AS r FROM scored"""


@register(f"""WITH {i.METRIC_CTE} SELECT node_id, end_us, greatest(value - before, 0) AS value FROM (SELECT node_id, end_us, value, lag(value) OVER w AS before, end_us - lag(end_us) OVER w AS gap FROM metric WINDOW w AS (PARTITION BY node_id ORDER BY end_us)) WHERE gap = {HOUR}""")
def metric_increase(spark, d):
    return att.lag_increase(i.metric_points(spark, d), HOUR)


@register(_slow(f"""
, a AS (SELECT node_id, fingerprint, count(*) AS executions, CAST(sum(rows_examined) AS BIGINT) AS rows_examined FROM slow WHERE event_epoch_us >= {START + 15 * DAY} GROUP BY 1, 2),
b AS (SELECT node_id, fingerprint, count(*) AS executions, CAST(sum(rows_examined) AS BIGINT) AS rows_examined FROM slow WHERE event_epoch_us < {START + 15 * DAY} AND event_epoch_us >= {START + 14 * DAY} GROUP BY 1, 2)
SELECT a.*, a.executions - b.executions AS executions_delta, a.rows_examined - b.rows_examined AS rows_examined_delta, b.node_id IS NOT NULL AS baseline FROM a LEFT JOIN b USING (node_id, fingerprint)"""))
def baseline_join(spark, d):
    s = sl.canonical_slow(i.slow_events(spark, d))

    def sums(df):
        return df.groupBy("node_id", "fingerprint").agg(F.count(F.lit(1)).alias("executions"), F.sum("rows_examined").alias("rows_examined"))

    at = F.col("event_epoch_us")
    now, old = sums(s.filter(at >= START + 15 * DAY)), sums(s.filter((at < START + 15 * DAY) & (at >= START + 14 * DAY)))
    return att.with_baseline(now, old, ["node_id", "fingerprint"], ["executions", "rows_examined"]).select("node_id", "fingerprint", "executions", "rows_examined", "executions_delta", "rows_examined_delta", "baseline")


# Counters


_DELTA = f"""WITH {i.COUNTER_CTE.lstrip()},
m AS (SELECT DISTINCT node_id, ts_us FROM counter), b AS (SELECT node_id, ts_us, lag(ts_us) OVER (PARTITION BY node_id ORDER BY ts_us) AS before_us FROM m),
l AS (SELECT c.node_id, b.before_us AS start_us, c.ts_us AS end_us, c.command, c.calls - o.calls AS calls, c.usec - o.usec AS usec FROM counter c JOIN b USING (node_id, ts_us) JOIN counter o ON o.node_id = c.node_id AND o.command = c.command AND o.ts_us = b.before_us)"""


@register(f"""{_DELTA} SELECT node_id, start_us, end_us, command, CASE WHEN calls < 0 OR usec < 0 THEN 'counter_reset' ELSE 'ok' END AS status, CASE WHEN calls >= 0 AND usec >= 0 THEN calls END AS calls, CASE WHEN calls >= 0 AND usec >= 0 THEN usec END AS usec FROM l""")
def counter_delta(spark, d):
    return cn.counter_deltas(i.counters(spark, d)).filter("status <> 'initial'")


def _rates(spark, d) -> DataFrame:
    """Hourly sums per node and command as if each were one observed interval."""
    e = i.table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), F.col("event_type").alias("command"), (bucket(us, HOUR) + HOUR).alias("minute_us")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("usec"))


@register(f"""WITH {i.METRIC_CTE.lstrip()}, r AS (SELECT 'n' || (user_id % 3) AS node_id, event_type AS command, epoch_us(ts) - epoch_us(ts) % {HOUR} + {HOUR} AS end_us, count(*) AS calls, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS usec FROM events GROUP BY 1, 2, 3)
  SELECT node_id, command, count(*) AS n, round(corr(calls, value), 6) AS r_calls, round(corr(usec, value), 6) AS r_usec FROM r JOIN metric USING (node_id, end_us) GROUP BY 1, 2""")
def command_association(spark, d):
    out = cn.association(_rates(spark, d), i.metric_points(spark, d))
    return out.select("node_id", "command", "n", F.round("r_calls", 6).alias("r_calls"), F.round("r_usec", 6).alias("r_usec"))


@register(f"""WITH s AS (SELECT 'n' || (user_id % 6) AS node_id, event_type AS command, count(*) AS calls, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS usec FROM events GROUP BY 1, 2), a AS (SELECT *, usec / calls AS avg_us FROM s WHERE calls >= 20)
  SELECT node_id, command, round(avg_us, 6) AS avg_us, round(median(avg_us) OVER (PARTITION BY command), 6) AS median_us, round(avg_us / median(avg_us) OVER (PARTITION BY command), 6) AS ratio FROM a QUALIFY count(*) OVER (PARTITION BY command) >= 3""")
def unit_cost_index(spark, d):
    e = i.table(spark, d, "events")
    sums = e.groupBy(F.concat(F.lit("n"), (F.col("user_id") % 6).cast("string")).alias("node_id"), F.col("event_type").alias("command")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("usec")).withColumn("seconds", F.lit(1.0))
    out = cn.unit_costs(sums, least_calls=20)
    return out.select("node_id", "command", *[F.round(c, 6).alias(c) for c in ("avg_us", "median_us", "ratio")])


@register(f"""SELECT 'n' || (user_id % 3) AS node_id, 'value' AS metric, epoch_us(ts) - epoch_us(ts) % {DAY} AS bucket_us, min(value) AS low, max(value) AS high, arg_max(value, ts) AS last, count(*) AS points FROM events GROUP BY 1, 3""")
def gauge_daily(spark, d):
    e = i.table(spark, d, "events")
    points = e.select(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), F.lit("value").alias("metric"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value")
    return cn.gauge_rollup(points, DAY).drop("mean")


@register("""WITH x AS (SELECT user_id % 20 AS shop, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events),
  p AS (SELECT shop, s AS t, 1 AS d FROM x UNION ALL SELECT shop, e, -1 FROM x), o AS (SELECT shop, sum(d) OVER (PARTITION BY shop ORDER BY t, d) AS n FROM p) SELECT shop, CAST(max(n) AS BIGINT) AS peak FROM o GROUP BY 1""")
def request_peaks(spark, d):
    e = i.table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    reqs = e.select((F.col("user_id") % 20).alias("shop"), us.alias("start_us"), (us + F.floor(F.col("value") * 60).cast("bigint") * 1_000_000).alias("end_us"))
    return cn.peak_concurrency(reqs, ["shop"])


@register(f"SELECT epoch_us(ts) - epoch_us(ts) % {DAY} AS bucket_us, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def log_histogram(spark, d):
    e = i.table(spark, d, "events")
    return cn.log_histogram(e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("category")), DAY)


@register(f"""WITH x AS (SELECT user_id % 4 AS g, event_id, epoch_us(ts) AS s, CAST(floor(value * 100) AS BIGINT) * 1000000 AS dur FROM events),
  p AS (SELECT *, unnest(generate_series(s - s % 60000000, s + greatest(dur, 1) - 1 - (s + greatest(dur, 1) - 1) % 60000000, 60000000)) AS m FROM x),
  r AS (SELECT g, m, CAST(sum(greatest(least(s + dur, m + 60000000) - greatest(s, m), 0)) AS BIGINT) AS overlap_us FROM p GROUP BY 1, 2), h AS (SELECT g, s - s % 60000000 AS m, count(*) AS count, CAST(sum(dur) AS BIGINT) AS duration_us FROM x GROUP BY 1, 2)
  SELECT 'g' || g AS group_id, m AS bucket_us, overlap_us, count, duration_us FROM r LEFT JOIN h USING (g, m)""")
def command_minutes(spark, d):
    e = i.table(spark, d, "events")
    cmds = e.select(F.lit("primary").alias("role"), F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("group_id"), F.col("event_id").cast("string").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), (F.floor(F.col("value") * 100).cast("bigint") * 1_000_000).alias("duration_us"))
    return cn.mongo_rollup(cmds, ("duration_us",)).select("group_id", "bucket_us", "overlap_us", "count", "duration_us")


# Sessions, identity, coverage


_GAP = 6 * HOUR


@register(f"""WITH s AS (SELECT 'i' || (user_id % 2) AS instance_id, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS seconds FROM events),
  m AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {_GAP} THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY session_id ORDER BY us)), r AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY us) AS run FROM m)
  SELECT instance_id, session_id, min(us) AS first_us, max(us) AS last_us, count(DISTINCT us) AS seen, max(seconds) AS max_seconds FROM r GROUP BY instance_id, session_id, run""")
def session_history(spark, d):
    return sessions.session_history(i.sightings(spark, d), _GAP).select("instance_id", "session_id", "first_us", "last_us", "seen", "max_seconds")


@register("""WITH b AS (SELECT o_custkey AS ip, min(epoch_us(o_orderdate)) AS lo, max(epoch_us(o_orderdate)) AS hi FROM orders GROUP BY 1, o_orderstatus),
  q AS (SELECT c_custkey AS ip, 883612800000000 AS tm FROM customer) SELECT CAST(q.ip AS VARCHAR) AS event_id, CASE WHEN count(*) FILTER (tm BETWEEN lo AND hi) > 1 THEN 'ambiguous_ip' WHEN count(*) FILTER (tm BETWEEN lo AND hi) = 1 THEN 'observed_interval' WHEN count(*) FILTER (lo <= tm AND NOT tm BETWEEN lo AND hi) > 0 THEN 'historical_binding_unverified' ELSE 'ip_not_observed' END AS reason
  FROM q LEFT JOIN b USING (ip) GROUP BY 1""")
def client_identity(spark, d):
    """Customers as addresses, their orders of one status as bindings, on 1 January 1998."""
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    b = i.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("ip"), F.col("o_orderstatus").alias("uid")).agg(F.min(us).alias("first_seen_us"), F.max(us).alias("last_seen_us"))
    b = b.withColumns({"created_us": F.col("first_seen_us"), "name": F.col("uid"), "namespace": F.lit("shop")})
    q = i.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), F.col("c_custkey").cast("string").alias("client_ip"), F.lit(883_612_800_000_000).alias("event_epoch_us"))
    return sessions.resolve_pod(q, b).select("event_id", "reason")


@register(f"""WITH f AS (SELECT DISTINCT o_custkey AS instance_id, epoch_us(o_orderdate) AS lo FROM orders), m AS (SELECT *, max(lo + {30 * DAY}) OVER (PARTITION BY instance_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f), r AS (SELECT *, sum(CASE WHEN lo <= before THEN 0 ELSE 1 END) OVER (PARTITION BY instance_id ORDER BY lo) AS run FROM m)
  SELECT instance_id, min(lo) AS lo, max(lo + {30 * DAY}) AS hi FROM r GROUP BY instance_id, run""")
def covered_days(spark, d):
    """Thirty days from each order as covered spans of its customer."""
    spans = i.table(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("lo")).distinct().withColumn("hi", F.col("lo") + 30 * DAY)
    return merge_intervals(spans, ["instance_id"])


@register("""WITH f AS (SELECT DISTINCT o_custkey AS host, o_orderkey AS n FROM orders) SELECT host, before + 1 AS first_missing, n - 1 AS last_missing, n - before - 1 AS missing FROM (SELECT host, n, lag(n) OVER (PARTITION BY host ORDER BY n) AS before FROM f) WHERE n - before > 1""")
def sequence_holes(spark, d):
    """Order numbers that each customer's orders leave out."""
    files = i.table(spark, d, "orders").select(F.col("o_custkey").alias("host"), F.concat(F.lit("mysql-bin."), F.col("o_orderkey").cast("string")).alias("log_file_name")).distinct()
    return cov.sequence_holes(files)


@register("SELECT p_partkey AS partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def missing_parts(spark, d):
    """Parts of which no large number was ever returned."""
    expected = i.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.lit("x").alias("sha256"))
    ready = i.table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("path"), F.lit("x").alias("sha256")).distinct()
    return cov.missing_parts(expected, ready).select(F.col("path").alias("partkey"))


@register(_ce("SELECT bucket_us AS hour_us, instance_id, database_name, table_name, count(*) AS rows FROM ev GROUP BY ALL"))
def hourly_name_counts(spark, d):
    return cov.hourly_names(i.change_events(spark, d))


@register(_ce("""SELECT strftime(make_timestamp(event_epoch_us), '%Y-%m-%d') AS event_date, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, min(event_epoch_us) AS first_us, count(*) AS rows FROM ev GROUP BY 1"""))
def part_catalog(spark, d):
    rows = i.change_events(spark, d).withColumn("_source_part_key", F.lit("p"))
    return cov.part_catalog(rows).select(F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.array_join("tables", ",").alias("tables"), F.array_join("operations", ",").alias("operations"), "first_us", "rows")


@register("""SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'missing' ELSE 'changed' END AS change FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5""")
def schema_difference(spark, d):
    """Customers as columns of a table, their segments as types; the target lacks those in debt and changes those of five nations."""
    c = i.table(spark, d, "customer")
    own = c.select("c_acctbal", "c_nationkey", F.lit("d").alias("database_name"), F.lit("t").alias("table_name"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("column_type"), F.lit(True).alias("nullable"), F.lit(None).cast("string").alias("default_value"), F.lit("").alias("extra"), F.lit("").alias("comment"), F.lit("").alias("collation"))
    target = own.filter("c_acctbal >= 0").withColumn("column_type", F.when(F.col("c_nationkey") < 5, "CHANGED").otherwise(F.col("column_type")))
    return schema_diff.diff_columns(own.drop("c_acctbal", "c_nationkey"), target.drop("c_acctbal", "c_nationkey")).select("name", "change")


@register(f"""WITH e AS (SELECT event_id, user_id % 4 AS g, epoch_us(ts) AS us, event_type FROM events), l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type = 'purchase'),
  j AS (SELECT l.event_id, r.event_id AS near_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.us - r.us), r.us) AS n FROM l JOIN r ON l.g = r.g AND abs(l.us - r.us) <= {HOUR}) SELECT event_id, near_id FROM j WHERE n = 1""")
def nearest_event(spark, d):
    """The purchase nearest in time to each error of a user group, within an hour."""
    e = i.table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("g"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type")
    out = lag.nearest_within(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), HOUR, ["g"])
    return out.select("event_id", F.col("near.event_id").alias("near_id"))


@register(f"""WITH e AS (SELECT user_id % 3 AS node, epoch_us(ts) AS us FROM events WHERE event_type = 'error'), m AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {4 * HOUR} THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY node ORDER BY us)),
  r AS (SELECT *, sum(f) OVER (PARTITION BY node ORDER BY us) AS run FROM m) SELECT node, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM r GROUP BY node, run HAVING count(*) >= 2""")
def error_runs(spark, d):
    e = i.table(spark, d, "events").filter("event_type = 'error'").select((F.col("user_id") % 3).alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    runs = islands(e, ["node"], "us", F.col("us") - F.col("prev") <= 4 * HOUR, width=DAY)
    return runs.groupBy("node", "run").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("run")


@register(f"""WITH e AS (SELECT 'n' || (user_id % 3) AS node_id, epoch_us(ts) AS us, event_type AS state FROM events), l AS (SELECT *, lag(state) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY node_id ORDER BY us)) SELECT node_id, us AS ts_us, state AS value, before FROM l WHERE n > 1 AND state <> before""")
def snapshot_changes(spark, d):
    e = i.table(spark, d, "events").select(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("state"))
    return cn.snapshot_changes(e, ["state"]).select("node_id", "ts_us", "value", "before")


@register("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) WHEN event_type = 'error' THEN '' END AS mark FROM events)
  SELECT event_id, CASE WHEN m = '' THEN NULL ELSE m END AS session FROM (SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM e)""")
def carried_state(spark, d):
    """State carried forward per user: a signup opens it, an error clears it."""
    e = i.table(spark, d, "events")
    mark = F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).when(F.col("event_type") == "error", "")
    return carried(e, ["user_id"], ["event_id"], mark, "session", width=1 << 16).select("event_id", "session")


# Sources, sinks, and what else there is


@register(_ce("SELECT upper(split_part(sql_text, ' ', 1)) AS verb, table_name, count(*) AS n FROM ev GROUP BY ALL"))
def statement_verbs(spark, d):
    return i.change_events(spark, d).select(statement_verb("sql_text").alias("verb"), "table_name").groupBy("verb", "table_name").agg(F.count(F.lit(1)).alias("n"))


@register(_ce("SELECT event_id, sql_text FROM ev WHERE operation = 'DELETE' ORDER BY event_epoch_us DESC, event_id DESC LIMIT 500"))
def csv_export_rows(spark, d):
    return src.csv_rows(i.change_events(spark, d).filter("operation = 'DELETE'"), 500).select("event_id", "sql_text")


@register(_ce(f"SELECT strftime(make_timestamp(event_epoch_us), '%Y-%m-%d') AS event_date, count(DISTINCT sql_text) AS texts FROM ev GROUP BY 1"))
def statement_dictionary(spark, d):
    _, words = src.split_statement_text(i.change_events(spark, d).withColumn("row_query", F.col("sql_text")))
    return words.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_date")).agg(F.count(F.lit(1)).alias("texts"))


@register(f"""WITH {i.METRIC_CTE.lstrip()}, h AS (SELECT unnest(generate_series({START + HOUR}, {START + 30 * DAY}, {HOUR})) AS end_us), n AS (SELECT DISTINCT node_id FROM metric)
  SELECT n.node_id, h.end_us, CASE WHEN m.value IS NULL THEN 'gaps' END AS reason, m.value * 1000 AS value_milli FROM n CROSS JOIN h LEFT JOIN metric m ON m.node_id = n.node_id AND m.end_us = h.end_us""")
def metric_periods(spark, d):
    points = i.metric_points(spark, d).withColumn("epoch", F.lit("e"))
    return cn.metric_windows(points, START, START + 30 * DAY, HOUR)


@register(f"""WITH s AS (SELECT 'n' || (user_id % 6) AS node_id, epoch_us(ts) - epoch_us(ts) % {DAY} AS day, count(*) AS reads, count(*) FILTER (event_type = 'error') AS slow FROM events GROUP BY 1, 2)
  SELECT a.node_id, a.day AS end_us, any_value(a.reads) AS reads, median(b.reads) AS peer_reads, CASE WHEN median(b.reads) < 30 THEN 'unknown' WHEN any_value(a.reads) < 0.8 * median(b.reads) THEN 'removed' ELSE 'usable' END AS status FROM s a JOIN s b ON a.day = b.day AND a.node_id <> b.node_id GROUP BY 1, 2""")
def peer_status(spark, d):
    e = i.table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = e.groupBy(F.lit("i").alias("instance_id"), F.concat(F.lit("n"), (F.col("user_id") % 6).cast("string")).alias("node_id"), bucket(us, DAY).alias("end_us")).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("event_type") == "error").alias("slow"))
    return lag.peer_health(s, 30, 0.8).select("node_id", "end_us", "reads", "peer_reads", "status")


@register(f"""WITH {i.SLOW_CTE}, k AS (SELECT *, event_epoch_us >= {START + 15 * DAY} AS late, fingerprint || '-' || (CAST(event_id AS BIGINT) % 40) AS family, query_time_ms * 1000 AS run,
    CASE WHEN CAST(event_id AS BIGINT) % 90 > 0 THEN rows_examined END AS seen, CASE WHEN CAST(event_id AS BIGINT) % 70 > 0 THEN lock_time_ms * 500 END AS held FROM slow),
  f AS (SELECT node_id, family, late, sum(run) AS run, sum(CASE WHEN run > 0 THEN CAST(run AS HUGEINT) * greatest(run - coalesce(held, 0), 0) // run ELSE 0 END) AS net, count(*) AS n, sum(seen) AS seen, count(seen) AS seen_n, sum(held) AS held, count(held) AS held_n FROM k GROUP BY ALL),
  j AS (SELECT n.*, b.run AS run_b, b.net AS net_b, CASE WHEN n.seen_n = n.n AND b.seen_n = b.n THEN n.seen - b.seen END AS scan, CASE WHEN n.held_n = n.n AND b.held_n = b.n THEN n.held - b.held END AS waited, b.n IS NOT NULL AS known FROM f n LEFT JOIN f b ON b.node_id = n.node_id AND b.family = n.family AND NOT b.late WHERE n.late),
  g AS (SELECT *, CASE WHEN known THEN greatest(net - net_b, 0) ELSE 0 END AS grown, CASE WHEN node_id = 'n1' THEN -1 ELSE 1 END AS rise FROM j),
  v AS (SELECT *, run * 3.0 * grown / greatest(run, 1) AS v, greatest(coalesce(scan, 0), 0) AS up FROM g)
  SELECT node_id, family, round(CAST(v AS DOUBLE), 3) AS final_score, CASE WHEN v > 0 OR up > 0 THEN row_number() OVER (PARTITION BY node_id ORDER BY v DESC, up DESC, family) END AS rank, CAST(run_b AS BIGINT) AS before_us, CAST(greatest(greatest(run - coalesce(run_b, 0), 0) - grown, 0) AS BIGINT) AS lock_wait_excluded_us, CAST(scan AS BIGINT) AS scan_growth,
    CASE WHEN scan > 0 THEN 'scan_growth_related_evidence' WHEN scan IS NOT NULL THEN 'no_scan_growth' WHEN NOT known THEN 'baseline_shape_unobserved' ELSE 'elapsed_overlap_only' END AS evidence,
    'runtime_includes_waits,scans_not_physical_iops,index_coverage_not_source_completeness' || CASE WHEN known THEN '' ELSE ',missing_slow_baseline_not_zero' END || CASE WHEN waited > 0 THEN ',lock_wait_increased_possible_victim' ELSE '' END || CASE WHEN rise <= 0 THEN ',resource_window_mean_not_increased' ELSE '' END AS warnings FROM v""")
def growth_rank(spark, d):
    """Families by growth of running time between the two halves of the month; the overlap score is three times the time.

    Scans and lock waits are unknown for some statements; on one node the resource fell."""
    s = sl.canonical_slow(i.slow_events(spark, d))
    n, run = F.col("event_id").cast("bigint"), F.col("query_time_ms") * 1000
    s = s.select(
        "node_id", "event_epoch_us", F.concat_ws("-", "fingerprint", (n % 40).cast("string")).alias("family"), run.alias("overlap_us"), run.alias("duration_us"),
        F.when(n % 90 > 0, F.col("rows_examined")).alias("rows_examined"), F.when(n % 70 > 0, F.col("lock_time_ms") * 500).alias("lock_time_us"),
    )
    late = F.col("event_epoch_us") >= START + 15 * DAY
    now, before = (att.family_costs(s.filter(half)) for half in (late, ~late))
    rise = spark.createDataFrame([("n0", 1), ("n1", -1), ("n2", 1)], "node_id string, delta long")
    out = att.growth_ranking(now, before, now.select("node_id", "family", (F.col("runtime_us") * 3).alias("score")), rise)
    told = F.array_join("warnings", ",").alias("warnings")
    return out.select("node_id", "family", F.round("final_score", 3).alias("final_score"), "rank", F.col("runtime_us_before").alias("before_us"), "lock_wait_excluded_us", F.col("rows_examined_delta").alias("scan_growth"), "evidence", told)
