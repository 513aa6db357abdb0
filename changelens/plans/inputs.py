"""Projections of the given tables into the engine's own tables, once for Spark and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import scan
from ..operators.changes import derive_event_columns
from ..schemas import SLOW_EVENT, with_defaults, with_event_time

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000
#: 1 January 2024 UTC, where the events begin.
EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _operation():
    kind = F.col("event_type")
    return F.when(kind == "signup", "INSERT").when(kind.isin("click", "purchase"), "UPDATE").when(kind == "error", "DELETE").otherwise("QUERY")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row changes made of ``events``: an event is a statement on one of eight tables, four make a transaction."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("user_"), (F.col("user_id") % 8).cast("string"))
    value, user = F.floor(F.col("value") * 10).cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    sql = (
        F.when(kind == "signup", F.concat(F.lit("INSERT INTO "), name, F.lit(" (id, v) VALUES ("), user, F.lit(", "), value, F.lit(")")))
        .when(kind == "click", F.concat(F.lit("UPDATE "), name, F.lit(" SET v = "), value, F.lit(" WHERE id = "), user))
        .when(kind == "purchase", F.concat(F.lit("UPDATE "), name, F.lit(" SET n = "), value, F.lit(" WHERE id = "), user))
        .when(kind == "error", F.concat(F.lit("DELETE FROM "), name, F.lit(" WHERE id = "), user))
        .otherwise(F.concat(F.lit("SELECT * FROM "), name, F.lit(" WHERE id = "), user))
    )
    txn = F.floor(F.col("event_id") / 4).cast("bigint").cast("string")
    out = e.select(
        F.col("event_id").cast("string").alias("event_id"),
        _micros("ts").alias("event_epoch_us"),
        F.concat(F.lit("i"), (F.col("user_id") % 2).cast("string")).alias("instance_id"),
        _operation().alias("operation"),
        F.lit("shop").alias("database_name"),
        name.alias("table_name"),
        txn.alias("transaction_id"),
        F.col("user_id").alias("thread_id"),
        F.col("event_id").alias("start_position"),
        F.col("event_id").alias("end_position"),
        F.lit(1).alias("row_index"),
        F.floor(F.col("value")).cast("bigint").alias("execution_time_ms"),
        F.lit("ORIGINAL").alias("sql_kind"),
        sql.alias("sql_text"),
        F.col("props").alias("after_json"),
        F.concat(F.lit("acc"), (F.col("user_id") % 5).cast("string")).alias("database_account"),
        _micros("ts").alias("header_epoch_us"),
        F.max(_micros("ts")).over(Window.partitionBy(txn)).alias("commit_epoch_us"),
        (F.col("event_id") % 7).alias("txn_sequence_number"),
        (F.col("event_id") % 3).alias("txn_last_committed"),
        F.lit("MYSQL_BINLOG").alias("raw_event_type"),
    )
    return with_event_time(with_defaults(out))


def derived_events(spark: SparkSession, sf_dir: str, width_us: int = HOUR_US) -> DataFrame:
    return derive_event_columns(change_events(spark, sf_dir), width_us)


CHANGE_CTE = f"""
raw AS (SELECT *, 'user_' || (user_id % 8) AS t, CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS x, epoch_us(ts) AS us FROM events),
ce AS (SELECT CAST(event_id AS VARCHAR) AS event_id, us AS event_epoch_us, 'i' || (user_id % 2) AS instance_id,
  CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'QUERY' END AS operation,
  'shop' AS database_name, t AS table_name, CAST(event_id // 4 AS VARCHAR) AS transaction_id, event_id AS start_position,
  CAST(floor(value) AS BIGINT) AS execution_time_ms, props AS after_json, 'acc' || (user_id % 5) AS database_account,
  CASE event_type WHEN 'signup' THEN 'INSERT INTO ' || t || ' (id, v) VALUES (' || user_id || ', ' || x || ')'
    WHEN 'click' THEN 'UPDATE ' || t || ' SET v = ' || x || ' WHERE id = ' || user_id
    WHEN 'purchase' THEN 'UPDATE ' || t || ' SET n = ' || x || ' WHERE id = ' || user_id
    WHEN 'error' THEN 'DELETE FROM ' || t || ' WHERE id = ' || user_id
    ELSE 'SELECT * FROM ' || t || ' WHERE id = ' || user_id END AS sql_text,
  CASE event_type WHEN 'signup' THEN 'INSERT INTO ' || t || ' (id, v) VALUES (?)'
    WHEN 'click' THEN 'UPDATE ' || t || ' SET v=? WHERE id=?'
    WHEN 'purchase' THEN 'UPDATE ' || t || ' SET n=? WHERE id=?'
    WHEN 'error' THEN 'DELETE FROM ' || t || ' WHERE id=?'
    ELSE 'SELECT * FROM ' || t || ' WHERE id=?' END AS normalized,
  us AS header_epoch_us, max(us) OVER (PARTITION BY event_id // 4) AS commit_epoch_us, event_id % 7 AS seq, event_id % 3 AS committed,
  us - us % {HOUR_US} AS bucket_us FROM raw),
ev AS (SELECT *, substr(sha256('original' || chr(0) || normalized), 1, 32) AS fingerprint, 't:' || transaction_id AS txn_key,
  strlen(sql_text) + strlen(after_json) AS payload_bytes, operation IN ('INSERT', 'UPDATE', 'DELETE') AS row_event FROM ce)"""


def slow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow-log events made of ``events``; a third of them come from a second part too."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    shape = F.concat_ws("-", "event_type", (k % 10).cast("string"))
    out = e.select(
        F.col("event_id").cast("string").alias("event_id"),
        _micros("ts").alias("event_epoch_us"),
        F.concat(F.lit("i"), (F.col("user_id") % 2).cast("string")).alias("instance_id"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"),
        _operation().alias("operation"),
        F.lit("shop").alias("database_name"),
        F.concat(F.lit("user_"), (F.col("user_id") % 8).cast("string"), F.lit(", log_"), (F.col("user_id") % 4).cast("string")).alias("table_name"),
        F.substring(F.sha2(shape, 256), 1, 32).alias("fingerprint"),
        shape.alias("normalized_sql"),
        F.octet_length("props").cast("bigint").alias("sql_bytes"),
        F.floor(F.col("value") * 10).cast("bigint").alias("query_time_ms"),
        k.alias("lock_time_ms"),
        (k * 1000).alias("rows_examined"),
        k.alias("rows_sent"),
        F.concat(F.lit("acc"), (F.col("user_id") % 5).cast("string")).alias("database_account"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string")).alias("client_ip"),
        F.lit("part-a").alias("_source_part_path"),
        F.lit("1").alias("_source_part_id"),
    )
    again = out.filter(F.col("event_id").cast("bigint") % 3 == 0).withColumn("_source_part_path", F.lit("part-b")).withColumn("query_time_ms", F.lit(-1).cast("bigint"))
    return with_defaults(out.unionByName(again), SLOW_EVENT)


SLOW_CTE = f"""
se AS (SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS event_epoch_us, 'i' || (user_id % 2) AS instance_id, 'n' || (user_id % 3) AS node_id,
  CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'QUERY' END AS operation,
  'shop' AS database_name, 'user_' || (user_id % 8) || ', log_' || (user_id % 4) AS table_name,
  event_type || '-' || (CAST(regexp_extract(props, '\\d+') AS BIGINT) % 10) AS normalized_sql, strlen(props) AS sql_bytes,
  CAST(floor(value * 10) AS BIGINT) AS query_time_ms, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS lock_time_ms,
  'acc' || (user_id % 5) AS database_account, '10.0.0.' || (user_id % 9) AS client_ip, epoch_us(ts) - epoch_us(ts) % {HOUR_US} AS bucket_us FROM events),
slow AS (SELECT *, substr(sha256(normalized_sql), 1, 32) AS fingerprint, lock_time_ms * 1000 AS rows_examined, lock_time_ms AS rows_sent FROM se)"""


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric per node and hour, stamped at the hour's end: the mean value in hundredths."""
    e = table(spark, sf_dir, "events")
    us = _micros("ts")
    return e.groupBy(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), (us - us % HOUR_US + HOUR_US).alias("end_us")).agg(F.floor(F.sum(F.floor(F.col("value") * 100).cast("bigint")) / F.count(F.lit(1))).cast("bigint").alias("value"))


METRIC_CTE = f"""
metric AS (SELECT 'n' || (user_id % 3) AS node_id, epoch_us(ts) - epoch_us(ts) % {HOUR_US} + {HOUR_US} AS end_us,
  CAST(floor(sum(CAST(floor(value * 100) AS BIGINT)) / count(*)) AS BIGINT) AS value FROM events GROUP BY 1, 2)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters per node and command, reset now and then: ``node_id, command, ts_us, calls, usec, uptime, epoch``."""
    e = table(spark, sf_dir, "events")
    node = (F.col("user_id") % 6).cast("string")
    k = F.floor(F.col("value") * 100).cast("bigint")
    rows = e.select(F.concat(F.lit("n"), node).alias("node_id"), F.col("event_type").alias("command"), _micros("ts").alias("ts_us"), k.alias("k"), "event_id")
    out = scan(rows, ["node_id", "command"], ["event_id"], 1 << 16, calls=(F.lit(1), "total"), usec=(F.col("k"), "total")).drop("k")
    return out.withColumn("calls", F.when(F.col("event_id") % 97 == 0, 0).otherwise(F.col("calls"))).drop("event_id")


COUNTER_CTE = """
counter AS (SELECT 'n' || (user_id % 6) AS node_id, event_type AS command, epoch_us(ts) AS ts_us, event_id,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE count(*) OVER w END AS calls, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS usec
  FROM events WINDOW w AS (PARTITION BY user_id % 6, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session sightings: a user's events on a node."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("i"), (F.col("user_id") % 2).cast("string")).alias("instance_id"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"),
        F.lit("app").alias("client"),
        _micros("ts").alias("ts_us"),
        F.floor("value").cast("bigint").alias("seconds"),
        F.array("event_type").alias("kinds"),
        F.concat(F.lit("SELECT "), "props").alias("sql_text"),
    )
