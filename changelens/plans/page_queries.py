"""Queries on filters, pages, details and statement texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import bucket
from ..operators import coverage as cov
from ..operators import filters as fl
from ..operators import search
from ..operators import sessions
from ..operators import slow as sl
from ..sources import events as src
from . import inputs as i
from .registry import DAY, HOUR, START, over_changes, over_slow, register

_KEY = '[{"index":1,"name":"k","type_id":3,"metadata":0,"nullable_known":true,"nullable":false,"primary_key":true}]'
_K = "CAST(json_extract_string(after_json, '$.k') AS BIGINT)"


def _copies(rows):
    """Each event with a stale copy of an older revision."""
    stale = rows.withColumns({"operation": F.lit("STALE"), "_content_revision": F.lit(-1).cast("bigint"), "_source_part_key": F.lit("p")})
    return rows.withColumns({"_content_revision": F.lit(1).cast("bigint"), "_source_part_key": F.lit("p")}).unionByName(stale)


def _imaged(spark, d):
    """Row changes whose images before and after are the event's own, with their key column."""
    rows = i.change_events(spark, d)
    has_before = F.col("operation").isin("UPDATE", "DELETE")
    return rows.withColumns({"before_json": F.when(has_before, F.col("after_json")).otherwise(""), "columns_json": F.lit(_KEY)})


@register(over_changes(f"""SELECT source, count(*) AS events FROM (SELECT unnest(CASE operation WHEN 'INSERT' THEN ['all', 'audit'] WHEN 'DELETE' THEN ['all', 'database', 'slowlog'] ELSE ['all', 'database', 'binlog'] END) AS source FROM ev) GROUP BY 1"""))
def events_by_source(spark, d):
    kind = F.when(F.col("operation") == "INSERT", fl.AUDIT).when(F.col("operation") == "DELETE", fl.SLOW).otherwise("MYSQL_BINLOG")
    rows = i.change_events(spark, d).withColumn("raw_event_type", kind)
    counts = [fl.by_source(rows, s).groupBy(F.lit(s).alias("source")).agg(F.count(F.lit(1)).alias("events")) for s in ("audit", "database", "slowlog", "binlog", "all")]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@register(over_changes(f"SELECT event_id, operation FROM ev WHERE {_K} = 42 AND operation IN ('INSERT', 'UPDATE', 'DELETE')"))
def filter_primary_key(spark, d):
    rows = _imaged(spark, d)
    return rows.filter(fl.pk_match("042")).select("event_id", "operation")


@register(over_changes(f"SELECT event_id, operation, event_epoch_us FROM ev WHERE table_name = 'user_3' AND {_K} = 7 AND operation IN ('INSERT', 'UPDATE', 'DELETE')"))
def primary_key_history(spark, d):
    return search.pk_history(_imaged(spark, d), "SHOP", "User_3", "7").select("event_id", "operation", "event_epoch_us")


@register(over_slow(f"""SELECT event_id FROM slow WHERE event_epoch_us BETWEEN {START} AND {START + 20 * DAY} AND instance_id = 'i1' AND list_contains(list_transform(string_split(lower(table_name), ','), lambda x: trim(x)), 'log_1')
  AND contains(lower(database_account), 'acc3') AND contains(client_ip, '10.0.0') AND operation IN ('UPDATE', 'DELETE') AND contains(normalized_sql, 'click')"""))
def filter_slow(spark, d):
    rows = fl.slow_filter(sl.canonical_slow(i.slow_events(spark, d)), START, START + 20 * DAY, instance="i1", table="log_1", account="ACC3", client="10.0.0", operations=["update", "DELETE"], keyword="CLICK")
    return rows.select("event_id")


@register(over_changes("""SELECT event_id, strlen(sql_text) > 20 AS sql_truncated, substr(sql_text, 1, 20) AS sql_text FROM ev WHERE contains(lower(database_account), 'acc2') AND (contains(lower(sql_text), 'update') OR contains(table_name, 'update') OR contains(database_account, 'update'))"""))
def filter_audit(spark, d):
    return fl.audit_filter(i.change_events(spark, d), keyword="UPDATE", preview=20, account="ACC2").select("event_id", "sql_truncated", "sql_text")


@register(over_changes(f"""SELECT strftime(make_timestamp(event_epoch_us), '%Y-%m-%d') AS event_date FROM ev GROUP BY 1
  HAVING min(event_epoch_us) <= {START + 12 * DAY} AND max(event_epoch_us) >= {START + 9 * DAY} AND bool_or(contains(table_name, 'user_3')) AND bool_or(operation = 'DELETE')"""))
def candidate_parts(spark, d):
    """Days as parts: which may hold deletes of one table within a window."""
    parts = cov.part_catalog(i.change_events(spark, d).withColumn("_source_part_key", F.lit("p")))
    found = fl.candidate_parts(parts, START + 9 * DAY, START + 12 * DAY, table="USER_3", operations=["delete"])
    return found.select(F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


@register(over_changes(f"SELECT bucket_us AS ts, count(*) AS events, bucket_us < {START + HOUR // 2} OR bucket_us + {HOUR} > {START + 5 * DAY + HOUR // 3} + 1 AS partial FROM ev WHERE event_epoch_us BETWEEN {START + HOUR // 2} AND {START + 5 * DAY + HOUR // 3} GROUP BY bucket_us"))
def partial_buckets(spark, d):
    low, high = START + HOUR // 2, START + 5 * DAY + HOUR // 3
    rows = fl.in_window(i.change_events(spark, d), low, high)
    counts = rows.groupBy(bucket(F.col("event_epoch_us"), HOUR).alias("ts")).agg(F.count(F.lit(1)).alias("events"))
    return fl.mark_partial(counts, low, high, HOUR)


@register(over_changes("SELECT event_id, event_epoch_us, database_account FROM ev WHERE contains(database_account, 'acc4') ORDER BY event_epoch_us DESC, event_id DESC LIMIT 31 OFFSET 15"))
def audit_page(spark, d):
    rows = fl.audit_filter(i.change_events(spark, d), account="acc4")
    return search.search_audit(rows, 30, 15).select("event_id", "event_epoch_us", "database_account")


@register(over_changes("SELECT event_id, event_epoch_us, operation, sql_text, after_json FROM ev WHERE operation = 'DELETE'"))
def event_details(spark, d):
    """Whole rows of all deletes, by their ids, one copy of each. Copies are made in one pass: a union would be joined, and the ids hashed, side by side."""
    rows = i.change_events(spark, d)
    ids = rows.filter("operation = 'DELETE'").select("event_id")
    copies = rows.withColumn("_content_revision", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, -1)])))
    copies = copies.withColumns({"operation": F.when(F.col("_content_revision") == -1, "STALE").otherwise(F.col("operation")), "_source_part_key": F.lit("p")})
    return search.event_detail(copies, ids.unionByName(ids)).select("event_id", "event_epoch_us", "operation", "sql_text", "after_json")


@register(over_changes("SELECT event_id, sql_text AS row_query FROM ev ORDER BY event_epoch_us DESC, start_position DESC, event_id DESC LIMIT 101"))
def page_with_texts(spark, d):
    """A page of the facts, whose texts lie in a dictionary, with the texts of that page."""
    facts, words = src.split_statement_text(i.change_events(spark, d).withColumn("row_query", F.col("sql_text")))
    page = search.search_events(facts.withColumns({"_content_revision": F.lit(1), "_source_part_key": F.lit("p")}), 100)
    return search.with_statement_text(page, words).select("event_id", "row_query")


@register(over_changes("SELECT event_id, event_epoch_us FROM ev ORDER BY event_epoch_us DESC, start_position DESC, event_id DESC LIMIT 51 OFFSET 1900"))
def row_store_page(spark, d):
    return search.row_store_page(_copies(i.change_events(spark, d)), 50, 1900, ["event_id", "event_epoch_us"])


@register(over_changes(f"""SELECT event_id, CASE WHEN event_epoch_us BETWEEN {START + 3 * DAY} AND {START + 6 * DAY} AND instance_id = 'i0' THEN 'archived' ELSE 'full' END AS side FROM ev
  WHERE NOT (event_epoch_us BETWEEN {START + 3 * DAY} AND {START + 6 * DAY} AND instance_id = 'i0') OR operation <> 'QUERY'"""))
def sliced_source(spark, d):
    """Three days of one instance come from an archive that has row changes only."""
    rows = i.change_events(spark, d).select("event_id", "event_epoch_us", "instance_id", "operation")
    windows = rows.filter("instance_id = 'i0'").agg(F.min("instance_id").alias("instance_id"), F.lit(START + 3 * DAY).alias("start_us"), F.lit(START + 6 * DAY).alias("end_us"))
    archived = rows.filter("operation <> 'QUERY'").withColumn("side", F.lit("archived"))
    return search.sliced_source(rows.withColumn("side", F.lit("full")), archived, windows).select("event_id", "side")


def _live(spark, d):
    """Live sessions: each event as a sighting on one snapshot."""
    s = i.sightings(spark, d)
    kind = F.col("kinds")[0]
    return s.withColumns(
        {
            "command": F.when(kind == "view", "Sleep").otherwise("Query"),
            "state": F.when(kind == "error", "Waiting for table metadata lock").otherwise(""),
            "time_s": F.col("seconds"),
            "trx_id": F.when(kind == "purchase", F.col("session_id")).when(kind == "view", F.col("session_id")).otherwise(""),
            "trx_s": F.col("seconds"),
            "database_name": F.lit("shop"),
            "ts_us": bucket(F.col("ts_us"), DAY),
        }
    ).drop("kinds")


_LIVE = f"""WITH live AS (SELECT 'i' || (user_id % 2) AS instance_id, 'n' || (user_id % 3) AS node_id, CAST(user_id AS VARCHAR) AS session_id, 'u' || (user_id % 5) AS "user", epoch_us(ts) - epoch_us(ts) % {DAY} AS ts_us,
  event_type = 'view' AS idle, event_type = 'error' AS waiting, CASE WHEN event_type IN ('purchase', 'view') THEN CAST(user_id AS VARCHAR) ELSE '' END AS trx_id, CAST(floor(value) AS BIGINT) AS time_s, props FROM events),
flagged AS (SELECT *, list_filter([CASE WHEN NOT idle AND time_s >= 30 THEN 'long_running' END, CASE WHEN waiting THEN 'lock_wait' END, CASE WHEN trx_id <> '' AND time_s >= 30 THEN 'long_trx' END, CASE WHEN idle AND trx_id <> '' AND time_s >= 10 THEN 'idle_trx' END], lambda x: x IS NOT NULL) AS kinds FROM live)"""


@register(f"{_LIVE} SELECT session_id, time_s, props FROM live WHERE NOT idle ORDER BY time_s DESC, session_id, props LIMIT 40")
def running_sessions(spark, d):
    rows = _live(spark, d).withColumn("props", F.substring("sql_text", 8, 1 << 16))
    top = search.running_sessions(rows.withColumn("session_id", F.concat_ws("\x00", "session_id", "props")), 40)
    return top.select(F.substring_index("session_id", "\x00", 1).alias("session_id"), "time_s", "props")


@register(f"{_LIVE} SELECT array_to_string(kinds, ',') AS kinds, count(*) AS sessions FROM flagged GROUP BY 1")
def session_flags(spark, d):
    return sessions.session_flags(_live(spark, d)).groupBy(F.array_join("kinds", ",").alias("kinds")).agg(F.count(F.lit(1)).alias("sessions"))


@register(f"{_LIVE} SELECT instance_id, node_id, ts_us, \"user\", count(*) AS total, count(*) FILTER (NOT idle) AS active, count(*) FILTER (len(kinds) > 0) AS abnormal FROM flagged GROUP BY ALL")
def session_counts(spark, d):
    return sessions.session_counts(sessions.session_flags(_live(spark, d)), "user")


@register(f"""{_LIVE}, w AS (SELECT *, max(time_s) FILTER (waiting) OVER (PARTITION BY instance_id, node_id, ts_us) AS oldest_wait_s, CASE WHEN trx_id <> '' OR NOT idle THEN time_s END AS age_s FROM flagged)
  SELECT instance_id, node_id, ts_us, age_s, oldest_wait_s, row_number() OVER (PARTITION BY instance_id, node_id, ts_us ORDER BY age_s DESC) AS rank FROM w WHERE NOT waiting AND age_s >= oldest_wait_s QUALIFY rank <= 20""")
def lock_holders(spark, d):
    out = sessions.lock_holder_candidates(sessions.session_flags(_live(spark, d)))
    return out.select("instance_id", "node_id", "ts_us", "age_s", "oldest_wait_s", "rank")


@register(over_changes("""
, h AS (SELECT database_account AS holder, min(event_epoch_us) AS first_us, transaction_id AS session_id FROM ev GROUP BY 1, 3)
SELECT holder, first_us, session_id FROM h WHERE holder < 'acc3' OR (holder = 'acc3' AND first_us < (SELECT max(first_us) FROM h WHERE holder = 'acc3')) ORDER BY holder DESC, first_us DESC, session_id DESC LIMIT 100"""))
def history_page(spark, d):
    """The page behind the newest entry of one holder."""
    h = i.change_events(spark, d).groupBy(F.col("database_account").alias("holder"), F.col("transaction_id").alias("session_id")).agg(F.min("event_epoch_us").alias("first_us"))
    top = h.filter("holder = 'acc3'").agg(F.max("first_us")).first()[0]
    return search.history_page(h, 100, ("acc3", top, "")).select("holder", "first_us", "session_id")


@register(over_changes("""SELECT event_id, CASE WHEN table_name IN ('user_0', 'user_1', 'user_2') THEN NULL WHEN table_name = 'user_7' THEN NULL ELSE 'shop' END AS default_database,
  CASE WHEN table_name IN ('user_0', 'user_1', 'user_2') THEN 'ambiguous' WHEN table_name = 'user_7' THEN 'unknown' ELSE 'unique_owner' END AS reason FROM ev"""))
def default_databases(spark, d):
    """Three tables have two owners, one has none known."""
    rows = i.change_events(spark, d)
    owners = rows.select("database_name", "table_name").distinct().filter("table_name <> 'user_7'")
    twice = owners.filter(F.col("table_name").isin("user_0", "user_1", "user_2")).withColumn("database_name", F.lit("archive"))
    return search.with_default_database(rows, owners.unionByName(twice)).select("event_id", "default_database", F.col("database_reason").alias("reason"))


@register(over_changes("""SELECT event_id, CASE operation
  WHEN 'INSERT' THEN 'INSERT INTO `shop`.`' || table_name || '` (`k`) VALUES (' || json_extract_string(after_json, '$.k') || ');'
  WHEN 'UPDATE' THEN 'UPDATE `shop`.`' || table_name || '` SET `k` = ' || json_extract_string(after_json, '$.k') || ' WHERE `k` = ' || json_extract_string(after_json, '$.k') || ';'
  ELSE 'DELETE FROM `shop`.`' || table_name || '` WHERE `k` = ' || json_extract_string(after_json, '$.k') || ';' END AS statement
  FROM ev WHERE operation IN ('INSERT', 'UPDATE', 'DELETE')"""))
def row_change_sql(spark, d):
    rows = i.change_events(spark, d).withColumn("before_json", F.col("after_json"))
    return rows.filter(F.col("operation").isin("INSERT", "UPDATE", "DELETE")).select("event_id", search.render_sql("rows").alias("statement"))
