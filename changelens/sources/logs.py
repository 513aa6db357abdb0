"""Sources of log records: slow log, general log, execution audit, OLAP audit, HTTP access, running logs, load jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sc

#: The states that an audited execution may have.
AUDIT_STATES = ("SUCCESS", "FAILED", "CANCELLED", "TIMEOUT", "RUNNING")


def slow_events(records: DataFrame, *, instance_id: str, default_node: str, exclude_accounts: list[str] = (), seen: DataFrame | None = None) -> DataFrame:
    """Slow-log events of provider records: the milliseconds stamp wins over the text time; ids, operations and
    fingerprints are derived; repeated records and those already ``seen(event_id)`` go."""
    start = F.coalesce(F.when(F.col("Timestamp") > 0, F.col("Timestamp") * 1000), F.unix_micros(F.try_to_timestamp(F.col("QueryStartTime"))))
    node = F.when(F.coalesce("NodeId", F.lit("")) != "", F.col("NodeId")).otherwise(F.lit(default_node))
    out = records.withColumns({"event_epoch_us": start, "node_id": node}).filter("trim(coalesce(SQLText, '')) <> '' AND event_epoch_us > 0")
    if exclude_accounts:
        out = out.filter(~F.lower(F.coalesce("AccountName", F.lit(""))).isin([a.lower() for a in exclude_accounts]))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    identity = F.concat_ws("\x1f", F.lit(instance_id), "node_id", F.col("event_epoch_us").cast("string"), text("SqlId"), text("HostAddress"), text("ThreadId"), text("QueryTime"), F.substring("SQLText", 1, 512))
    verb = sc.first_verb(F.col("SQLText"))
    normal = sc.normalize_sql(F.col("SQLText"))
    took = F.coalesce(F.col("QueryTime"), F.lit(0.0))
    out = out.select(
        F.concat(F.lit("slow-"), F.substring(F.sha2(identity, 256), 1, 40)).alias("event_id"),
        "event_epoch_us",
        F.lit(instance_id).alias("instance_id"),
        "node_id",
        F.coalesce(sc.operation_of_type(F.col("SqlType")), F.when(verb.isin(*sc.DML_VERBS), verb).when(verb.isin(*sc.DDL_VERBS), "DDL").otherwise("OTHER")).alias("operation"),
        text("DBName").alias("database_name"),
        text("TableName").alias("table_name"),
        sc.fingerprint(F.lit("original"), normal).alias("fingerprint"),
        text("SqlId").alias("sql_id"),
        sc.sql_action(F.col("SQLText")).alias("action"),
        normal.alias("normalized_sql"),
        F.col("SQLText").alias("sample_sql"),
        F.octet_length("SQLText").cast("bigint").alias("sql_bytes"),
        F.round(took).cast("bigint").alias("query_time_ms"),
        F.round(F.coalesce("LockTime", F.lit(0.0))).cast("bigint").alias("lock_time_ms"),
        F.coalesce("RowsExamined", F.lit(0)).alias("rows_examined"),
        F.coalesce("RowsSent", F.lit(0)).alias("rows_sent"),
        text("AccountName").alias("database_account"),
        sc.client_host(text("HostAddress")).alias("client_ip"),
        F.coalesce("ThreadId", F.lit(0)).alias("thread_id"),
        (F.col("event_epoch_us") + (took * 1000).cast("bigint")).alias("finished_epoch_us"),
    ).dropDuplicates(["event_id"])
    return out if seen is None else out.join(seen.select("event_id"), "event_id", "left_anti")


def general_log_events(rows: DataFrame, *, instance_id: str, exclude_users: list[str] = ()) -> DataFrame:
    """Read statements of a general log with the session's database carried forward.

    ``rows``: ``server, thread, seq, event_epoch_us, user, command, argument``. ``Init DB``, ``Connect ... on db`` and
    ``USE db`` set the database, ``Quit`` and a plain ``Connect`` clear it. Identical rows are told apart by their order.
    """
    command, argument = F.lower("command"), F.col("argument")
    connected = F.regexp_extract(argument, r"(?i)\son\s+(\S+)\s+using\b", 1)
    used = F.regexp_extract(argument, r"(?i)^\s*use\s+`?([^`;\s]+)`?", 1)
    is_query = command.isin("query", "execute")
    mark = F.when(command == "init db", F.struct(F.trim(argument).alias("db"))).when(command == "connect", F.struct(connected.alias("db"))).when(command == "quit", F.struct(F.lit("").alias("db"))).when(is_query & (used != ""), F.struct(used.alias("db")))
    thread = Window.partitionBy("server", "thread").orderBy("event_epoch_us", "seq")
    held = F.last(mark, ignorenulls=True).over(thread.rowsBetween(Window.unboundedPreceding, 0))
    reads = rows.withColumn("database_name", F.coalesce(held["db"], F.lit(""))).filter(is_query & sc.is_read(argument))
    if exclude_users:
        reads = reads.filter(~F.lower("user").isin([u.lower() for u in exclude_users]))
    same = ["server", "thread", "event_epoch_us", "user", "argument"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("seq"))
    identity = F.concat_ws("\x1f", F.lit(instance_id), *[F.col(c).cast("string") for c in same], nth.cast("string"))
    return reads.select(F.concat(F.lit("general-"), F.substring(F.sha2(identity, 256), 1, 40)).alias("event_id"), "event_epoch_us", F.lit(instance_id).alias("instance_id"), "database_name", F.col("user").alias("database_account"), F.col("thread").alias("thread_id"), sc.first_verb(argument).alias("operation"), argument.alias("sql_text"))


def ingest_audit(new: DataFrame, existing: DataFrame, instances: list[str] | None = None, text_limit: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split new audit executions into accepted, duplicate and rejected ones; the table is insert-only.

    Rules: known state, allowed instance, finished >= started > 0, bounded text. Secrets are masked before comparison. The
    same id with the same content is a duplicate, with other content a conflict; that holds within the new rows too.
    """
    content = [c for c in new.columns if c != "event_id"]
    masked = new.withColumn("sql_text", sc.redact_secrets(F.col("sql_text"))["text"])
    rule = (
        F.when(F.coalesce("event_id", F.lit("")) == "", "AUDIT_ID_MISSING")
        .when(~F.coalesce(F.upper("execution_status").isin(*AUDIT_STATES), F.lit(False)), "AUDIT_STATUS")
        .when(F.lit(instances is not None) & ~F.coalesce(F.col("instance_id").isin(instances or [""]), F.lit(False)), "AUDIT_INSTANCE")
        .when(~F.coalesce((F.col("started_epoch_us") > 0) & (F.col("finished_epoch_us") >= F.col("started_epoch_us")), F.lit(False)), "AUDIT_TIME")
        .when(F.length("sql_text") > text_limit, "AUDIT_TEXT")
    )
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    judged = masked.withColumns({"reason": rule, "_digest": digest})
    order = Window.partitionBy("event_id").orderBy(F.col("reason").isNotNull(), "_digest")
    judged = judged.withColumns({"_first": F.first("_digest").over(order), "_nth": F.row_number().over(order)})
    old = existing.select("event_id", F.sha2(F.to_json(F.struct(*content)), 256).alias("_old"))
    joined = judged.join(old, "event_id", "left")
    base = F.coalesce("_old", "_first")
    verdict = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_digest") != base, "conflict").when(F.col("_old").isNotNull() | (F.col("_nth") > 1), "duplicate").otherwise("accepted")
    joined = joined.withColumn("_verdict", verdict)
    reason = F.when(F.col("_verdict") == "conflict", "AUDIT_ID_CONFLICT").otherwise(F.col("reason"))
    pick = lambda *v: joined.filter(F.col("_verdict").isin(*v))
    return pick("accepted").select(*new.columns), pick("duplicate").select(*new.columns), pick("rejected", "conflict").withColumn("reason", reason).select(*new.columns, "reason")


def olap_audit(df: DataFrame, start_us: int, end_us: int, database: str | None = None, account: str | None = None, keyword: str | None = None, client: str | None = None, status: str | None = None, slow_ms: int | None = None, zone: str = "Asia/Shanghai") -> DataFrame:
    """OLAP audit rows in a window; their local times become UTC. ``status``: success (OK, EOF) or failed (ERR)."""
    at = F.unix_micros(F.to_utc_timestamp("timestamp", zone))
    out = df.withColumn("timestamp_us", at).filter(F.col("timestamp_us").between(start_us, end_us))
    for column, value in (("db", database), ("user", account), ("stmt", keyword), ("client_ip", client)):
        if value:
            out = out.filter(F.lower(column).contains(value.lower()))
    if status:
        out = out.filter(F.upper("state").isin(*{"success": ("OK", "EOF"), "failed": ("ERR",)}[status]))
    return out if slow_ms is None else out.filter(F.col("query_time_ms") >= slow_ms)


def olap_loads(df: DataFrame, start_us: int, end_us: int, limit: int = 200) -> DataFrame:
    return df.filter(F.col("create_us").between(start_us, end_us)).orderBy(F.desc("create_us"), "load_id").limit(limit)


def http_log_rows(df: DataFrame, path_token: str) -> DataFrame:
    """Requests of an access log whose path has the token: status, duration, shop and page; 429 apart, a second cut at both ends."""
    line = F.col("line")
    status = F.regexp_extract(line, r'"\s+(\d{3})\b', 1).cast("int")
    path = F.regexp_extract(line, r'"(?:GET|POST|PUT|PATCH|DELETE|HEAD)\s+(\S+)', 1)
    out = df.select("ts_us", status.alias("status"), sc.duration_ms(F.regexp_extract(line, r"(?:duration|took|rt)=((?:[\d.]+(?:h|ms|us|ns|s|m))+)", 1)).alias("duration_ms"), path.alias("path"), F.regexp_extract(path, r"[?&]shop(?:_id)?=(\w+)", 1).alias("shop"), F.regexp_extract(path, r"[?&]page=(\d+)", 1).try_cast("int").alias("page"))
    out = out.filter(F.col("path").contains(path_token) & F.col("status").isNotNull())
    edge = out.agg(F.min("ts_us").alias("_a"), F.max("ts_us").alias("_b"))
    return out.crossJoin(F.broadcast(edge)).filter((F.col("ts_us") >= F.col("_a") + 1_000_000) & (F.col("ts_us") <= F.col("_b") - 1_000_000)).drop("_a", "_b").withColumn("throttled", F.col("status") == 429)


def running_events(df: DataFrame) -> DataFrame:
    """Checkpoint and role events of a document store's running log: ``node_id, ts_us, line``."""
    line = F.col("line")
    seconds = F.regexp_extract(line, r"(?i)checkpoint.*?took\s+([\d.]+)\s*s", 1).try_cast("double")
    mb = F.regexp_extract(line, r"(?i)checkpoint.*?([\d.]+)\s*MB", 1).try_cast("double")
    role = F.upper(F.regexp_extract(line, r"(?i)transition to (\w+)", 1))
    kind = F.when(line.rlike("(?i)checkpoint"), "checkpoint").when(role != "", "role").when(line.rlike(r"(?i)(starting|shutting down|terminated)"), "process")
    return df.select("node_id", "ts_us", kind.alias("kind"), seconds.alias("seconds"), mb.alias("mb"), F.when(role != "", role).alias("role")).filter("kind IS NOT NULL")
