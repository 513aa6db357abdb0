"""Fixed schemas of the tables, with the typed defaults that stand in for what older files lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row-change events: column, type, default. Storage holds no nulls: '' / 0 / -1 mean absent.
CHANGE_EVENT: list[tuple[str, str, object]] = [
    ("event_id", "string", ""),
    ("event_epoch_us", "bigint", 0),
    ("instance_id", "string", ""),
    ("host_instance_id", "string", ""),
    ("source_file_id", "string", ""),
    ("source_file_name", "string", ""),
    ("raw_event_type", "string", ""),
    ("operation", "string", "OTHER"),
    ("database_name", "string", ""),
    ("table_name", "string", ""),
    ("table_map_id", "bigint", 0),
    ("schema_version_id", "string", ""),
    ("server_id", "bigint", 0),
    ("thread_id", "bigint", 0),
    ("transaction_id", "string", ""),
    ("gtid", "string", ""),
    ("xid", "string", ""),
    ("start_position", "bigint", 0),
    ("end_position", "bigint", 0),
    ("row_index", "int", 0),
    ("error_code", "int", 0),
    ("execution_time_ms", "bigint", 0),
    ("sql_kind", "string", ""),
    ("sql_text", "string", ""),
    ("sql_bytes_base64", "string", ""),
    ("before_json", "string", ""),
    ("after_json", "string", ""),
    ("columns_json", "string", ""),
    ("row_query", "string", ""),
    ("header_epoch_us", "bigint", 0),
    ("commit_epoch_us", "bigint", 0),
    ("txn_last_committed", "bigint", 0),
    ("txn_sequence_number", "bigint", 0),
    ("txn_length_bytes", "bigint", 0),
    ("connection_id", "string", ""),
    ("connection_name", "string", ""),
    ("database_account", "string", ""),
    ("execution_status", "string", ""),
    ("error_message", "string", ""),
    ("batch_id", "string", ""),
    ("transaction_context_id", "string", ""),
    ("affected_rows", "bigint", 0),
    ("started_epoch_us", "bigint", 0),
    ("finished_epoch_us", "bigint", 0),
    ("statement_index", "int", -1),
]

#: Copies of a part, for electing one row per event.
COPY_COLUMNS = [("_content_revision", "bigint", 0), ("_source_part_key", "string", "")]
REQUIRED = ("event_epoch_us", "operation", "database_name", "table_name")

SLOW_EVENT: list[tuple[str, str, object]] = [
    ("event_id", "string", ""),
    ("event_epoch_us", "bigint", 0),
    ("instance_id", "string", ""),
    ("node_id", "string", ""),
    ("operation", "string", ""),
    ("database_name", "string", ""),
    ("table_name", "string", ""),
    ("fingerprint", "string", ""),
    ("sql_id", "string", ""),
    ("action", "string", ""),
    ("normalized_sql", "string", ""),
    ("sample_sql", "string", ""),
    ("sql_bytes", "bigint", 0),
    ("query_time_ms", "bigint", 0),
    ("lock_time_ms", "bigint", 0),
    ("rows_examined", "bigint", 0),
    ("rows_sent", "bigint", 0),
    ("database_account", "string", ""),
    ("client_ip", "string", ""),
    ("thread_id", "bigint", 0),
    ("source_file_name", "string", ""),
    ("_source_part_path", "string", ""),
    ("_source_part_id", "string", ""),
    ("_source_part_sha256", "string", ""),
    ("_content_revision", "bigint", 0),
]

COLUMN_META = "array<struct<index:int,name:string,type_id:int,metadata:int,nullable_known:boolean,nullable:boolean,primary_key:boolean>>"
METRIC_POINT = "node_id string, metric string, timestamp_ms bigint, value decimal(38,18), period int"
MONGO_COSTS = ("duration_us", "docs", "keys", "returned", "cpu_ns", "bytes_read", "read_us", "planning_us", "write_wait_us", "modified")


def struct_of(columns: list[tuple[str, str, object]]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind, _ in columns))


def typed(name: str, kind: str, default: object) -> Column:
    """The column with its type, null replaced by the default."""
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)).alias(name)


def with_defaults(df: DataFrame, columns: list[tuple[str, str, object]] = CHANGE_EVENT, keep: bool = True) -> DataFrame:
    """``df`` with all ``columns``, absent or null ones filled; others are kept behind them if ``keep``."""
    have = set(df.columns)
    own = [typed(*c) if c[0] in have else F.lit(c[2]).cast(c[1]).alias(c[0]) for c in columns]
    known = {c[0] for c in columns}
    return df.select(*own, *([F.col(f"`{c}`") for c in df.columns if c not in known] if keep else []))


def with_event_time(df: DataFrame) -> DataFrame:
    """UTC time and date derived from the microseconds, which order everything."""
    at = F.timestamp_micros("event_epoch_us")
    return df.withColumn("event_time_utc", at).withColumn("event_date", F.to_date(at))
