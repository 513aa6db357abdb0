"""Filters on events: time with partition pruning, source, dimensions, keywords, keys, table membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COLUMN_META

DAY_US = 86_400_000_000
#: Event types of audited executions and of slow-log records.
AUDIT, SLOW = "TABULARIS_AUDIT", "SLOW_LOG"
KEYWORD_COLUMNS = ("sql_text", "before_json", "after_json", "transaction_id", "source_file_name", "connection_name", "database_account", "error_message")


def in_window(df: DataFrame, start_us: int, end_us: int, retention_days: int | None = None, now_us: int | None = None) -> DataFrame:
    """Events from start to end, both included, clipped to retention and now; the date is restricted too, so that
    partitions are pruned."""
    if now_us is not None:
        end_us = min(end_us, now_us)
        if retention_days is not None:
            start_us = max(start_us, now_us - retention_days * DAY_US)
    out = df.filter(F.col("event_epoch_us").between(start_us, end_us))
    if "event_date" in df.columns:
        days = [F.to_date(F.timestamp_micros(F.lit(x))) for x in (start_us, end_us)]
        out = out.filter(F.col("event_date").between(*days))
    return out


def by_source(df: DataFrame, source: str, column: str = "raw_event_type") -> DataFrame:
    """``audit``, ``database`` (all but audit), ``slowlog``, ``binlog`` (neither audit nor slow log) or ``all``."""
    kind = F.col(column)
    tests = {"audit": kind == AUDIT, "database": kind != AUDIT, "slowlog": kind == SLOW, "binlog": ~kind.isin(AUDIT, SLOW), "all": F.lit(True)}
    if source not in tests:
        raise ValueError(f"unknown source {source!r}")
    return df.filter(tests[source])


def by_transaction(df: DataFrame, transaction: str) -> DataFrame:
    return df.filter((F.col("transaction_id") == transaction) | (F.col("gtid") == transaction))


def literal_in(column: str, text: str) -> Column:
    """Case-insensitive literal substring; ``%`` and ``_`` are ordinary characters."""
    return F.lower(column).contains(text.lower())


def by_dimensions(df: DataFrame, exact: bool = False, instance: str | None = None, status: str | None = None, connection: str | None = None, account: str | None = None, database: str | None = None, table: str | None = None) -> DataFrame:
    """Instance and status match whole, the others as substrings, or all whole if ``exact``; case never counts."""

    def test(column: str, value: str) -> Column:
        return F.lower(column) == value.lower() if exact else literal_in(column, value)

    for column, value in (("instance_id", instance), ("execution_status", status)):
        if value:
            df = df.filter(F.lower(column) == value.lower())
    if connection:
        df = df.filter(test("connection_id", connection) | test("connection_name", connection))
    for column, value in (("database_account", account), ("database_name", database), ("table_name", table)):
        if value:
            df = df.filter(test(column, value))
    return df


def by_operations(df: DataFrame, operations: list[str]) -> DataFrame:
    return df.filter(F.upper("operation").isin([o.upper() for o in operations])) if operations else df


def keyword_contains(df: DataFrame, text: str, mode: str = "AND", columns: tuple[str, ...] = KEYWORD_COLUMNS) -> DataFrame:
    """Up to 20 terms between white space; a term hits where any column has it, case aside."""
    terms = text.split()
    if len(terms) > 20:
        raise ValueError("at most 20 terms")
    if not terms:
        return df
    tests = [reduce(lambda a, b: a | b, [literal_in(c, t) for c in columns]) for t in terms]
    return df.filter(reduce((lambda a, b: a & b) if mode.upper() == "AND" else (lambda a, b: a | b), tests))


def keyword_tokens(df: DataFrame, text: str, mode: str = "AND") -> DataFrame:
    """Terms of ASCII letters and digits match whole tokens; mixed terms need their tokens and the exact text; terms
    without an ASCII token match as substrings."""
    import re

    terms = text.lower().split()
    if not terms:
        return df
    hay = F.lower(F.concat_ws(" ", "before_json", "after_json", "transaction_id", "source_file_name"))
    tokens = F.regexp_extract_all(hay, F.lit("[a-z0-9]+"), 0)
    tests = []
    for term in terms:
        parts = re.findall("[a-z0-9]+", term)
        test = F.lit(True)
        for p in parts:
            test = test & F.array_contains(tokens, p)
        if parts != [term]:
            test = test & hay.contains(term)
        tests.append(test)
    return df.filter(reduce((lambda a, b: a & b) if mode.upper() == "AND" else (lambda a, b: a | b), tests))


def by_image_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose image before or after has ``value`` under ``key``, as a number or as a string."""

    def hit(column: str) -> Column:
        return F.from_json(column, "map<string,string>")[key] == value

    return df.filter(F.coalesce(hit("after_json"), F.lit(False)) | F.coalesce(hit("before_json"), F.lit(False)))


#: Column type ids of integers and of binary strings.
INTEGER_TYPES = (1, 2, 3, 8, 9, 13)
BINARY_TYPES = (16, 249, 250, 251, 252)


def primary_keys(columns_json: Column) -> Column:
    """Names and type ids of the primary-key columns, in order."""
    parsed = F.from_json(columns_json, COLUMN_META)
    return F.transform(F.filter(parsed, lambda c: c["primary_key"]), lambda c: F.struct(c["name"].alias("name"), c["type_id"].alias("type_id")))


def pk_match(value: str) -> Column:
    """Whether a row change touches the row with this primary key: true, false, or null where that cannot be known.

    One primary-key column is needed. Integers compare as numbers; INSERT needs the image after, UPDATE and DELETE the
    one before; UPDATE matches the old or the new key.
    """
    keys = primary_keys(F.col("columns_json"))
    single = F.size(keys) == 1
    name, kind = keys[0]["name"], keys[0]["type_id"]

    def same(column: str) -> Column:
        got = F.from_json(column, "map<string,string>")[name]
        wanted = F.lit(value)
        as_int = got.cast("decimal(38,0)") == wanted.cast("decimal(38,0)")
        binary = F.when(got.startswith("base64:"), F.hex(F.unbase64(F.substring(got, 8, 1 << 20)))).when(got.startswith("0x"), F.upper(F.substring(got, 3, 1 << 20))).otherwise(F.hex(F.encode(got, "utf-8")))
        target = F.when(wanted.startswith("0x"), F.upper(F.substring(wanted, 3, 1 << 20))).otherwise(F.hex(F.encode(wanted, "utf-8")))
        return F.when(kind.isin(*INTEGER_TYPES), as_int).when(kind.isin(*BINARY_TYPES), binary == target).otherwise(got == wanted)

    before, after = same("before_json"), same("after_json")
    operation = F.upper("operation")
    hit = F.when(operation == "INSERT", after).when(operation == "DELETE", before).when(operation == "UPDATE", F.when(before, True).otherwise(before | after))
    return F.when(single & operation.isin("INSERT", "UPDATE", "DELETE"), hit)


def by_table_member(df: DataFrame, table: str, column: str = "table_name") -> DataFrame:
    """The column lists tables between commas; one name matches a member, a name with a comma the whole text."""
    if "," in table:
        return df.filter(F.lower(F.trim(column)) == table.strip().lower())
    return df.filter(F.exists(F.split(column, ","), lambda x: F.lower(F.trim(x)) == table.strip().lower()))


def slow_filter(df: DataFrame, start_us: int | None = None, end_us: int | None = None, instance: str | None = None, node: str | None = None, fingerprint: str | None = None, database: str | None = None, table: str | None = None, account: str | None = None, client: str | None = None, operations: list[str] | None = None, keyword: str | None = None, connection: str | None = None, status: str | None = None) -> DataFrame:
    """Filters of the slow log; connection and status are unknown there and refused."""
    if connection or status:
        raise ValueError("slow-log analytics cannot filter by connection or status")
    if start_us is not None and end_us is not None:
        df = in_window(df, start_us, end_us)
    for column, value in (("instance_id", instance), ("node_id", node), ("fingerprint", fingerprint)):
        if value:
            df = df.filter(F.col(column) == value)
    if database:
        df = df.filter(F.lower("database_name") == database.lower())
    if table:
        df = by_table_member(df, table)
    for column, value in (("database_account", account), ("client_ip", client)):
        if value:
            df = df.filter(literal_in(column, value))
    df = by_operations(df, operations or [])
    if keyword:
        df = keyword_contains(df, keyword, "AND", ("sample_sql", "normalized_sql", "database_name", "table_name", "sql_id"))
    return df


AUDIT_COLUMNS = ("sql_text", "database_name", "table_name", "connection_name", "database_account", "error_message")


def audit_filter(df: DataFrame, keyword: str | None = None, preview: int = 4096, **dimensions: str | None) -> DataFrame:
    """Filters of the execution audit; statements are cut to a preview with a flag."""
    df = by_dimensions(df, **dimensions)
    if keyword:
        df = keyword_contains(df, keyword, "AND", AUDIT_COLUMNS)
    return df.withColumn("sql_truncated", F.length("sql_text") > preview).withColumn("sql_text", F.substring("sql_text", 1, preview))


def _any_has(column: str, text: str) -> Column:
    return F.exists(column, lambda x: x.contains(text.lower()))


def candidate_parts(catalog: DataFrame, start_us: int, end_us: int, database: str | None = None, table: str | None = None, operations: list[str] | None = None) -> DataFrame:
    """Parts whose span overlaps the window and whose name sets, where known, admit the filters."""
    out = catalog.filter((F.col("first_us") <= end_us) & (F.col("last_us") >= start_us))
    for column, value in (("databases", database), ("tables", table)):
        if value:
            out = out.filter(F.col(column).isNull() | _any_has(column, value))
    if operations:
        out = out.filter(F.col("operations").isNull() | F.arrays_overlap("operations", F.array(*[F.lit(o.upper()) for o in operations])))
    return out


def resolve_names(df: DataFrame, instance: str | None = None, database: str | None = None, table: str | None = None, limit: int = 64) -> DataFrame | None:
    """Exact (instance, database, table) triples that fuzzy names mean, busiest first; None if more than ``limit``."""
    found = by_dimensions(df, instance=instance, database=database, table=table)
    names = found.groupBy("instance_id", "database_name", "table_name").agg(F.count(F.lit(1)).alias("rows"))
    names = names.orderBy(F.desc("rows"), "instance_id", "database_name", "table_name").limit(limit + 1)
    return None if names.count() > limit else names


def mark_partial(df: DataFrame, start_us: int, end_us: int, width_us: int, column: str = "ts") -> DataFrame:
    """Flag buckets that the window cuts."""
    return df.withColumn("partial", (F.col(column) < start_us) | (F.col(column) + width_us > end_us + 1))
