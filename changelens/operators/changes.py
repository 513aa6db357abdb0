"""Analytics on row-change events: statements, transactions, hot rows and tables, DDL windows, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import BUCKET_US, bucket, fingerprint, sql_action, sql_template, statement_profile
from ..functions.series import trend_width
from ..functions.storage import scratch_folder, stored
from ..functions.udf import changed_columns
from .filters import primary_keys

ROW_OPERATIONS = ("INSERT", "UPDATE", "DELETE")
ORDERS = ("executions", "events", "row_events", "payload_bytes", "exec_time_ms", "recent", "scan_rows")


def derive_event_columns(df: DataFrame, width_us: int = BUCKET_US) -> DataFrame:
    """Bucket, transaction key, payload size, and whether the event is DDL or a row change."""
    txn = (
        F.when(F.col("gtid") != "", F.concat(F.lit("g:"), F.col("gtid")))
        .when(F.col("xid") != "", F.concat(F.lit("x:"), F.col("xid"), F.lit(":"), F.col("server_id").cast("string")))
        .when(F.col("transaction_id") != "", F.concat(F.lit("t:"), F.col("transaction_id")))
        .otherwise("")
    )
    ddl = (F.upper("sql_kind") == "ORIGINAL") & F.col("sql_text").rlike(r"(?i)^\s*(CREATE|ALTER|DROP|RENAME|TRUNCATE)[ \t(]")
    return df.withColumns(
        {
            "bucket_us": bucket(F.col("event_epoch_us"), width_us),
            "txn_key": txn,
            "payload_bytes": sum((F.octet_length(c) for c in ("before_json", "after_json", "row_query")), F.octet_length("sql_text")).cast("bigint"),
            "is_ddl": ddl,
            "row_event": F.col("operation").isin(*ROW_OPERATIONS),
        }
    )


_TEXT = ["sql_kind", "sql_text", "row_query"]


def statement_stats(ev: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Statistics per bucket, database, table, operation and fingerprint. An execution is a distinct start position of a text.

    Events are counted by a digest of their texts; the texts themselves are gathered once each, and normalised there. With
    ``max_groups``, input of more distinct texts than that is described by templates (``level`` says which it was): table
    names without shard numbers, inserts without their columns' values.
    """
    keys = ["bucket_us", "database_name", "table_name", "operation"]
    text_key = F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in _TEXT]))).alias("text_key")
    counts = ev.select(*keys, text_key, "start_position", "row_event", "payload_bytes", "execution_time_ms", "event_epoch_us", "event_id").groupBy(*keys, "text_key").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("start_position").alias("executions"),
        F.count_if("row_event").alias("row_events"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.sum("execution_time_ms").alias("exec_time_ms"),
        F.max("execution_time_ms").alias("exec_max_ms"),
        F.count_if(F.col("execution_time_ms") > 0).alias("slow"),
        F.min("event_epoch_us").alias("first_us"),
        F.max("event_epoch_us").alias("last_us"),
        F.min("event_id").alias("min_event_id"),
    )
    place = ["database_name", "table_name", "operation", "text_key"]
    texts = ev.select(*place[:3], text_key, *_TEXT).groupBy(*place).agg(F.min(F.struct(*_TEXT)).alias("t")).select(*place, "t.*")
    level = "statement"
    if max_groups is not None and texts.select("text_key").distinct().count() > max_groups:
        level = "template"
    profiled = texts.withColumn("p", statement_profile()).select(*place, "p.source", "p.action", "p.normalized", "p.fingerprint")
    if level == "template":
        profiled = profiled.withColumn("normalized", sql_template(F.col("normalized"))).withColumn("fingerprint", fingerprint(F.col("source"), F.col("normalized")))
    sums = ("events", "executions", "row_events", "payload_bytes", "exec_time_ms", "slow")
    out = counts.join(profiled, place).groupBy(*keys, "fingerprint").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("exec_max_ms").alias("exec_max_ms"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("min_event_id").alias("min_event_id"),
        F.min("source").alias("source"),
        F.min("action").alias("action"),
        F.min("normalized").alias("normalized"),
    )
    return out.withColumn("level", F.lit(level))


def statement_dim(stats: DataFrame) -> DataFrame:
    return stats.groupBy("fingerprint").agg(F.min("source").alias("source"), F.min("action").alias("action"), F.min("normalized").alias("normalized"), F.min("first_us").alias("first_seen_us"), F.max("last_us").alias("last_seen_us"))


def in_overlap(stats: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Aggregate rows that the window touches; edge buckets may bring events from outside."""
    return stats.filter((F.col("last_us") >= start_us) & (F.col("first_us") <= end_us))


def by_statement(stats: DataFrame, explain: DataFrame | None = None) -> DataFrame:
    """One row per fingerprint, boundary statements left out; with estimates, rows scanned = executions x estimate."""
    sums = ("events", "executions", "row_events", "payload_bytes", "exec_time_ms", "slow")
    out = stats.filter("source <> 'boundary'").groupBy("fingerprint").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("exec_max_ms").alias("exec_max_ms"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("action").alias("action"),
        F.min("normalized").alias("normalized"),
        F.count_distinct(F.struct("database_name", "table_name")).alias("objects"),
    )
    if explain is None:
        return out.withColumn("est_rows", F.lit(None).cast("bigint")).withColumn("scan_rows", F.lit(None).cast("bigint"))
    known = explain.filter("status = 'ok'").select("fingerprint", "est_rows")
    return out.join(known, "fingerprint", "left").withColumn("scan_rows", F.col("executions") * F.col("est_rows"))


def top_statements(groups: DataFrame, n: int = 20, orders: tuple[str, ...] = ORDERS) -> DataFrame:
    """The first ``n`` under any of the orders, with the rank under each; ties by fingerprint."""
    column = {"recent": "last_us"}
    out, tests = groups, []
    for o in orders:
        if o not in ORDERS:
            raise ValueError(f"unknown order {o!r}")
        # the input is one row per statement: each order keeps n rows before any is ranked
        best = groups.select("fingerprint", F.col(column.get(o, o)).alias("_v")).orderBy(F.desc_nulls_last("_v"), "fingerprint").limit(n)
        ranked = best.select("fingerprint", F.row_number().over(Window.orderBy(F.desc_nulls_last("_v"), "fingerprint")).alias(f"r_{o}"))
        out = out.join(F.broadcast(ranked), "fingerprint", "left")
        tests.append(F.col(f"r_{o}").isNotNull())
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return out.filter(test)


def sql_summary(stats: DataFrame, start_us: int, end_us: int, order: str = "executions", n: int = 20, explain: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections of the statement page as DataFrames: totals, statements, objects, operations, trend."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    rows = in_overlap(stats, start_us, end_us)
    own = rows.filter("source <> 'boundary'")
    width = trend_width(start_us, end_us)
    sums = [F.sum(c).alias(c) for c in ("events", "executions", "row_events", "payload_bytes", "exec_time_ms")]
    totals = rows.agg(*[F.sum(F.when(F.col("source") != "boundary", F.col(c))).alias(c) for c in ("events", "executions", "row_events", "payload_bytes", "exec_time_ms")], F.count_distinct(F.when(F.col("source") != "boundary", F.col("fingerprint"))).alias("statements"), F.coalesce(F.sum(F.when(F.col("source") == "boundary", F.col("events"))), F.lit(0)).alias("boundary_events"))
    groups = by_statement(rows, explain)
    column = {"recent": "last_us"}.get(order, order)
    return {
        "totals": totals,
        "statements": groups.orderBy(F.desc_nulls_last(column), "fingerprint").limit(n),
        "objects": own.groupBy("database_name", "table_name").agg(*sums, F.count_distinct("fingerprint").alias("statements")).orderBy(F.desc("events"), "database_name", "table_name").limit(n),
        "operations": own.groupBy("operation").agg(*sums),
        "trend": own.groupBy(bucket(F.col("bucket_us"), width).alias("bucket_us")).agg(*sums),
    }


def agg_5m(ev: DataFrame) -> DataFrame:
    """Mergeable aggregates of the row store: an execution is a row with index 1, and only it carries times."""
    first = F.col("row_index") == 1
    return ev.groupBy("bucket_us", "database_name", "table_name", "operation").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(first).alias("executions"),
        F.count_if("row_event").alias("row_events"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.sum(F.when(first, F.col("execution_time_ms")).otherwise(0)).alias("exec_time_ms"),
        F.count_if(first & (F.col("execution_time_ms") > 0)).alias("slow"),
        F.min("event_epoch_us").alias("first_us"),
        F.max("event_epoch_us").alias("last_us"),
    )


def agg_txn_5m(ev: DataFrame) -> DataFrame:
    """Exact distinct transactions per bucket for each table, and for all tables as ``*``."""
    known = F.when(F.col("transaction_id") != "", F.col("transaction_id"))
    by_table = ev.groupBy("bucket_us", "database_name", "table_name").agg(F.count_distinct(known).alias("transactions"))
    whole = ev.groupBy("bucket_us").agg(F.count_distinct(known).alias("transactions"))
    return by_table.unionByName(whole.select("bucket_us", F.lit("*").alias("database_name"), F.lit("*").alias("table_name"), "transactions"))


def transactions(ev: DataFrame) -> DataFrame:
    """One row per transaction, folded over the whole input: times, duration, dependency depth, sizes, tables."""
    table = F.when(F.col("table_name") != "", F.concat_ws(".", "database_name", "table_name"))
    out = ev.filter("txn_key <> ''").groupBy("txn_key").agg(
        F.min("event_epoch_us").alias("start_us"),
        F.max("event_epoch_us").alias("end_us"),
        F.max("commit_epoch_us").alias("commit_us"),
        F.min(F.when(F.col("header_epoch_us") > 0, F.col("header_epoch_us"))).alias("header_us"),
        F.max("txn_sequence_number").alias("sequence"),
        F.max("txn_last_committed").alias("last_committed"),
        F.count_if("row_event").alias("row_events"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.count_distinct(F.when(F.col("row_event"), table)).alias("table_count"),
        F.min(table).alias("first_table"),
        *[F.count_if(F.col("operation") == o).alias(f"{o.lower()}s") for o in ROW_OPERATIONS],
        F.count_if("is_ddl").alias("ddl_count"),
    )
    took = F.col("commit_us") - F.col("header_us")
    return out.withColumn("duration_us", F.when(took >= 1_000_000, took).otherwise(0)).withColumn("depth", F.when(F.col("sequence") > 0, F.col("sequence") - F.col("last_committed")).otherwise(0))


SIZE_BOUNDS = (1, 10, 100, 1000)
DURATION_BOUNDS = (0, 1_000_000, 5_000_000, 30_000_000)


def histogram(value: Column, bounds: tuple[int, ...], name: str) -> list[Column]:
    """Counts up to each bound and beyond the last: ``name_0`` to ``name_<n>``."""
    out, low = [], None
    for k, high in enumerate(bounds):
        test = value <= high if low is None else (value > low) & (value <= high)
        out.append(F.count_if(test).alias(f"{name}_{k}"))
        low = high
    return [*out, F.count_if(value > bounds[-1]).alias(f"{name}_{len(bounds)}")]


def _txn_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("transactions"),
        F.sum("row_events").alias("row_events"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.max("row_events").alias("largest"),
        F.max("duration_us").alias("longest_us"),
        F.sum("depth").alias("depth_sum"),
        F.count_if(F.col("depth") > 0).alias("depth_known"),
        F.sum("duration_us").alias("duration_sum"),
        F.count_if(F.col("duration_us") > 0).alias("duration_known"),
        F.count_if(F.col("table_count") > 1).alias("multi_table"),
        *histogram(F.col("row_events"), SIZE_BOUNDS, "size"),
        *histogram(F.col("duration_us"), DURATION_BOUNDS, "took"),
    ]


def txn_buckets(txn: DataFrame, width_us: int = BUCKET_US) -> DataFrame:
    return txn.groupBy(bucket(F.col("end_us"), width_us).alias("bucket_us")).agg(*_txn_sums())


def txn_summary(txn: DataFrame, start_us: int, end_us: int) -> dict[str, DataFrame]:
    """Totals with averages (depth to one decimal, duration whole) and the trend."""
    rows = txn.filter(F.col("end_us").between(start_us, end_us))
    totals = rows.agg(*_txn_sums())
    averages = {
        "depth_avg": F.when(F.col("depth_known") > 0, F.bround(F.col("depth_sum") / F.col("depth_known"), 1)),
        "duration_avg_us": F.when(F.col("duration_known") > 0, F.floor(F.col("duration_sum") / F.col("duration_known"))),
    }
    return {"totals": totals.withColumns(averages), "trend": txn_buckets(rows, trend_width(start_us, end_us))}


def top_transactions(txn: DataFrame, order: str = "longest", n: int = 20) -> DataFrame:
    orders = {
        "longest": (F.lit(True), [F.desc("duration_us"), F.desc("row_events")]),
        "largest": (F.lit(True), [F.desc("row_events"), F.desc("duration_us")]),
        "ddl": (F.col("ddl_count") > 0, [F.desc("start_us")]),
        "multi_table": (F.col("table_count") > 1, [F.desc("table_count"), F.desc("row_events")]),
    }
    if order not in orders:
        raise ValueError(f"unknown order {order!r}")
    test, by = orders[order]
    return txn.filter(test).orderBy(*by, "txn_key").limit(n)


def with_row_keys(ev: DataFrame) -> DataFrame:
    """UPDATE and DELETE rows with the key of the changed row, from the image before, else after."""
    keys = primary_keys(F.col("columns_json"))
    image = F.from_json(F.when(F.col("before_json") != "", F.col("before_json")).otherwise(F.col("after_json")), "map<string,string>")
    joined = F.array_join(F.transform("_pk", lambda k: F.coalesce(F.col("_image")[k["name"]], F.lit("\x00"))), "\x1f")
    rows = ev.filter(F.col("operation").isin("UPDATE", "DELETE") & ((F.col("before_json") != "") | (F.col("after_json") != "")))
    return rows.withColumns({"_pk": keys, "_image": image}).filter("size(_pk) > 0").withColumn("row_key", joined).drop("_pk", "_image")


def row_hotspots(keyed: DataFrame, n: int = 20) -> DataFrame:
    """Rows that more than one transaction touched within a bucket; buckets are summed.

    ``keyed``: change events with ``bucket_us, txn_key, row_key``.
    """
    per = keyed.groupBy("bucket_us", "database_name", "table_name", "row_key").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.when(F.col("txn_key") != "", F.col("txn_key"))).alias("transactions"))
    hot = per.filter("transactions > 1")
    out = hot.groupBy("database_name", "table_name", "row_key").agg(F.sum("transactions").alias("transactions"), F.sum("events").alias("events"), F.count(F.lit(1)).alias("buckets"))
    return out.orderBy(F.desc("transactions"), F.desc("events"), "database_name", "table_name", "row_key").limit(n)


def table_hotspots(ev: DataFrame, n: int = 20) -> DataFrame:
    """Row events and transactions per table; a transaction in two buckets counts in both."""
    rows = ev.filter("row_event AND table_name <> ''")
    per = rows.groupBy("bucket_us", "database_name", "table_name").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.when(F.col("txn_key") != "", F.col("txn_key"))).alias("transactions"))
    out = per.groupBy("database_name", "table_name").agg(F.sum("transactions").alias("transactions"), F.sum("events").alias("events"))
    return out.orderBy(F.desc("events"), F.desc("transactions"), "database_name", "table_name").limit(n)


def hotspot_mode(rows: DataFrame, tables: DataFrame) -> str:
    """primary-key, mixed, table-only or empty, from what hot rows and tables there are."""
    keyed = rows.select("database_name", "table_name").distinct()
    if tables.isEmpty():
        return "empty"
    if keyed.isEmpty():
        return "table-only"
    return "primary-key" if tables.join(keyed, ["database_name", "table_name"], "left_anti").isEmpty() else "mixed"


def ddl_events(ev: DataFrame) -> DataFrame:
    return ev.filter("is_ddl").select("event_id", "event_epoch_us", "instance_id", "database_name", "table_name", F.substring("sql_text", 1, 2048).alias("sql_text"), sql_action(F.col("sql_text")).alias("action"))


def ddl_windows(ddl: DataFrame, stats: DataFrame, radius_us: int = BUCKET_US, width_us: int = BUCKET_US) -> DataFrame:
    """Each DDL with the events of same-table DML buckets within ``radius_us`` of it; null where it names no table.

    The window is cut into buckets, so that the range join is an equi join.
    """
    dml = stats.filter(F.col("operation").isin(*ROW_OPERATIONS)).groupBy("database_name", "table_name", "bucket_us").agg(F.sum("events").alias("events"), F.sum("row_events").alias("row_events"))
    first, last = bucket(F.col("event_epoch_us") - radius_us, width_us), bucket(F.col("event_epoch_us") + radius_us, width_us)
    spread = ddl.filter("table_name <> ''").select("event_id", "database_name", "table_name", F.explode(F.sequence(first, last, F.lit(width_us).cast("bigint"))).alias("bucket_us"))
    found = spread.join(dml, ["database_name", "table_name", "bucket_us"]).groupBy("event_id").agg(F.sum("events").alias("dml_events"), F.sum("row_events").alias("dml_rows"))
    named = F.col("table_name") != ""
    return ddl.join(found, "event_id", "left").withColumns({c: F.when(named, F.coalesce(c, F.lit(0))) for c in ("dml_events", "dml_rows")})


def lock_summary(ev: DataFrame, stats: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """Hot tables, DDL with its concurrent DML, and the largest values as the risk block."""
    ddl = ddl_windows(ddl_events(ev), stats)
    tables = table_hotspots(ev, n)
    risk = tables.agg(F.max("transactions").alias("max_transactions"), F.max("events").alias("max_events")).crossJoin(ddl.agg(F.count(F.lit(1)).alias("ddl"), F.max("dml_events").alias("max_dml_events")))
    return {"tables": tables, "ddl": ddl.orderBy(F.desc("event_epoch_us"), "event_id").limit(n), "risk": risk}


def rollup(stats: DataFrame, width_us: int) -> DataFrame:
    """Statement statistics by hour or day: whole buckets recomputed, so a repeat gives the same rows."""
    sums = ("events", "executions", "row_events", "payload_bytes", "exec_time_ms", "slow")
    return stats.groupBy(bucket(F.col("bucket_us"), width_us).alias("bucket_us"), "database_name", "table_name", "operation", "fingerprint").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.max("exec_max_ms").alias("exec_max_ms"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max(F.col("source") == "boundary").alias("boundary"),
        F.min("normalized").alias("normalized"),
    )


def transaction_rollup(buckets: DataFrame, width_us: int) -> DataFrame:
    """``txn_buckets`` by wider buckets: sums of sums, maxima of maxima."""
    most = ("largest", "longest_us")
    rest = [c for c in buckets.columns if c not in ("bucket_us", *most)]
    return buckets.groupBy(bucket(F.col("bucket_us"), width_us).alias("bucket_us")).agg(*[F.sum(c).alias(c) for c in rest], *[F.max(c).alias(c) for c in most])


def hotspot_rollup(ev: DataFrame, width_us: int) -> DataFrame:
    """Row events and transactions per table and wide bucket; a transaction counts in each narrow bucket that it touches."""
    per = ev.filter("row_event AND table_name <> ''").groupBy("bucket_us", "database_name", "table_name").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.when(F.col("txn_key") != "", F.col("txn_key"))).alias("transactions"))
    return per.groupBy(bucket(F.col("bucket_us"), width_us).alias("bucket_us"), "database_name", "table_name").agg(F.sum("events").alias("events"), F.sum("transactions").alias("transactions"))


def ddl_rollup(windows: DataFrame, width_us: int) -> DataFrame:
    """DDL events by wide bucket and table, with the DML beside them (``ddl_windows``)."""
    at = bucket(F.col("event_epoch_us"), width_us).alias("bucket_us")
    return windows.groupBy(at, "database_name", "table_name").agg(F.count(F.lit(1)).alias("ddl"), F.sum("dml_events").alias("dml_events"), F.max("dml_events").alias("dml_most"))


def top_each_bucket(df: DataFrame, orders: list[str], key: str, n: int = 50) -> DataFrame:
    """The union of each bucket's first ``n`` rows under each of the orders, once each; ties by ``key``."""
    ranks = {f"_r{k}": F.row_number().over(Window.partitionBy("bucket_us").orderBy(F.desc_nulls_last(o), key)) for k, o in enumerate(orders)}
    return df.withColumns(ranks).filter(" OR ".join(f"{r} <= {n}" for r in ranks)).drop(*ranks)


def notable_transactions(txn: DataFrame, start_us: int, end_us: int, n: int = 20) -> DataFrame:
    """The union of top lists, each transaction once: first ``n`` by rows and by duration, all with DDL, all of several
    tables, and all that reach beyond the window."""
    out = txn
    for k, order in enumerate(("largest", "longest")):
        best = top_transactions(txn, order, n).select("txn_key", F.lit(True).alias(f"_top{k}"))
        out = out.join(F.broadcast(best), "txn_key", "left")
    own = (F.col("ddl_count") > 0) | (F.col("table_count") > 1) | (F.col("start_us") < start_us) | (F.col("end_us") > end_us)
    return out.filter(own | F.col("_top0").isNotNull() | F.col("_top1").isNotNull()).drop("_top0", "_top1")


def scope_parts(parts: DataFrame, scope: DataFrame) -> DataFrame:
    """Aggregates of the parts that are in scope: ``scope`` names instance and part, and says which revision is current."""
    return parts.join(scope.select("instance_id", "part_id", "revision").distinct(), ["instance_id", "part_id", "revision"], "left_semi")


def write_hotspots(agg: DataFrame, start_us: int, end_us: int, n: int = 5) -> DataFrame:
    """Tables most written in the window, with their events in the equal window before (null if none there)."""
    low = start_us - (end_us - start_us)

    def window(a: int, b: int, name: str) -> DataFrame:
        rows = agg.filter((F.col("bucket_us") >= a) & (F.col("bucket_us") < b) & (F.col("table_name") != "*"))
        return rows.groupBy("database_name", "table_name").agg(F.sum("row_events").alias(name))

    now = window(start_us, end_us, "row_events").orderBy(F.desc("row_events"), "database_name", "table_name").limit(n)
    return now.join(window(low, start_us, "row_events_before"), ["database_name", "table_name"], "left")


def last_effective_change(events: DataFrame, keys: list[str], order: list[str], columns: list[str] | Column | None = None) -> DataFrame:
    """The last real change of each row whose key does not move.

    ``events``: ``before, after`` as canonical JSON text (null where there is no row), ``order`` columns in source order,
    and optionally ``operation``. Row chains are checked: each image before must equal the image after of the row's previous
    event, else the whole ``cohort`` (all keys but the row's) is rejected. So it is where a key is written after its delete,
    two events of a row have one place in the order, an event has no image, or ``operation`` does not fit the images.
    A->B->C keeps the last change that changed anything; A->B->A keeps nothing.

    ``columns``: the columns of the table, as a list or an array column. With them an image that is no JSON object of just
    these rejects the cohort, and changes carry their operation: UPDATE has only the columns that changed, INSERT its
    image, DELETE none. Without them images are taken as they are, whole or not.
    """
    w = Window.partitionBy(*keys, "row_key").orderBy(*order)
    place = F.struct(*order)
    shape = F.when(F.col("before").isNull(), F.when(F.col("after").isNotNull(), "INSERT")).when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    chained = events.withColumns({"_previous": F.lag("after").over(w), "_place": F.lag(place).over(w), "_nth": F.row_number().over(w), "_shape": shape})
    broken = (F.col("_nth") > 1) & (F.col("_previous").isNull() | ~F.col("before").eqNullSafe(F.col("_previous")) | place.eqNullSafe(F.col("_place")))
    broken |= F.col("_shape").isNull()
    if "operation" in events.columns:
        broken |= ~F.col("operation").eqNullSafe(F.col("_shape"))
    if columns is not None:
        broken |= _partial(columns)
    marked = chained.withColumn("_broken", broken)
    bad = marked.groupBy(*keys).agg(F.max("_broken").alias("rejected"))
    folded = marked.groupBy(*keys, "row_key").agg(
        F.min_by("before", place).alias("first"),
        F.max_by("after", place).alias("last"),
        F.max_by(F.struct("before", "after", *order, "_shape"), F.when(~F.col("before").eqNullSafe(F.col("after")), place)).alias("change"),
    )
    kept = folded.filter(~F.col("first").eqNullSafe(F.col("last")) & F.col("change").isNotNull())
    found = kept.join(bad, keys, "left").filter("NOT rejected").select(*keys, "row_key", "change.*")
    if columns is None:
        return found.drop("_shape")
    return _cut_to_changes(found).select(*keys, "row_key", F.col("_shape").alias("operation"), "before", "after", *order)


def _partial(columns: list[str] | Column) -> Column:
    """Whether an image that is there is no JSON object of just these columns."""
    wanted = F.array_sort(columns if isinstance(columns, Column) else F.array(*map(F.lit, columns)))
    partial = [F.col(image).isNotNull() & ~F.coalesce(F.array_sort(F.json_object_keys(image)) == wanted, F.lit(False)) for image in ("before", "after")]
    return partial[0] | partial[1]


def _cut_to_changes(found: DataFrame) -> DataFrame:
    """Images by the ``_shape`` of the change: of an UPDATE the columns that changed, of an INSERT its image, of a DELETE none."""
    changed = found.withColumn("_changed", changed_columns("before", "after"))
    update = F.col("_shape") == "UPDATE"
    return changed.withColumns({"before": F.when(update, F.col("_changed.before")), "after": F.when(update, F.col("_changed.after")).otherwise(F.col("after"))}).drop("_changed")


def moving_row_changes(events: DataFrame, keys: list[str], order: str, columns: list[str] | Column | None = None) -> DataFrame:
    """The last real change of each row, also where its key moves: ``first_key, last_key, before, after`` and ``order``.

    ``events``: cohort ``keys``, ``before_key, after_key`` (null where there is no row), ``before, after`` as canonical JSON
    text, and an ``order`` column that places each event. A key's events are cut into segments at each arrival (an insert, or a
    move to the key); a move links the segment that it leaves to the one that it begins, and the links are followed by
    doubling, so that a chain of n moves takes log n rounds. A cohort is rejected whole if an image before is not the image
    after of the row's previous event, or if an event touches a key with no row on it. A row that ends as it began (deleted
    where it was inserted, or changed back) has no change.

    ``columns`` as in ``last_effective_change``: an image of other columns rejects the cohort, and changes carry their ``operation`` and, if they
    are updates, changed columns only (none if just the key moved).
    """
    moves = ~F.col("before_key").eqNullSafe(F.col("after_key"))
    leave = F.struct(F.col("before_key").alias("key"), F.lit(False).alias("arrives"))
    arrive = F.struct(F.col("after_key").alias("key"), F.lit(True).alias("arrives"))
    touch = F.when(~moves, F.array(leave)).when(F.col("after_key").isNull(), F.array(leave)).when(F.col("before_key").isNull(), F.array(arrive)).otherwise(F.array(leave, arrive))
    touches = events.withColumn("_t", F.explode(touch)).select("*", "_t.key", "_t.arrives").drop("_t")
    w = Window.partitionBy(*keys, "key").orderBy(order, "arrives")
    previous = F.lag(F.struct(F.when(F.col("arrives") | ~moves, F.col("after")).alias("after"), (moves & ~F.col("arrives")).alias("gone"))).over(w)
    seen = touches.withColumns({"_segment": F.sum(F.col("arrives").cast("int")).over(w), "_previous": previous, "_moves": moves})
    opens, gone = F.col("_previous").isNull(), F.col("_previous.gone")
    broken = F.when(F.col("arrives"), ~opens & ~gone).otherwise(~opens & (gone | ~F.col("before").eqNullSafe(F.col("_previous.after"))))
    if columns is not None:
        broken |= _partial(columns)
    folder = scratch_folder(events.sparkSession)
    seen = stored(seen.withColumn("_broken", F.coalesce(broken, F.lit(False))).drop("_previous"), folder, "touches")
    place = F.struct("key", "_segment")
    out_of = seen.filter("_moves AND NOT arrives").select(*keys, F.col(order).alias("_at"), place.alias("parent"))
    into = seen.filter("_moves AND arrives AND before_key IS NOT NULL").select(*keys, F.col(order).alias("_at"), place.alias("child"))
    links, rounds = stored(into.join(out_of, [*keys, "_at"]).select(*keys, "child", "parent"), folder, "links0"), 0
    while True:
        up = links.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("_further"))
        doubled = links.join(up, [*keys, "parent"], "left").select(*keys, "child", F.coalesce("_further", "parent").alias("parent"), F.col("_further").isNotNull().alias("_more"))
        rounds += 1
        doubled = stored(doubled, folder, f"links{rounds}")
        links = doubled.drop("_more")
        if doubled.filter("_more").isEmpty():
            break
    rooted = seen.withColumn("child", place).join(links, [*keys, "child"], "left").withColumn("root", F.coalesce("parent", "child"))
    bad = seen.groupBy(*keys).agg(F.max("_broken").alias("rejected"))
    own = F.col("arrives") | ~F.col("_moves") | F.col("after_key").isNull()  # each event once
    change = F.when(~F.col("before").eqNullSafe(F.col("after")) | F.col("_moves"), F.col(order))
    folded = rooted.filter(own).groupBy(*keys, "root").agg(
        F.min_by(F.struct("before_key", "before"), order).alias("first"),
        F.max_by(F.struct("after_key", "after"), order).alias("last"),
        F.max_by(F.struct("before", "after", F.col(order)), change).alias("change"),
    )
    same = F.col("first.before_key").eqNullSafe(F.col("last.after_key")) & F.col("first.before").eqNullSafe(F.col("last.after"))
    kept = folded.filter(~same & F.col("change").isNotNull()).join(bad, keys).filter("NOT rejected")
    found = kept.select(*keys, F.col("first.before_key").alias("first_key"), F.col("last.after_key").alias("last_key"), "change.*")
    if columns is None:
        return found
    shape = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    return _cut_to_changes(found.withColumn("_shape", shape)).withColumnRenamed("_shape", "operation")
