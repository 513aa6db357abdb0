"""Document-store workload: parsed slow records, publishable windows, current against baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket, client_host
from ..functions.udf import mongo_normalize
from .attribution import with_baseline
from .counters import pressure_runs

WINDOW_US = 300_000_000


def mongo_events(raw: DataFrame, instance: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Slow records with shape, group and costs; what cannot be parsed, or has no time or duration, stays with its error.

    ``prefixes`` are the names of sharded collections. The record's own columns (``QueryTimes`` in ms, and where present
    ``DocsExamined, KeysExamined, ReturnRowCounts, DBName, TableName``) go before what its text says.
    """
    start = F.unix_micros(F.try_to_timestamp(F.col("ExecutionStartTime")))
    names = {c: c for c in ("DBName", "TableName", "QueryTimes", "DocsExamined", "KeysExamined", "ReturnRowCounts") if c in raw.columns}
    out = raw.select("*", mongo_normalize("SQLText", names.get("DBName"), names.get("TableName"), prefixes).alias("m"), start.alias("start_us"))
    own = F.sha2(F.concat_ws("\x1f", F.lit(instance), F.col("start_us").cast("string"), "SQLText"), 256)

    def first(column: str, cost: str, factor: int = 1) -> Column:
        told = [F.col(column).cast("bigint") * factor] if column in names else []
        return F.coalesce(*told, F.col(f"m.{cost}"))

    took = first("QueryTimes", "duration_us", 1000)
    error = F.coalesce(F.col("m.error"), F.when(F.col("start_us").isNull(), "no start time"), F.when(took.isNull(), "duration_missing"))
    costs = [took.alias("duration_us"), first("DocsExamined", "docs").alias("docs"), first("KeysExamined", "keys").alias("keys"), first("ReturnRowCounts", "returned").alias("returned")]
    flat = [F.col(f"m.{c}") for c in ("database", "collection", "op", "profile", "group_id", "cpu_ns", "bytes_read", "read_us", "planning_us", "write_wait_us", "modified", "role", "collscan", "spill")]
    return out.select(F.substring(own, 1, 40).alias("event_id"), F.lit(instance).alias("instance_id"), "start_us", error.alias("error"), *costs, *flat, client_host(F.coalesce("HostAddress", F.lit(""))).alias("client"), F.coalesce("AccountName", F.lit("")).alias("account"), F.col("SQLText").alias("raw")).dropDuplicates(["event_id"])


def publishable_windows(events: DataFrame, width_us: int = WINDOW_US) -> DataFrame:
    """Source windows all of whose records parse, with a revision that follows from the set of records, not their order."""
    at = bucket(F.col("start_us"), width_us)
    h = F.xxhash64("event_id")
    parts = [F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")]
    per = events.groupBy(at.alias("window_us")).agg(F.count_if(F.col("error").isNotNull()).alias("bad"), F.count(F.lit(1)).alias("records"), F.sha2(F.concat_ws(",", *parts), 256).alias("revision"))
    return per.filter("bad = 0 AND window_us IS NOT NULL").drop("bad")


def window_ledger(events: DataFrame, start_us: int, end_us: int, capacity: int, width_us: int = WINDOW_US) -> DataFrame:
    """Every source window of a span, newest first: published, skipped (more records than ``capacity``), unreadable or missing."""
    spark = events.sparkSession
    slots = spark.range(start_us, end_us, width_us).select(F.col("id").alias("window_us"))
    per = events.filter(F.col("start_us").between(start_us, end_us - 1)).groupBy(bucket(F.col("start_us"), width_us).alias("window_us")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    status = F.when(F.col("records").isNull(), "missing").when(F.col("records") > capacity, "skipped").when(F.col("bad") > 0, "unreadable").otherwise("published")
    return slots.join(per, "window_us", "left").select("window_us", F.coalesce("records", F.lit(0)).alias("records"), status.alias("status")).orderBy(F.desc("window_us"))


#: Orders of the analysis by column; where the evidence of one lacks, what stands in for it.
TOTALS = {"duration_total": "duration_us", "scan_total": "docs", "cpu_total": "cpu_ns", "read_total": "bytes_read"}
GROWTHS = {"duration_growth": "duration_us_delta", "scan_growth": "docs_delta", "cpu_growth": "cpu_ns_delta", "read_growth": "bytes_read_delta"}
OTHER_ORDERS = {"count": "count", "count_growth": "count_delta", "max_latency": "max_us", "correlation": "r", "performance": "overlap_score"}
MONGO_ORDERS = TOTALS | GROWTHS | OTHER_ORDERS
INSTEAD = {"count_growth": "count", "scan_growth": "scan_total", "cpu_growth": "cpu_total", "read_growth": "read_total"}


def mongo_analyze(now: DataFrame, before: DataFrame, costs: tuple[str, ...], covered: bool = True) -> DataFrame:
    """Groups of rollups in the window against the window before.

    A cost is compared only where both windows are covered and every command of both knew it; frequency and cost per call
    part the change: delta = count change x cost per call before + count now x change per call.
    """
    keys = ["role", "group_id"]

    def sums(df: DataFrame) -> DataFrame:
        told = [f(c).alias(c) for f, c in ((F.min, "first_us"), (F.max, "incomplete")) if c in df.columns]
        return df.groupBy(*keys).agg(*told, F.sum("count").alias("count"), F.sum("overlap_us").alias("overlap_us"), F.max("max_us").alias("max_us"), *[F.sum(x).alias(x) for c in costs for x in (c, f"{c}_known")])

    old = sums(before)
    out = with_baseline(sums(now), old, keys, ["count", *costs])
    known = old.select(*keys, *[F.col(f"{c}_known").alias(f"{c}_known_before") for c in costs])
    out = out.join(known, keys, "left")
    extra = {}
    for c in costs:
        full = F.lit(covered) & (F.col(f"{c}_known") == F.col("count")) & (F.col(f"{c}_known_before") == F.col("count_before"))
        extra[f"{c}_delta"] = F.when(full, F.col(f"{c}_delta"))
        each_before = F.when(F.col("count_before") > 0, F.col(f"{c}_before") / F.col("count_before"))
        extra[f"{c}_frequency"] = F.when(full, (F.col("count") - F.col("count_before")) * each_before)
        extra[f"{c}_per_call"] = F.when(full, F.col(c) - F.col("count") * each_before)
    return out.withColumns(extra)


def effective_order(df: DataFrame, order: str, covered: bool = True, before_covered: bool = True) -> tuple[str, str]:
    """The order that the groups' evidence allows, and why it is another than asked for (empty if it is not).

    Growth needs both windows covered and one known difference; totals need one known cost; else totals, then counts stand in.
    """
    if order not in MONGO_ORDERS:
        raise ValueError(f"unknown order {order!r}")
    reason = ""
    if not (covered and before_covered) and (order in GROWTHS or order in ("count_growth", "performance")):
        order, reason = INSTEAD.get(order, "duration_total"), "incomplete_baseline" if covered else "incomplete_source"
    used = [c for c in {*TOTALS.values(), *GROWTHS.values(), "overlap_score"} if c in df.columns]
    known = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in used]).first().asDict()
    if known["_all"]:
        if (order in GROWTHS or order == "performance") and not known.get(MONGO_ORDERS[order]):
            order, reason = INSTEAD.get(order, "duration_total"), "ranking_evidence_unavailable"
        if order in TOTALS and not known.get(TOTALS[order]):
            order, reason = "count", "ranking_field_unavailable"
    return order, reason


def order_mongo(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The first ``n`` groups, largest first; what is not known counts as -1 (a correlation as -2)."""
    unknown = -2 if order == "correlation" else -1
    return df.orderBy(F.desc(F.coalesce(F.col(MONGO_ORDERS[order]), F.lit(unknown))), "role", "group_id").limit(n)


def role_totals(now: DataFrame) -> DataFrame:
    return now.groupBy("role").agg(F.sum("count").alias("count"), F.sum("overlap_us").alias("overlap_us"))


def longest(events: DataFrame, n: int = 3) -> DataFrame:
    return events.filter("error IS NULL").orderBy(F.desc_nulls_last("duration_us"), "event_id").limit(n)


def raw_sources(events: DataFrame, group_id: str) -> DataFrame:
    """Clients and accounts of one group, counted again from the records."""
    return events.filter(F.col("group_id") == group_id).groupBy("client", "account").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "client", "account")


def pressure_evidence(points: DataFrame, period_us: int) -> DataFrame:
    """Ticket saturation per node with peak and coverage, and whether eviction under a growing cache came first.

    ``points``: ``role, node_id, epoch, period, end_us, metric, value`` with metrics tickets_available, tickets_queued,
    eviction, cache_update.
    """
    frames = points.groupBy("role", "node_id", "end_us").pivot("metric", ["tickets_available", "tickets_queued", "eviction", "cache_update"]).agg(F.max("value"))
    runs = pressure_runs(frames.select("role", "node_id", "end_us", F.col("tickets_available").alias("available"), F.col("tickets_queued").alias("queued")), period_us)
    first = runs.groupBy("role", "node_id").agg(F.min("first_us").alias("saturated_us"), F.max("peak").alias("peak_queue"))
    evict = frames.filter("eviction > 0").groupBy("role", "node_id").agg(F.min("end_us").alias("evicted_us"))
    cache = frames.groupBy("role", "node_id").agg(F.min_by("cache_update", "end_us").alias("_a"), F.max_by("cache_update", "end_us").alias("_b"), F.count("tickets_available").alias("observed"))
    out = cache.join(first, ["role", "node_id"], "left").join(evict, ["role", "node_id"], "left")
    status = F.when(F.col("saturated_us").isNull(), "not_saturated").when((F.col("evicted_us") <= F.col("saturated_us")) & (F.col("_b") > F.col("_a")), "eviction_then_saturation").otherwise("saturation")
    return out.select("role", "node_id", status.alias("status"), "saturated_us", "peak_queue", "evicted_us", "observed")
