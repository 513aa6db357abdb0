"""Counter analytics: deltas between snapshots, windows, rankings, unit costs, rollups, gauges, pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket
from ..functions.scans import highest_total, scan
from ..functions.series import islands, pearson, sums_for_pearson
from .attribution import with_baseline

MINUTE_US = 60_000_000
LEAST_POINTS = 6


def counter_deltas(snapshots: DataFrame, fields: tuple[str, ...] = ("calls", "usec"), expected_us: int | None = None, width_us: int = 3_600_000_000) -> DataFrame:
    """Differences between a node's consecutive snapshots, one row per command.

    ``snapshots``: ``node_id, ts_us, command`` and the counters, and where known ``epoch`` (identity of the process),
    ``role`` and ``uptime_s``. The status of the whole interval is that of its worst counter: initial, restarted,
    role_changed, invalid_time, gap, counter_reset or ok. Commands new in the later snapshot are left out. A node's snapshots are
    scanned in bins of ``width_us``.
    """
    have = set(snapshots.columns)
    own = [c for c in ("epoch", "role", "uptime_s") if c in have]
    marks = snapshots.groupBy("node_id", "ts_us").agg(F.first(F.struct(F.lit(0), *own)).alias("now"))
    marks = scan(marks, ["node_id"], ["ts_us"], width_us, before_us=(F.col("ts_us"), "previous"), before=(F.col("now"), "previous"))
    gap = F.col("ts_us") - F.col("before_us")
    status = F.when(F.col("before_us").isNull(), "initial")
    if "epoch" in have:
        status = status.when(~F.col("now.epoch").eqNullSafe(F.col("before.epoch")), "restarted")
    if "uptime_s" in have:
        status = status.when(F.col("now.uptime_s") < F.col("before.uptime_s"), "restarted").when(F.abs(F.col("now.uptime_s") - F.col("before.uptime_s") - gap / 1_000_000) > 3, "restarted")
    if "role" in have:
        status = status.when(~F.col("now.role").eqNullSafe(F.col("before.role")), "role_changed")
    status = status.when(gap <= 0, "invalid_time")
    if expected_us:
        status = status.when(gap > 2.5 * expected_us, "gap")
    marks = marks.select("node_id", "ts_us", "before_us", status.otherwise("ok").alias("status"))
    old = snapshots.select("node_id", F.col("ts_us").alias("before_us"), "command", *[F.col(c).alias(f"{c}_old") for c in fields])
    joined = snapshots.select("node_id", "ts_us", "command", *fields).join(marks, ["node_id", "ts_us"]).join(old, ["node_id", "before_us", "command"], "left")
    deltas = joined.withColumns({c: F.col(c) - F.col(f"{c}_old") for c in fields})
    negative = F.max(F.greatest(*[F.col(c) < 0 for c in fields]) if len(fields) > 1 else F.col(fields[0]) < 0).over(Window.partitionBy("node_id", "ts_us"))
    final = F.when((F.col("status") == "ok") & F.coalesce(negative, F.lit(False)), "counter_reset").otherwise(F.col("status"))
    out = deltas.withColumn("status", final).filter(F.col(f"{fields[0]}_old").isNotNull() | (F.col("status") == "initial"))
    return out.select("node_id", F.col("before_us").alias("start_us"), F.col("ts_us").alias("end_us"), "command", "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in fields])


def interval_summary(deltas: DataFrame, start_us: int, end_us: int, keys: tuple[str, ...] = ("node_id", "command")) -> DataFrame:
    """Sums over good intervals inside the window, and rates over the seconds that were observed."""
    inside = deltas.filter((F.col("status") == "ok") & (F.col("start_us") >= start_us) & (F.col("end_us") <= end_us))
    seconds = inside.select("node_id", "start_us", "end_us").distinct().groupBy("node_id").agg((F.sum(F.col("end_us") - F.col("start_us")) / 1_000_000).alias("seconds"))
    out = inside.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("usec").alias("usec"))
    return out.join(seconds, "node_id").withColumns({"qps": F.col("calls") / F.col("seconds"), "avg_us": F.when(F.col("calls") > 0, F.col("usec") / F.col("calls"))})


def counter_window(deltas: DataFrame, start_us: int, end_us: int, before: tuple[int, int] | None = None, least_cover: float = 0.95) -> DataFrame:
    """Per node and command the window's sums; differences to the window before only where both are covered."""
    low, high = before or (start_us - (end_us - start_us), start_us)
    now, old = interval_summary(deltas, start_us, end_us), interval_summary(deltas, low, high)
    old = old.select("node_id", "command", *[F.col(c).alias(f"{c}_before") for c in ("calls", "usec", "seconds")])
    out = now.join(old, ["node_id", "command"], "left")
    covered = (F.col("seconds") * 1_000_000 >= least_cover * (end_us - start_us)) & (F.col("seconds_before") * 1_000_000 >= least_cover * (high - low))
    return out.withColumns({f"{c}_delta": F.when(covered, F.col(c) - F.col(f"{c}_before")) for c in ("calls", "usec")}).withColumn("nested", F.lower("command").rlike("^(eval|evalsha|fcall|exec)"))


def minute_rates(deltas: DataFrame, low_s: int = 48, high_s: int = 72) -> DataFrame:
    """Calls and microseconds by minute, only minutes of which 48 to 72 seconds were observed."""
    good = deltas.filter("status = 'ok'")
    minute = bucket(F.col("end_us"), MINUTE_US) + MINUTE_US
    seen = good.select("node_id", "start_us", "end_us").distinct().groupBy("node_id", minute.alias("minute_us")).agg((F.sum(F.col("end_us") - F.col("start_us")) / 1_000_000).alias("seconds"))
    sums = good.groupBy("node_id", "command", minute.alias("minute_us")).agg(F.sum("calls").alias("calls"), F.sum("usec").alias("usec"))
    return sums.join(seen.filter(F.col("seconds").between(low_s, high_s)), ["node_id", "minute_us"])


def association(rates: DataFrame, metric: DataFrame) -> DataFrame:
    """How calls and time of each command follow a metric over the minutes where both were observed; the higher counts.

    Grades: high from 0.7, medium from 0.4, else low; at least 6 points.
    """
    both = rates.join(metric.select("node_id", F.col("end_us").alias("minute_us"), "value"), ["node_id", "minute_us"])

    def r(column: str) -> DataFrame:
        sums = both.groupBy("node_id", "command").agg(*sums_for_pearson(F.col(column), F.col("value")))
        return sums.select("node_id", "command", "n", pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias(f"r_{column}"))

    out = r("calls").join(r("usec").drop("n"), ["node_id", "command"])
    best = F.greatest("r_calls", "r_usec")
    known = F.col("n") >= LEAST_POINTS
    return out.withColumns({"r": F.when(known, best), "grade": F.when(~known | best.isNull(), "unknown").when(best >= 0.7, "high").when(best >= 0.4, "medium").otherwise("low")})


def unit_costs(sums: DataFrame, least_nodes: int = 3, least_calls: int = 100, least_cover: float = 0.95) -> DataFrame:
    """Cost per call against the median of all nodes that ran the command at like coverage; then a node's median index."""
    w = Window.partitionBy("command")
    usable = sums.filter(F.col("calls") >= least_calls)
    usable = usable.withColumn("_most", F.max("seconds").over(w)).filter(F.col("seconds") >= least_cover * F.col("_most"))
    counted = usable.withColumns({"avg_us": F.col("usec") / F.col("calls"), "_nodes": F.count(F.lit(1)).over(w)}).filter(F.col("_nodes") >= least_nodes)
    median = counted.groupBy("command").agg(F.expr("percentile(avg_us, 0.5)").alias("median_us"))
    out = counted.join(median, "command").withColumn("ratio", F.when(F.col("median_us") > 0, F.col("avg_us") / F.col("median_us")))
    return out.select("node_id", "command", "avg_us", "median_us", "ratio")


def node_index(costs: DataFrame) -> DataFrame:
    return costs.groupBy("node_id").agg(F.expr("percentile(ratio, 0.5)").alias("index"), F.count("ratio").alias("commands"))


def counter_rollup(deltas: DataFrame, width_us: int, offset_us: int = 0) -> DataFrame:
    """Sums with the seconds known, by the bucket of the interval's end; ``offset_us`` shifts days to a time zone."""
    good = deltas.filter("status = 'ok'")
    at = bucket(F.col("end_us") - 1 + offset_us, width_us) - offset_us
    return good.groupBy("node_id", "command", at.alias("bucket_us")).agg(F.sum("calls").alias("calls"), F.sum("usec").alias("usec"), (F.sum(F.col("end_us") - F.col("start_us")) / 1_000_000).alias("known_s"))


def gauge_rollup(points: DataFrame, width_us: int) -> DataFrame:
    return points.groupBy("node_id", "metric", bucket(F.col("ts_us"), width_us).alias("bucket_us")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", "ts_us").alias("last"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("points"))


def snapshot_changes(snapshots: DataFrame, fields: list[str], width_us: int = 86_400_000_000) -> DataFrame:
    """An event for each field whose value differs from the node's snapshot before; scanned in bins of ``width_us``."""
    long = snapshots.select("node_id", "ts_us", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("node_id", "ts_us", "x.*")
    marked = scan(long, ["node_id", "field"], ["ts_us"], width_us, before=(F.col("value"), "previous"), _seen=(F.lit(True), "previous"))
    return marked.filter(F.col("_seen") & ~F.col("value").eqNullSafe(F.col("before"))).drop("_seen")


def night_baseline(points: DataFrame, offset_us: int = 8 * 3_600_000_000) -> DataFrame:
    """Mean of each metric between 03:00 and 05:00 local time."""
    local = F.pmod(F.col("ts_us") + offset_us, F.lit(86_400_000_000))
    return points.filter((local >= 3 * 3_600_000_000) & (local < 5 * 3_600_000_000)).groupBy("node_id", "metric").agg(F.avg("value").alias("baseline"), F.count(F.lit(1)).alias("points"))


def against_night(points: DataFrame, offset_us: int = 8 * 3_600_000_000) -> DataFrame:
    """Each metric's day mean per node against the mean of the same night's quiet hours; unknown where there was no night."""
    day = bucket(F.col("ts_us") + offset_us, 86_400_000_000) - offset_us
    local = F.pmod(F.col("ts_us") + offset_us, F.lit(86_400_000_000))
    quiet = (local >= 3 * 3_600_000_000) & (local < 5 * 3_600_000_000)
    out = points.groupBy("node_id", "metric", day.alias("day_us")).agg(F.avg("value").alias("mean"), F.avg(F.when(quiet, F.col("value"))).alias("baseline"))
    return out.withColumn("delta", F.col("mean") - F.col("baseline"))


def prefix_profile(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("key_shape").agg(*[F.sum(c).alias(c) for c in ("keys", "bytes", "expires")], F.array_sort(F.collect_set("type")).alias("types"))


def client_summary(batches: DataFrame, keys: tuple[str, ...] = ("deployment", "command", "shape", "path", "script")) -> DataFrame:
    """Client counters by call shape; a re-delivered row (instance, process, batch, row) counts once."""
    once = batches.dropDuplicates(["instance", "process", "batch", "row_id"])
    return once.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("calls", "errors", "client_us")], F.count_distinct("pod").alias("pods"))


def client_comparison(now: DataFrame, before: DataFrame, keys: tuple[str, ...] = ("deployment", "command", "shape", "path", "script")) -> DataFrame:
    """Client counters of a window against those of the one before; a shape that was not seen there has no difference."""
    costs = ["calls", "errors", "client_us"]
    return with_baseline(client_summary(now, keys), client_summary(before, keys), list(keys), costs)


def reconcile_calls(server: DataFrame, client: DataFrame) -> DataFrame:
    """Server and client calls per command side by side; they never measure the same, so the difference is marked so."""
    s = server.groupBy("command").agg(F.sum("calls").alias("server_calls"))
    c = client.groupBy("command").agg(F.sum("calls").alias("client_calls"))
    return s.join(c, "command", "full_outer").withColumns({"difference": F.col("server_calls") - F.col("client_calls"), "comparable": F.lit(False)})


def metric_windows(points: DataFrame, start_us: int, end_us: int, period_us: int = MINUTE_US) -> DataFrame:
    """Whole periods of a metric per node, with why a period cannot be used.

    ``points``: ``node_id, epoch, end_us, value``. Precedence: node_or_epoch_changed, ambiguous, invalid, gaps. Values are
    rounded thousandths as integers.
    """
    spark = points.sparkSession
    first, last = -(-start_us // period_us) * period_us + period_us, end_us // period_us * period_us
    slots = spark.range(first, last + 1, period_us).select(F.col("id").alias("end_us")) if last >= first else spark.range(0).select(F.col("id").alias("end_us"))
    nodes = points.groupBy("node_id").agg(F.count_distinct("epoch").alias("epochs"))
    inside = points.filter(F.col("end_us").between(first, last))
    per = inside.groupBy("node_id", "end_us").agg(F.count_distinct("value").alias("values"), F.first("value").alias("value"), F.max(F.isnan(F.col("value").cast("double")) | (F.col("value") < 0)).alias("bad"))
    dense = nodes.crossJoin(F.broadcast(slots)).join(per, ["node_id", "end_us"], "left")
    reason = F.when(F.col("epochs") > 1, "node_or_epoch_changed").when(F.col("values") > 1, "ambiguous").when(F.col("bad"), "invalid").when(F.col("values").isNull(), "gaps")
    return dense.select("node_id", "end_us", reason.alias("reason"), F.when(reason.isNull(), F.bround(F.col("value").cast("decimal(38,6)") * 1000, 0).cast("bigint")).alias("value_milli"))


def metric_comparison(now: DataFrame, before: DataFrame) -> DataFrame:
    """Difference of window means per node, where both windows have as many good periods, at least 6."""

    def mean(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("node_id").agg(F.count("value_milli").alias(f"n_{name}"), F.avg("value_milli").alias(name), F.count_if(F.col("reason").isNotNull()).alias(f"bad_{name}"))

    both = mean(now, "now").join(mean(before, "before"), "node_id", "left")
    ok = (F.col("n_now") == F.col("n_before")) & (F.col("n_now") >= LEAST_POINTS) & (F.col("bad_now") == 0) & (F.col("bad_before") == 0)
    return both.withColumn("change", F.when(ok, F.col("now") - F.col("before")))


def pressure_runs(frames: DataFrame, period_us: int) -> DataFrame:
    """Runs of two or more adjacent periods in which no write ticket was free and writers queued.

    ``frames``: ``role, node_id, end_us, available, queued``.
    """
    saturated = frames.filter("available = 0 AND queued > 0")
    runs = islands(saturated, ["role", "node_id"], "end_us", F.col("end_us") - F.col("prev") == period_us, width=1440 * period_us)
    return runs.groupBy("role", "node_id", "run").agg(F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"), F.count(F.lit(1)).alias("periods"), F.max("queued").alias("peak")).filter("periods >= 2").drop("run")


def lock_wait_points(samples: DataFrame, period_us: int = MINUTE_US) -> DataFrame:
    """The latest sample of each period and role; periods with more than one node or conflicting values are dropped."""
    end = bucket(F.col("ts_us") - 1, period_us) + period_us
    at = F.struct("ts_us", "value")
    latest = samples.withColumn("end_us", end).groupBy("role", "end_us").agg(F.max(at).alias("x"), F.min("node_id").alias("node_id"), F.count_distinct("node_id").alias("nodes"), F.max("ts_us").alias("last_us"))
    tied = samples.withColumn("end_us", end).groupBy("role", "end_us", F.col("ts_us").alias("last_us")).agg((F.min("value") < F.max("value")).alias("conflict"))
    kept = latest.filter("nodes = 1").join(tied, ["role", "end_us", "last_us"]).filter("NOT conflict")
    return kept.select("role", "end_us", "node_id", "x.value")


def peak_concurrency(requests: DataFrame, keys: list[str], width_us: int = 3_600_000_000) -> DataFrame:
    """Most requests open at once per key: +1 at each start, -1 at each end, ends first at equal times; in bins of ``width_us``."""
    at = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d"))))
    steps = requests.select(*keys, at.alias("e")).select(*keys, "e.t", "e.d").groupBy(*keys, "t", "d").agg(F.sum("d").alias("n"))
    return highest_total(steps, keys, ["t", "d"], width_us, "n", "peak")


def log_histogram(rows: DataFrame, width_us: int = 5_000_000) -> DataFrame:
    return rows.groupBy(bucket(F.col("ts_us"), width_us).alias("bucket_us"), "category").agg(F.count(F.lit(1)).alias("n"))


def top_emitters(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Per category the ``n`` pods (or nodes) with most lines, ties by name, and their share of the category."""
    per = rows.groupBy("category", by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category")
    ranked = per.withColumns({"share": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), by))})
    return ranked.filter(F.col("rank") <= n)


def olap_workload(audit: DataFrame, slow_ms: int = 1000) -> DataFrame:
    """Statements of an OLAP audit: emissions of one execution collapse (the slow-query emission wins), then sums.

    Identity: query id, time, front end and statement id; without a query id also user, client and text. Truncated
    statements stay apart by text.
    """
    identity = ["query_id", "timestamp_us", "fe_ip", "stmt_id"]
    more = [F.when(F.col("query_id") == "", F.col(c)).otherwise(F.lit("")).alias(f"_{c}") for c in ("user", "client_ip", "stmt")]
    marked = audit.select("*", *more)
    first = F.row_number().over(Window.partitionBy(*identity, "_user", "_client_ip", "_stmt").orderBy((F.col("query_type") == "slow_query").desc(), F.desc("query_time_ms")))
    once = marked.withColumn("_nth", first).filter("_nth = 1")
    return once.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("executions"),
        F.count_if(F.upper("state") == "ERR").alias("failed"),
        F.count_if(F.col("query_time_ms") >= slow_ms).alias("slow"),
        F.max("query_time_ms").alias("longest_ms"),
        F.max("mem_bytes").alias("peak_bytes"),
        F.sum("scan_rows").alias("scan_rows"),
        F.count("scan_rows").alias("scan_rows_known"),
        F.sum("cpu_ns").alias("cpu_ns"),
        F.count("cpu_ns").alias("cpu_ns_known"),
        F.count_distinct("client_ip").alias("clients"),
        F.count_distinct("user").alias("accounts"),
    )


def mongo_rollup(events: DataFrame, costs: tuple[str, ...]) -> DataFrame:
    """Minute rollup of commands: costs in the minute of the start, running time in every minute touched.

    ``<cost>_known`` counts what was known; the longest command keeps its sample. Commands of over a day are an error.
    """
    day = 86_400_000_000
    checked = events.withColumn("duration_us", F.when(F.col("duration_us") > day, F.raise_error(F.lit("command longer than a day")).cast("bigint")).otherwise(F.col("duration_us")))
    # one pass over the records: each stands in all minutes that it touches, and counts in its first
    end = F.col("start_us") + F.greatest(F.coalesce("duration_us", F.lit(0)), F.lit(1))
    first = bucket(F.col("start_us"), MINUTE_US)
    minutes = F.sequence(first, bucket(end - 1, MINUTE_US), F.lit(MINUTE_US).cast("bigint"))
    spread = checked.withColumns({"_end": F.col("start_us") + F.coalesce("duration_us", F.lit(0)), "bucket_us": F.explode(minutes)}).withColumn("_home", F.col("bucket_us") == first)
    overlap = F.greatest(F.least("_end", F.col("bucket_us") + MINUTE_US) - F.greatest("start_us", "bucket_us"), F.lit(0))
    home = lambda c: F.when(F.col("_home"), F.col(c))
    began = F.count_if("_home") > 0  # else nothing is known of a minute but what ran on in it
    return spread.groupBy("role", "group_id", "bucket_us").agg(
        F.sum(overlap).alias("overlap_us"),
        F.when(began, F.count_if("_home")).alias("count"),
        *[F.sum(home(c)).alias(c) for c in costs],
        *[F.when(began, F.count(home(c))).alias(f"{c}_known") for c in costs],
        F.max(home("duration_us")).alias("max_us"),
        F.max_by("event_id", F.when(F.col("_home"), F.struct("duration_us", "start_us", "event_id"))).alias("sample"),
        F.min(home("start_us")).alias("first_us"),
        F.max(home("start_us")).alias("last_us"),
    )


def merge_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sum maps of counts per key."""
    long = df.select(*keys, F.explode(column).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))
    return long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(column))


def mongo_read(
    rollups: DataFrame, start_us: int, end_us: int, costs: tuple[str, ...], tail: DataFrame | None = None, published: DataFrame | None = None, complete_us: int | None = None, window_us: int = 300_000_000
) -> DataFrame:
    """Rollups of a window in at most 180 buckets; minutes that the window cuts are left out.

    ``tail``: minute rollups of what is not stored yet. They add only for source windows (``window_us`` wide) that ``published(window_us)``
    doesn't name, and only for minutes that ended by ``complete_us``, up to which the tail vouches for its minutes.
    """
    minutes = max(1, (end_us - start_us) // MINUTE_US)
    width = max(1, -(-minutes // 180)) * MINUTE_US
    if tail is not None:
        fresh = tail if complete_us is None else tail.filter(F.col("bucket_us") + MINUTE_US <= complete_us)
        if published is not None:
            windows = published.select(F.col("window_us").alias("_window")).distinct()
            fresh = fresh.withColumn("_window", bucket(F.col("bucket_us"), window_us)).join(windows, "_window", "left_anti").drop("_window")
        rollups = rollups.unionByName(fresh, allowMissingColumns=True)
    inside = rollups.filter((F.col("bucket_us") >= start_us) & (F.col("bucket_us") + MINUTE_US <= end_us))
    seen = [f(c).alias(c) for f, c in ((F.min, "first_us"), (F.max, "last_us")) if c in rollups.columns]
    return inside.groupBy("role", "group_id", bucket(F.col("bucket_us"), width).alias("bucket_us")).agg(F.sum("overlap_us").alias("overlap_us"), F.sum("count").alias("count"), *[F.sum(c).alias(c) for k in costs for c in (k, f"{k}_known")], F.max_by("sample", F.struct("max_us", "sample")).alias("sample"), F.max("max_us").alias("max_us"), *seen)


def indexed_workload(now: DataFrame, before: DataFrame, costs: tuple[str, ...], before_complete: bool) -> DataFrame:
    """Groups against a baseline; a group absent from a complete baseline counts as zero there, otherwise as unknown."""
    old = before.select("group_id", *[F.col(c).alias(f"{c}_before") for c in costs])
    out = now.join(old, "group_id", "left")
    if before_complete:
        out = out.withColumns({f"{c}_before": F.coalesce(f"{c}_before", F.lit(0)) for c in costs})
    return out.withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_before") for c in costs})


def workload_comparison(now: DataFrame, before: DataFrame, costs: tuple[str, ...], keys: tuple[str, ...] = ("role", "group_id"), complete: bool = True, before_complete: bool = True) -> DataFrame:
    """Groups (or families, by ``keys``) of minute rollups against a baseline, with what may be said of each cost.

    ``<cost>_observed_delta`` compares what was recorded, and ``<cost>_delta`` is it where the cost was known of every command
    on both sides. A group absent from a complete baseline counts as zero there, otherwise as unknown. ``assessment``:
    workload_growth_candidate, recorded_cost_increased, latency_growth_only or observed_costs_only. Order: read bytes, cpu.
    """

    def sums(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("count").alias(f"count{suffix}"), *[F.sum(c).alias(f"{c}{suffix}") for c in costs], *[F.sum(f"{c}_known").alias(f"{c}_known{suffix}") for c in costs])

    out = sums(now, "").join(sums(before, "_before").withColumn("_seen", F.lit(True)), list(keys), "left")
    absent = F.when(F.lit(before_complete) & F.col("_seen").isNull(), 0)
    both = F.lit(complete and before_complete)
    extra = {"count_before": F.coalesce("count_before", absent)}
    for c in costs:
        observed = F.when(F.col(f"{c}_known") > 0, F.col(c))
        baseline = F.coalesce(F.when(F.col(f"{c}_known_before") > 0, F.col(f"{c}_before")), absent)
        difference = F.when(both, observed - baseline)
        whole = (F.col(f"{c}_known") == F.col("count")) & (F.coalesce(f"{c}_known_before", F.lit(0)) == F.coalesce("count_before", F.lit(0)))
        extra |= {f"{c}_observed": observed, f"{c}_observed_delta": difference, f"{c}_delta": F.when(whole, difference)}
    out = out.withColumns(extra).drop("_seen")
    grown = lambda kind: sum((F.coalesce(F.col(f"{c}_{kind}") > 0, F.lit(False)).cast("int") for c in ("bytes_read", "cpu_ns") if c in costs), F.lit(0)) > 0
    slower = F.coalesce(F.col("duration_us_observed_delta") > 0, F.lit(False)) if "duration_us" in costs else F.lit(False)
    said = F.when(grown("delta"), "workload_growth_candidate").when(grown("observed_delta"), "recorded_cost_increased").when(slower, "latency_growth_only").otherwise("observed_costs_only")
    first = [F.desc(F.coalesce(f"{c}_observed", F.lit(0))) for c in ("bytes_read", "cpu_ns") if c in costs]
    return out.withColumn("assessment", said).orderBy(*first, *keys)


def grade(metric: Column, direct: list[str], related: list[str]) -> Column:
    """Whether a cost is a direct, a related or only an outcome measure of a metric."""
    return F.when(metric.isin(direct), "direct").when(metric.isin(related), "related").otherwise("outcome")


def paired_changes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Changes from one minute to the next, only where both minutes are there: ``x`` and ``y`` to ``dx`` and ``dy``."""
    w = Window.partitionBy(*keys).orderBy("minute_us")
    near = F.col("minute_us") - F.lag("minute_us").over(w) == MINUTE_US
    return points.withColumns({"dx": F.when(near, F.col("x") - F.lag("x").over(w)), "dy": F.when(near, F.col("y") - F.lag("y").over(w))})


def _ranked(points: DataFrame, keys: list[str]) -> DataFrame:
    changed = paired_changes(points, keys)
    sums = changed.groupBy(*keys).agg(F.sum("x").alias("total"), *sums_for_pearson(F.col("dx"), F.col("dy")))
    r = F.when(F.col("n") >= LEAST_POINTS, pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]))
    return sums.select(*keys, "total", "n", r.alias("r")).orderBy(F.desc_nulls_last("r"), F.desc("total"), *keys)


def hot_keys(hits: DataFrame, metric: DataFrame) -> DataFrame:
    """Key shapes by how their hits changed with a node's metric, minute by minute (6 paired minutes at least).

    ``hits``: ``node_id, key, minute_us, hits``; ``metric``: ``node_id, minute_us, value``.
    """
    joined = hits.join(metric, ["node_id", "minute_us"]).select("node_id", "key", "minute_us", F.col("hits").alias("x"), F.col("value").alias("y"))
    return _ranked(joined, ["node_id", "key"])


def client_shapes(calls: DataFrame, metric: DataFrame) -> DataFrame:
    """Call shapes of clients against the metric of all nodes together.

    ``calls``: ``deployment, command, shape, minute_us, client_us``.
    """
    whole = metric.groupBy("minute_us").agg(F.sum("value").alias("y"))
    per = calls.groupBy("deployment", "command", "shape", "minute_us").agg(F.sum("client_us").alias("x"))
    return _ranked(per.join(whole, "minute_us"), ["deployment", "command", "shape"])


def redis_layers(snapshots: DataFrame) -> DataFrame:
    """Per node, first to last snapshot of a window: cpu seconds per processed command, memory first, last and change."""
    at = lambda c: (F.min_by(c, "ts_us").alias(f"{c}_first"), F.max_by(c, "ts_us").alias(f"{c}_last"))
    flat = snapshots.select("node_id", "ts_us", (F.col("cpu.sys") + F.col("cpu.user")).alias("cpu"), F.col("gauges")["total_commands_processed"].alias("commands"), F.col("gauges")["used_memory"].alias("memory"))
    out = flat.groupBy("node_id").agg(*at("cpu"), *at("commands"), *at("memory"))
    ran = F.col("commands_last") - F.col("commands_first")
    return out.withColumns({"cpu_per_command": F.when(ran > 0, (F.col("cpu_last") - F.col("cpu_first")) / ran), "memory_delta": F.col("memory_last") - F.col("memory_first")})
