"""Queries on evidence by metric and on covered windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import comparison_window, grain_for
from ..operators import counters as cn
from ..operators import coverage as cov
from ..operators import evidence as ev
from ..operators import lag, mongo
from . import inputs as i
from .registry import DAY, HOUR, START, register
from .store_queries import _E, _ROLLED, _events, _minute_costs

_MID, _END = START + 15 * DAY, START + 30 * DAY
_METRICS = ("CPUUtilization", "IOPSUtilization", "AvgRt", "MemoryUtilization", "Connections")


def _groups(spark, d) -> DataFrame:
    e = _events(spark, d)
    n = F.col("event_id")
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("role"), F.concat_ws("-", "event_type", (F.col("user_id") % 60).cast("string")).alias("group_id"), F.col("us").alias("first_us"), (n % 200 == 0).alias("incomplete"), F.col("us").alias("bucket_us"),
        F.lit(1).alias("count"), F.lit(0).alias("overlap_us"), F.col("v").alias("max_us"), (F.col("v") * 10).alias("duration_us"), F.lit(1).alias("duration_us_known"),
        F.when(n % 30 > 0, F.col("k")).alias("docs"), (n % 30 > 0).cast("int").alias("docs_known"), (F.col("k") * 1000).alias("cpu_ns"), F.lit(1).alias("cpu_ns_known"),
        F.when(n % 9 > 0, F.col("v")).alias("bytes_read"), (n % 9 > 0).cast("int").alias("bytes_read_known"), (F.col("k") % 3).alias("write_wait_us"), F.lit(1).alias("write_wait_us_known"),
    )


def _points(spark, d) -> DataFrame:
    """A sample of each metric, role and day: one role's I/O is sometimes negative, one role restarts, stocks name no node."""
    day = F.floor((F.col("us") - START) / DAY).cast("bigint")
    per = _events(spark, d).groupBy(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("role"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rows = per.withColumn("metric", F.explode(F.array(*map(F.lit, _METRICS[:4]))))
    bad = (F.col("metric") == "IOPSUtilization") & (F.col("role") == "r0") & (F.col("day") % 7 == 3)
    again = (F.col("metric") == "AvgRt") & (F.col("role") == "r2") & (F.col("day") >= 15)
    return rows.select(
        "role", "metric", F.when(F.col("metric") != "MemoryUtilization", F.concat(F.lit("n-"), "role")).alias("node_id"), F.when(again, "e1").otherwise("e0").alias("epoch"),
        (F.col("day") * DAY + (START + DAY)).alias("end_us"), F.when(bad, -1).otherwise(F.col("n")).cast("double").alias("value"),
    )


_COST_SQL = ", ".join(f"sum({c}) AS {c}, count({c}) AS {c}_n" for c in ("duration_us", "docs", "cpu_ns", "bytes_read", "write_wait_us"))
_DELTA_SQL = ", ".join(f"CASE WHEN n.{c}_n = n.n AND o.{c}_n = o.n THEN n.{c} - o.{c} END AS {c}_d" for c in ("duration_us", "docs", "cpu_ns", "bytes_read", "write_wait_us"))


@register(f"""WITH {_E}, g AS (SELECT 'r' || (user_id % 3) AS role, event_type || '-' || (user_id % 60) AS group_id, us, us >= {_MID} AS late, event_id % 200 = 0 AS incomplete, v * 10 AS duration_us, CASE WHEN event_id % 30 > 0 THEN k END AS docs, k * 1000 AS cpu_ns, CASE WHEN event_id % 9 > 0 THEN v END AS bytes_read, k % 3 AS write_wait_us FROM e),
s AS (SELECT role, group_id, late, count(*) AS n, min(us) AS first_us, bool_or(incomplete) AS incomplete, {_COST_SQL} FROM g GROUP BY ALL),
c AS (SELECT n.*, o.n AS n_b, o.duration_us AS duration_us_b, o.cpu_ns AS cpu_ns_b, o.bytes_read AS bytes_read_b, {_DELTA_SQL} FROM s n LEFT JOIN s o ON o.role = n.role AND o.group_id = n.group_id AND NOT o.late WHERE n.late),
t AS (SELECT unnest(['CPUUtilization', 'IOPSUtilization', 'AvgRt', 'MemoryUtilization', 'Connections']) AS metric),
p AS (SELECT 'r' || (user_id % 3) AS role, (us - {START}) // {DAY} AS day, count(*) AS n FROM e GROUP BY 1, 2),
w AS (SELECT role, metric, day >= 15 AS late, count(*) AS days, avg(n) AS mean, arg_max(day, (n, -day)) AS peak, bool_or(metric = 'IOPSUtilization' AND role = 'r0' AND day % 7 = 3) AS bad FROM p, t WHERE metric <> 'Connections' AND day BETWEEN 0 AND 29 GROUP BY ALL),
m AS (SELECT a.role, a.metric, CASE WHEN a.bad THEN 'invalid_metric_value' WHEN a.days < 15 THEN 'metric_gaps' ELSE 'ok' END AS metric_status, {START + DAY} + a.peak * {DAY} AS peak_us,
  CASE WHEN b.days IS NULL THEN 'metric_baseline_unavailable' WHEN a.bad OR b.bad OR a.days < 15 OR b.days < 15 THEN 'metric_comparison_incomplete' WHEN a.metric = 'AvgRt' AND a.role = 'r2' THEN 'node_or_epoch_changed' WHEN a.metric = 'MemoryUtilization' THEN 'role_only_identity_unverified' ELSE 'ok' END AS compared, a.mean - b.mean AS rise FROM w a LEFT JOIN w b ON b.role = a.role AND b.metric = a.metric AND NOT b.late WHERE a.late),
x AS (SELECT c.*, t.metric, coalesce(metric_status, 'metric_missing') AS metric_status, coalesce(compared, 'metric_baseline_unavailable') AS compared, CASE WHEN compared IN ('ok', 'role_only_identity_unverified') THEN rise END AS rise, coalesce(incomplete, false) AS broken, coalesce(metric_status = 'ok' AND first_us >= peak_us, false) AS after,
  CASE c.role WHEN 'r0' THEN 'single_observed_epoch' WHEN 'r1' THEN 'node_or_epoch_changed' ELSE 'unverified' END AS continuity,
  CASE t.metric WHEN 'CPUUtilization' THEN 'direct' WHEN 'IOPSUtilization' THEN 'related' WHEN 'AvgRt' THEN 'outcome' ELSE 'unavailable' END AS relation,
  CASE t.metric WHEN 'CPUUtilization' THEN cpu_ns_d WHEN 'IOPSUtilization' THEN bytes_read_d WHEN 'AvgRt' THEN duration_us_d END AS delta, CASE t.metric WHEN 'CPUUtilization' THEN cpu_ns WHEN 'IOPSUtilization' THEN bytes_read WHEN 'AvgRt' THEN duration_us END AS observed,
  CASE t.metric WHEN 'CPUUtilization' THEN cpu_ns_b WHEN 'IOPSUtilization' THEN bytes_read_b WHEN 'AvgRt' THEN duration_us_b END AS baseline FROM c CROSS JOIN t LEFT JOIN m ON m.role = c.role AND m.metric = t.metric),
y AS (SELECT *, CASE WHEN metric = 'MemoryUtilization' THEN 'memory_requires_component_deltas' WHEN relation = 'unavailable' THEN 'resource_cost_unavailable' WHEN broken THEN 'incomplete_command' WHEN after THEN 'after_peak' WHEN delta IS NULL THEN 'resource_cost_incomplete' WHEN delta > 0 THEN CASE relation WHEN 'direct' THEN 'direct_cost_growth' WHEN 'related' THEN 'related_cost_growth' ELSE 'latency_growth_not_cause' END ELSE 'no_resource_cost_growth' END AS own FROM x),
z AS (SELECT *, continuity = 'node_or_epoch_changed' OR compared = 'node_or_epoch_changed' AS moved, metric_status = 'invalid_metric_value' AS bad FROM y)
SELECT metric, role, group_id, CASE WHEN moved THEN 'node_or_epoch_changed' WHEN bad THEN 'metric_identity_or_values_invalid' ELSE own END AS status,
  CASE WHEN moved OR bad THEN 0 WHEN own = 'direct_cost_growth' THEN 3 WHEN own = 'related_cost_growth' THEN 2 WHEN own = 'latency_growth_not_cause' THEN 1 ELSE 0 END AS priority,
  CASE WHEN broken THEN 'incomplete_command' WHEN after THEN 'after_peak' WHEN coalesce(duration_us_d > 0, false) OR coalesce(docs_d > 0, false) OR coalesce(cpu_ns_d > 0, false) OR coalesce(bytes_read_d > 0, false) THEN 'candidate' WHEN duration_us_d IS NULL OR docs_d IS NULL OR cpu_ns_d IS NULL OR bytes_read_d IS NULL THEN 'insufficient_cost_fields' ELSE 'no_observed_growth' END AS assessment,
  CAST(delta AS DOUBLE) AS delta, CASE WHEN delta IS NOT NULL THEN round((n - n_b) * (baseline / n_b), 3) END AS frequency_component, CASE WHEN delta IS NOT NULL THEN round(observed - n * (baseline / n_b), 3) END AS per_call_component,
  concat_ws(',', CASE WHEN own = 'no_resource_cost_growth' AND duration_us_d > 0 THEN 'elapsed_growth_without_resource_cost_growth' END, CASE WHEN write_wait_us_d > 0 THEN 'write_concern_wait_increased' END, CASE WHEN continuity = 'node_or_epoch_changed' THEN continuity END, CASE WHEN rise <= 0 THEN 'resource_window_mean_not_increased' END,
    CASE relation WHEN 'related' THEN 'read_bytes_not_physical_iops_or_all_writes' WHEN 'outcome' THEN 'elapsed_time_includes_waits' END, 'slow_records_not_total_executions', 'association_not_causation', CASE WHEN continuity = 'unverified' THEN 'native_epoch_unverified' END, CASE WHEN metric_status <> 'ok' THEN 'temporal_association_unavailable' END, CASE WHEN compared <> 'ok' THEN compared END) AS reasons FROM z""")
def resource_assessment(spark, d):
    """Command groups of half a month against the half before, graded for each of five metrics."""
    groups = _groups(spark, d)
    late = F.col("bucket_us") >= _MID
    analyzed = mongo.mongo_analyze(groups.filter(late), groups.filter(~late), (*ev.COSTS, "write_wait_us"))
    points = _points(spark, d)
    now, before = ev.metric_profiles(points, _MID, _END, DAY), ev.metric_profiles(points, START, _MID, DAY)
    samples = _events(spark, d).filter("user_id % 3 < 2").select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("role"), F.lit("n").alias("node_id"), F.when(F.col("user_id") % 3 == 0, "e").otherwise(F.concat(F.lit("e"), (F.col("event_id") % 2).cast("string"))).alias("epoch"))
    out = ev.assess(analyzed, list(_METRICS), now, ev.compare_profiles(now, before), ev.continuity(samples))
    parts = [F.round(c, 3).alias(c) for c in ("frequency_component", "per_call_component")]
    return out.select("metric", "role", "group_id", "status", "priority", "assessment", "delta", *parts, F.array_join("reasons", ",").alias("reasons"))


_PEERS = f"""s AS (SELECT 'n' || (user_id % 6) AS node_id, epoch_us(ts) - epoch_us(ts) % {DAY} AS end_us, CAST(count(*) AS DOUBLE) AS reads, count(*) FILTER (event_type = 'error') * (user_id % 6 + 1) AS slow, sum(value) AS threads, CASE WHEN user_id % 6 <> 5 THEN avg(value) END AS cpu, max(value) AS iops FROM events GROUP BY user_id % 6, 2),
  h AS (SELECT a.node_id, a.end_us, CASE WHEN median(b.reads) < 30 THEN 'unknown' WHEN any_value(a.reads) < 0.95 * median(b.reads) THEN 'removed' ELSE 'usable' END AS status FROM s a JOIN s b ON a.end_us = b.end_us AND a.node_id <> b.node_id GROUP BY 1, 2)"""


def _peers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Days of six nodes as minutes: events as reads, errors as slow statements; one node tells no processor load."""
    e = i.table(spark, d, "events")
    us, n = F.unix_micros(F.col("ts").cast("timestamp")), F.col("user_id") % 6
    per = e.groupBy(n.alias("n"), (us - F.pmod(us, F.lit(DAY))).alias("end_us")).agg(
        F.count(F.lit(1)).cast("double").alias("reads"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("threads"), F.avg("value").alias("mean"), F.max("value").alias("iops")
    )
    series = per.select(F.lit("i").alias("instance_id"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("node_id"), "end_us", "reads", (F.col("errors") * (F.col("n") + 1)).alias("slow"), "threads", F.when(F.col("n") != 5, F.col("mean")).alias("cpu"), "iops")
    return series, lag.peer_health(series, 30, 0.95)


@register(f"""WITH {_PEERS}, r AS (SELECT *, CASE WHEN end_us - lag(end_us) OVER (PARTITION BY node_id ORDER BY end_us) <= {2 * DAY} THEN 0 ELSE 1 END AS f FROM h WHERE status = 'removed'), g AS (SELECT *, sum(f) OVER (PARTITION BY node_id ORDER BY end_us) AS run FROM r)
  SELECT node_id, min(end_us) - {DAY} AS start_us, max(end_us) AS end_us, count(*) AS minutes FROM g GROUP BY node_id, run HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY max(end_us) DESC) <= 3""")
def removed_intervals(spark, d):
    """The last three runs of two days or more in which a node had less than 95 % of its peers' reads."""
    return lag.removed_intervals(_peers(spark, d)[1], DAY, 2, 3).drop("instance_id")


_MEASURES = {"slow_per_1000_reads": ("sum(b.slow) / sum(b.reads) * 1000", 2), "ms_per_read": ("sum(b.threads) / sum(b.reads) * 1000", 2), "reads_per_s": ("avg(b.reads)", 0), "cpu_pct": ("avg(b.cpu)", 1), "iops_pct": ("avg(b.iops)", 1)}


@register(f"""WITH {_PEERS}, u AS (SELECT * FROM h WHERE end_us BETWEEN {START + 3 * DAY} AND {START + 20 * DAY} AND node_id <> 'n3'), c AS (SELECT node_id, count(*) AS minutes, count(*) FILTER (status = 'usable') AS read_minutes FROM u GROUP BY 1),
  p AS (SELECT u.node_id, b.node_id AS other, sum(b.slow * 60) AS slow, {", ".join(f"{x} AS {n}" for n, (x, _) in _MEASURES.items())} FROM u JOIN s b USING (end_us) WHERE status = 'usable' GROUP BY 1, 2),
  m AS (SELECT node_id, max(slow) FILTER (other = node_id) AS slow, {", ".join(f"max({n}) FILTER (other = node_id) AS {n}_o, median({n}) FILTER (other <> node_id) AS {n}_p" for n in _MEASURES)} FROM p GROUP BY 1)
  SELECT c.node_id, CASE WHEN read_minutes < 5 THEN 'no_reads' ELSE 'ok' END AS status, minutes, read_minutes, CASE WHEN read_minutes >= 5 THEN coalesce(slow >= 60 AND round_even(slow_per_1000_reads_o / greatest(slow_per_1000_reads_p, 0.05), 2) >= 3, false) END AS diverged,
  {", ".join(f"CASE WHEN read_minutes >= 5 AND {n}_p IS NOT NULL THEN round_even({n}_o, {k}) END AS {n}_node, CASE WHEN read_minutes >= 5 AND {n}_o IS NOT NULL THEN round_even({n}_p, {k}) END AS {n}_peers" for n, (_, k) in _MEASURES.items())} FROM c LEFT JOIN m USING (node_id)""")
def peer_evidence(spark, d):
    """Five nodes that lagged for seventeen days against their peers."""
    series, health = _peers(spark, d)
    spans = series.filter("node_id <> 'n3'").select("instance_id", "node_id").distinct().select("*", F.lit(START + 3 * DAY).alias("start_us"), F.lit(START + 20 * DAY).alias("end_us"))
    out = lag.peer_evidence(series, health, spans)
    return out.select("node_id", "status", "minutes", "read_minutes", "diverged", *[F.col(f"{n}.{x}").alias(f"{n}_{x}") for n in _MEASURES for x in ("node", "peers")])


_CUT, _SEEN = START + 20 * DAY, START + 29 * DAY + 7 * HOUR


@register(f"""WITH {_E}, {_ROLLED}, k AS (SELECT *, bucket_us - bucket_us % {HOUR} AS w FROM b), p AS (SELECT DISTINCT w FROM k WHERE w < {_CUT} AND w // {HOUR} % 7 > 0),
  t AS (SELECT k.* FROM k SEMI JOIN p USING (w) UNION ALL SELECT group_id, bucket_us, count * 10 AS count, duration_us, docs, docs_known, max_us, w FROM k ANTI JOIN p USING (w) WHERE bucket_us >= {_CUT - 2 * DAY} AND bucket_us + 60000000 <= {_SEEN})
  SELECT group_id, bucket_us - bucket_us % {240 * 60_000_000} AS bucket_us, CAST(sum(count) AS BIGINT) AS count, CAST(sum(duration_us) AS BIGINT) AS duration_us, max(max_us) AS max_us FROM t GROUP BY 1, 2""")
def command_tail(spark, d):
    """Stored hours and a live tail that reaches two days back: it adds for hours that were not published, up to what it has seen."""
    rows = _minute_costs(spark, d).filter("count > 0")
    hour = F.floor(F.col("bucket_us") / HOUR)
    stored = rows.filter((F.col("bucket_us") < _CUT) & (hour % 7 > 0))
    published = stored.select((hour * HOUR).alias("window_us")).distinct()
    tail = rows.filter(F.col("bucket_us") >= _CUT - 2 * DAY).withColumn("count", F.col("count") * 10)
    out = cn.mongo_read(stored, START, START + 30 * DAY, ("duration_us", "docs"), tail, published, _SEEN, HOUR)
    return out.select("group_id", "bucket_us", "count", "duration_us", "max_us")


_SPANS = f"""s AS (SELECT o_custkey % 300 AS instance_id, epoch_us(o_orderdate) AS lo FROM orders GROUP BY 1, 2), b AS (SELECT *, lead(lo) OVER (PARTITION BY instance_id ORDER BY lo) AS next FROM s),
spans AS (SELECT instance_id, lo, least(lo + ((lo // {DAY}) % 9 + 1) * {DAY} + {HOUR // 2}, coalesce(next - {HOUR}, lo + 30 * {DAY})) AS hi FROM b),
w AS (SELECT c_custkey AS id, c_custkey % 300 AS instance_id, {694224000000000} + c_custkey % 2400 * {DAY} + {HOUR} AS start_us, {694224000000000} + c_custkey % 2400 * {DAY} + {HOUR} + (c_custkey % 4 + 1) * {DAY} + 90000000 AS end_us FROM customer)"""


def _windows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Windows of one to four days that customers ask for, and disjoint spans that their orders cover."""
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    starts = i.table(spark, d, "orders").select((F.col("o_custkey") % 300).alias("instance_id"), at.alias("lo")).distinct()
    pairs = starts.withColumn("next", F.lead("lo").over(Window.partitionBy("instance_id").orderBy("lo")))
    hi = F.least(F.col("lo") + (F.floor(F.col("lo") / DAY) % 9 + 1) * DAY + HOUR // 2, F.coalesce(F.col("next") - HOUR, F.col("lo") + 30 * DAY))
    begin = F.col("c_custkey") % 2400 * DAY + (694_224_000_000_000 + HOUR)
    windows = i.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 300).alias("instance_id"), begin.alias("start_us"), (begin + (F.col("c_custkey") % 4 + 1) * DAY + 90_000_000).alias("end_us"))
    return windows, pairs.select("instance_id", "lo", hi.alias("hi"))


@register(f"""WITH {_SPANS}, j AS (SELECT id, start_us, least(end_us, hi) // 60000000 * 60000000 AS cut FROM w JOIN spans USING (instance_id) WHERE lo <= start_us AND start_us < hi)
  SELECT id, CASE WHEN cut - w.start_us >= {2 * DAY} THEN w.start_us END AS ready_start_us, CASE WHEN cut - w.start_us >= {2 * DAY} THEN cut END AS ready_end_us FROM w LEFT JOIN j USING (id)""")
def ready_prefix(spark, d):
    """The covered beginning of each window, to a whole minute, where it lasts two days."""
    return cov.ready_prefixes(*_windows(spark, d), 2 * DAY).select("id", "ready_start_us", "ready_end_us")


@register(f"""WITH {_SPANS}, j AS (SELECT id, end_us - start_us AS length, greatest(lo, least(start_us, hi - (end_us - start_us))) AS pos, start_us FROM w JOIN spans USING (instance_id) WHERE hi - lo >= end_us - start_us),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(pos - start_us), pos) AS nth FROM j) SELECT w.id, pos AS nearest_start_us, pos + length AS nearest_end_us FROM w LEFT JOIN n ON n.id = w.id AND nth = 1""")
def nearest_window(spark, d):
    """The covered window of the same length that is nearest to each one asked for."""
    return cov.nearest_windows(*_windows(spark, d)).select("id", "nearest_start_us", "nearest_end_us")


_ASKED = (("short", START + 9 * DAY, START + 9 * DAY + 5 * HOUR), ("middle", START + 12 * DAY + HOUR, START + 17 * DAY), ("long", START + 15 * DAY, START + 29 * DAY))


@register(f"""WITH w(name, grain, lo, hi) AS (VALUES ('short', '5m', {START + 9 * DAY}, {START + 9 * DAY + 5 * HOUR}), ('middle', 'hour', {START + 12 * DAY + HOUR}, {START + 17 * DAY}), ('long', 'day', {START + 15 * DAY}, {START + 29 * DAY})),
  e AS (SELECT epoch_us(ts) AS us, event_type FROM events) SELECT name, grain, event_type, count(*) FILTER (us >= lo AND us < hi) AS events, count(*) FILTER (us >= lo - (hi - lo) AND us < lo) AS events_before FROM w, e WHERE us >= lo - (hi - lo) AND us < hi GROUP BY ALL""")
def compared_windows(spark, d):
    """Three windows, each with the grain that answers it, against the window before."""
    e = _events(spark, d)
    out = []
    for name, low, high in _ASKED:
        before, _ = comparison_window(low, high)
        inside = e.filter((F.col("us") >= before) & (F.col("us") < high))
        now = F.col("us") >= low
        out.append(inside.groupBy("event_type").agg(F.count_if(now).alias("events"), F.count_if(~now).alias("events_before")).select(F.lit(name).alias("name"), F.lit(grain_for(low, high)).alias("grain"), "event_type", "events", "events_before"))
    return reduce(DataFrame.unionByName, out)
