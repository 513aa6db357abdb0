"""Which command groups are evidence for the rise of a resource: cost matched to the metric, graded, with what speaks against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
LEAST_PERIODS = 6
#: The cost that is measured in a metric's own resource, and how near the two are.
COST_OF = {
    "CPUUtilization": ("cpu_ns", "direct"),
    "ScannedDocs": ("docs", "direct"),
    "IOPSUtilization": ("bytes_read", "related"),
    "IoBandwidth": ("bytes_read", "related"),
    "AvgRt": ("duration_us", "outcome"),
    "WriteAvgRt": ("duration_us", "outcome"),
}
#: Metrics of a stock, of which no command has a cost.
STOCKS = ("MemoryUtilization", "WtCacheUsage", "CentralCacheFree", "TcmallocCacheMemRatio", "WtCacheDirtyUsage", "DirtyCacheBytes", "WtCacheUpdatesUsage")
#: Status and priority of a growing cost by its relation.
GROWN = {"direct": ("direct_cost_growth", 3), "related": ("related_cost_growth", 2), "outcome": ("latency_growth_not_cause", 1)}
UNUSABLE = ("incomplete_source", "incomplete_baseline", "incomplete_command", "after_peak", "incomparable_windows")
CHANGED = "node_or_epoch_changed"
COSTS = ("duration_us", "docs", "cpu_ns", "bytes_read")


def metric_profiles(points: DataFrame, start_us: int, end_us: int, period_us: int = MINUTE_US) -> DataFrame:
    """Per role and metric over the whole periods of the window: ``status`` (ok, or the gravest reason why not), ``periods, mean, peak_us``
    (end of the first highest period), ``nodes, epochs``, and whether every sample named its node.

    ``points``: ``role, metric, node_id, epoch, end_us, value`` (node and epoch null where unknown). A period's samples must agree. No
    grid is laid out: gaps follow from the number of periods seen. Values count in thousandths.
    """
    first, last = -(-start_us // period_us) * period_us + period_us, end_us // period_us * period_us
    expected = max(0, (last - first) // period_us + 1)
    inside = points.filter(F.col("end_us").between(first, last) & (F.pmod("end_us", F.lit(period_us)) == 0))
    value = F.col("value").cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))) & (value >= 0)
    milli = F.when(good, F.bround(value * 1000).cast("bigint"))
    node = F.coalesce("node_id", F.lit(""))
    per = inside.groupBy("role", "metric", "end_us").agg(
        F.count(F.lit(1)).alias("n"), F.count(milli).alias("good"), F.min(milli).alias("low"), F.max(milli).alias("high"),
        F.min(node).alias("first_node"), F.max(node).alias("last_node"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"),
    )
    named = inside.groupBy("role", "metric").agg(
        F.array_sort(F.collect_set(F.when(node != "", node))).alias("nodes"), F.array_sort(F.collect_set("epoch")).alias("epochs"), (F.count_if(node == "") == 0).alias("named")
    )  # a role has a handful of nodes
    agreed = F.when((F.col("good") == F.col("n")) & (F.col("low") == F.col("high")), F.col("low"))
    ambiguous = (F.col("first_node") != F.col("last_node")) | (F.coalesce(F.col("low") != F.col("high"), F.lit(False)))
    out = per.withColumn("v", agreed).groupBy("role", "metric").agg(
        F.count(F.lit(1)).alias("seen"), F.max(ambiguous).alias("ambiguous"), F.max(F.col("good") < F.col("n")).alias("invalid"),
        F.count("v").alias("periods"), (F.avg("v") / 1000).alias("mean"), F.max_by("end_us", F.when(F.col("v").isNotNull(), F.struct("v", -F.col("end_us")))).alias("peak_us"),
    )
    out = out.join(named, ["role", "metric"])
    status = F.when((F.size("nodes") > 1) | (F.size("epochs") > 1), CHANGED).when(F.col("ambiguous"), "ambiguous_metric_samples").when(F.col("invalid"), "invalid_metric_value").when(F.col("seen") < expected, "metric_gaps").otherwise("ok")
    return out.select("role", "metric", status.alias("status"), "periods", "mean", "peak_us", "nodes", "epochs", "named")


def compare_profiles(now: DataFrame, before: DataFrame) -> DataFrame:
    """Difference of a metric's means between two windows, or why there is none: ``role, metric, status, delta``."""
    names = [c for c in now.columns if c not in ("role", "metric")]
    both = now.join(before.select("role", "metric", *[F.col(c).alias(f"{c}_before") for c in names]), ["role", "metric"], "left")
    whole = (F.col("status") == "ok") & (F.col("status_before") == "ok") & (F.col("periods") == F.col("periods_before")) & (F.col("periods") >= LEAST_PERIODS)
    same = (F.col("nodes") == F.col("nodes_before")) & (F.col("epochs") == F.col("epochs_before"))
    status = F.when(F.col("status_before").isNull(), "metric_baseline_unavailable").when(~whole, "metric_comparison_incomplete").when(~same, CHANGED)
    status = status.when(F.col("named") & F.col("named_before"), "ok").otherwise("role_only_identity_unverified")
    return both.select("role", "metric", status.alias("status"), F.when(whole & same, F.col("mean") - F.col("mean_before")).alias("delta"))


def continuity(samples: DataFrame) -> DataFrame:
    """Per role whether all samples ``(role, node_id, epoch)`` that tell both came from one process of one node."""
    known = samples.filter("node_id <> '' AND epoch IS NOT NULL")
    one = (F.min("node_id") == F.max("node_id")) & (F.min("epoch") == F.max("epoch"))
    return known.groupBy("role").agg(F.when(one, "single_observed_epoch").otherwise(CHANGED).alias("continuity"))


def _of_metric(column: str) -> Column:
    """The value of the cost that belongs to the row's metric."""
    picked = [F.when(F.col("metric") == m, F.col(column.format(c)).cast("double")) for m, (c, _) in COST_OF.items()]
    return F.coalesce(*picked)


def assess(
    groups: DataFrame, metrics: list[str], profiles: DataFrame, comparison: DataFrame, continuity: DataFrame, covered: bool = True, before_covered: bool = True, comparable: bool = True
) -> DataFrame:
    """One graded row for each command group and metric.

    ``groups``: ``mongo.mongo_analyze`` with all of ``COSTS``, ``write_wait_us``, ``first_us`` and ``incomplete`` (a command that wasn't read whole);
    the rest as the functions above return them. ``status`` and ``priority`` (3 direct, 2 related, 1 outcome, 0 nothing) say what the group's cost
    in the metric's resource did, ``assessment`` whether the windows allow a verdict (a group first seen after the peak can't explain it),
    ``reasons`` what limits it. The change is parted into frequency and cost per call. A group is a candidate from priority 2 on.
    """
    rows = groups.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    told = profiles.select("role", "metric", F.col("status").alias("metric_status"), "peak_us")
    against = comparison.select("role", "metric", F.col("status").alias("compared"), F.col("delta").alias("mean_delta"))
    rows = rows.join(told, ["role", "metric"], "left").join(against, ["role", "metric"], "left").join(continuity, "role", "left")
    rows = rows.withColumns({
        "metric_status": F.coalesce("metric_status", F.lit("metric_missing")), "compared": F.coalesce("compared", F.lit("metric_baseline_unavailable")), "continuity": F.coalesce("continuity", F.lit("unverified")),
    })
    deltas = [F.col(f"{c}_delta") for c in COSTS]
    any_of = lambda tests: reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    late = (F.col("metric_status") == "ok") & (F.col("first_us") >= F.col("peak_us"))
    fixed = F.when(F.lit(not covered), "incomplete_source").when(F.lit(not before_covered), "incomplete_baseline").when(F.lit(not comparable), "incomparable_windows")
    assessment = fixed.when(F.col("incomplete"), "incomplete_command").when(late, "after_peak").when(any_of([d > 0 for d in deltas]), "candidate")
    assessment = assessment.when(reduce(lambda a, b: a | b, [d.isNull() for d in deltas]), "insufficient_cost_fields").otherwise("no_observed_growth")
    field = F.coalesce(*[F.when(F.col("metric") == m, c) for m, (c, _) in COST_OF.items()])
    relation = F.coalesce(*[F.when(F.col("metric") == m, r) for m, (_, r) in COST_OF.items()], F.lit("unavailable"))
    rows = rows.withColumns({"assessment": assessment, "cost_field": field, "cost_relation": relation, "observed": _of_metric("{}"), "baseline": _of_metric("{}_before"), "delta": _of_metric("{}_delta")})
    grown = F.coalesce(*[F.when(F.col("cost_relation") == r, s) for r, (s, _) in GROWN.items()])
    weight = F.coalesce(*[F.when(F.col("cost_relation") == r, n) for r, (_, n) in GROWN.items()])
    own = F.when(F.col("metric").isin(*STOCKS), "memory_requires_component_deltas").when(F.col("cost_field").isNull(), "resource_cost_unavailable").when(F.col("assessment").isin(*UNUSABLE), F.col("assessment"))
    own = own.when(F.col("delta").isNull(), "resource_cost_incomplete").when(F.col("delta") > 0, grown).otherwise("no_resource_cost_growth")
    rows = rows.withColumn("_own", own)
    moved = (F.col("continuity") == CHANGED) | (F.col("compared") == CHANGED)
    bad = F.col("metric_status").isin(CHANGED, "ambiguous_metric_samples", "invalid_metric_value")
    status = F.when(moved, CHANGED).when(bad, "metric_identity_or_values_invalid").otherwise(F.col("_own"))
    priority = F.when(~moved & ~bad & (F.col("_own") == grown), weight).otherwise(0)
    reasons = [
        F.when((F.col("_own") == "no_resource_cost_growth") & (F.col("duration_us_delta") > 0), "elapsed_growth_without_resource_cost_growth"),
        F.when(F.col("write_wait_us_delta") > 0, "write_concern_wait_increased"),
        F.when(F.col("continuity") == CHANGED, CHANGED),
        F.when((F.col("compared") != CHANGED) & (F.col("mean_delta") <= 0), "resource_window_mean_not_increased"),
        F.when(F.col("cost_relation") == "related", "read_bytes_not_physical_iops_or_all_writes"),
        F.when(F.col("cost_relation") == "outcome", "elapsed_time_includes_waits"),
        F.lit("slow_records_not_total_executions"),
        F.lit("association_not_causation"),
        F.when(F.col("continuity") == "unverified", "native_epoch_unverified"),
        F.when(F.col("metric_status") != "ok", "temporal_association_unavailable"),
        F.when(F.col("compared") != "ok", F.col("compared")),
    ]
    parted = F.col("delta").isNotNull() & (F.col("count_before") > 0)
    each = F.col("baseline") / F.col("count_before")
    out = rows.withColumns({
        "status": status, "priority": priority, "reasons": F.array_compact(F.array(*reasons)), "frequency_component": F.when(parted, (F.col("count") - F.col("count_before")) * each),
        "per_call_component": F.when(parted, F.col("observed") - F.col("count") * each),
    })
    conclusion = F.when(F.col("priority") >= 2, "candidate").otherwise("insufficient_evidence").alias("conclusion")
    return out.select("metric", "role", "group_id", "status", "priority", "assessment", "cost_field", "cost_relation", "observed", "baseline", "delta", "frequency_component", "per_call_component", "reasons", conclusion)


def order_by_evidence(assessed: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` rows with the strongest evidence: priority, then growth."""
    return assessed.orderBy(F.desc("priority"), F.desc(F.greatest(F.coalesce("delta", F.lit(0.0)), F.lit(0.0))), "metric", "role", "group_id").limit(n)
