"""Replication lag: episodes and their origins, statements held back, triggers, health among peers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import overlapping, stab
from ..functions.scans import scan
from ..functions.series import islands
from ..functions.windows import split_windows

MINUTE_US = 60_000_000
LAGGING_S, CALM_S, SLOPE = 30.0, 0.5, 0.85


def lag_episodes(samples: DataFrame, step_us: int = MINUTE_US, width_us: int | None = None) -> DataFrame:
    """Episodes of lag per node from ``instance_id, node_id, end_us, lag_s``: from 30 s on, grown back while lag rose and on
    until it was calm. A stall is a run of minutes in which lag grew with the clock, of one origin.

    Of two samples of one time the larger counts. A node's samples, ``step_us`` apart, are scanned in bins of ``width_us`` (a day); after that only
    the samples of one run of lag meet. One row per episode: ``kind`` (stall, behind, spike), ``start_us, end_us, peak_s, peak_us``, median
    ``growth`` and ``recovery`` in seconds a second, and ``origin_us`` and ``release_us`` of a stall.
    """
    width = width_us or 1440 * step_us
    node = ["instance_id", "node_id"]
    per = samples.groupBy(*node, "end_us").agg(F.max("lag_s").cast("double").alias("lag_s"))
    rows = scan(per, node, ["end_us"], width, before=(F.struct("end_us", "lag_s"), "previous"))
    follows = F.coalesce((F.col("end_us") - F.col("before.end_us") == step_us) & (F.col("before.lag_s") > CALM_S), F.lit(False))
    high = F.col("lag_s") > CALM_S
    begins = F.when(high & ~follows, F.col("end_us"))
    rising = F.when(~(follows & (F.col("before.lag_s") <= F.col("lag_s"))), F.col("end_us"))
    rows = scan(rows.filter(high | follows), node, ["end_us"], width, run=(begins, "mark"), rise=(rising, "mark"))
    run = [*node, "run"]
    all_of = Window.partitionBy(*run)
    reached = F.when(F.col("lag_s") >= LAGGING_S, F.col("end_us"))
    rows = rows.withColumn("start_us", F.min_by("rise", reached).over(all_of)).filter("end_us >= start_us")
    rows = rows.withColumn("peak_us", F.max_by("end_us", F.struct("lag_s", -F.col("end_us"))).over(all_of))
    inner = F.col("end_us") > F.col("start_us")
    slope = F.when(inner, (F.col("lag_s") - F.col("before.lag_s")) / F.lit(step_us / 1e6))
    steep = F.coalesce(slope >= SLOPE, F.lit(False))
    rows = rows.withColumns({"slope": slope, "steep": steep}).withColumn("climb", F.sum((~F.col("steep")).cast("int")).over(all_of.orderBy("end_us")))
    climbs = rows.filter("steep").groupBy(*run, "climb").agg(F.count(F.lit(1)).alias("n"), F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us")).filter("n >= 2")
    longest = climbs.groupBy(*run).agg(F.max_by(F.struct((F.col("first_us") - step_us).alias("from_us"), F.col("last_us").alias("to_us")), F.struct("n", -F.col("first_us"))).alias("stall"))
    up = F.col("end_us") <= F.col("peak_us")
    episodes = rows.groupBy(*run).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("lag_s").alias("peak_s"), F.min("peak_us").alias("peak_us"), F.count(F.lit(1)).alias("minutes"),
        F.percentile(F.when(up, F.col("slope")), F.lit(0.5)).alias("growth"), F.percentile(F.when(~up, F.col("slope")), F.lit(0.5)).alias("recovery"),
    )
    inside = rows.join(longest, run).filter("end_us BETWEEN stall.from_us AND stall.to_us")
    origin = F.col("end_us") - 30_000_000 - F.col("lag_s") * 1e6
    inside = inside.select(*run, "stall", origin.alias("origin"))
    middle = inside.groupBy(*run).agg(F.percentile("origin", F.lit(0.5)).alias("middle"))
    near = inside.join(middle, run).filter(F.abs(F.col("origin") - F.col("middle")) <= 60e6)
    stalls = near.groupBy(*run).agg(F.percentile("origin", F.lit(0.5)).cast("bigint").alias("origin_us"), F.first("stall.to_us").alias("release_us"), F.count(F.lit(1)).alias("points")).filter("points >= 3")
    kind = F.when(F.col("origin_us").isNotNull(), "stall").when(F.col("minutes") >= 3, "behind").otherwise("spike")
    out = episodes.join(stalls, run, "left").withColumn("kind", kind)
    return out.select(*node, "kind", "start_us", "end_us", "peak_s", "peak_us", "growth", "recovery", "origin_us", "release_us")


def nearest_within(left: DataFrame, right: DataFrame, tolerance_us: int, keys: list[str], at: str = "at_us") -> DataFrame:
    """For each row of ``left`` the row of ``right`` nearest in time, before or after, within the tolerance; the earlier at ties.

    Time is cut into bins as wide as the tolerance. The nearest rows before and after lie in the row's own bin, where one
    window over both sides finds them, or are the last of the bin before and the first of the bin behind, which come from
    one row for each bin. No pairs are made, however many rows a bin has.
    """
    width = max(1, tolerance_us)
    number = F.floor(F.col(at) / width).alias("_bin")
    rest = [c for c in left.columns if c not in keys]
    l = left.select(*keys, number, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rest).alias("_l"), F.lit(None).cast(right.schema.simpleString()).alias("_r"))
    r = right.select(*keys, number, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(*rest).schema.simpleString()).alias("_l"), F.struct(*right.columns).alias("_r"))
    ends = r.groupBy(*keys, "_bin").agg(F.min_by("_r", "_at").alias("_first"), F.max_by("_r", "_at").alias("_last"))
    w = Window.partitionBy(*keys, "_bin").orderBy("_at", "_side")
    before = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    own = l.unionByName(r).withColumns({"_before": before, "_after": after}).filter("_side = 1")
    own = own.join(ends.select(*keys, (F.col("_bin") + 1).alias("_bin"), "_last"), [*keys, "_bin"], "left")
    own = own.join(ends.select(*keys, (F.col("_bin") - 1).alias("_bin"), "_first"), [*keys, "_bin"], "left")

    def candidate(c: str) -> Column:
        apart = F.abs(F.col("_at") - F.col(c)[at])
        return F.when(F.col(c).isNotNull() & (apart <= tolerance_us), F.struct(apart.alias("apart"), F.col(c)[at].alias("at"), F.col(c).alias("row")))

    found = F.array_compact(F.array(*[candidate(c) for c in ("_before", "_after", "_last", "_first")]))
    best = F.reduce(found, F.get(found, F.lit(0)), lambda a, b: F.when((b["apart"] < a["apart"]) | ((b["apart"] == a["apart"]) & (b["at"] < a["at"])), b).otherwise(a))
    return own.withColumn("_best", best).filter("_best IS NOT NULL").select(*keys, "_l.*", F.col("_best.row").alias("near"))


def held_statements(events: DataFrame, episodes: DataFrame, least_us: int = 60_000_000, slack_us: int = 90_000_000, samples: int = 5) -> DataFrame:
    """Statements of 60 s or more that ended within 90 s of a stall's release: queued behind it, or possible holders.

    Time is cut into bins as wide as the slack. The stalls of a bin and its neighbours meet the bin's statements in one task, where a merge sort
    tree finds counts and samples, without a row for each pair. Stalls of one time are asked once and count as often as there are.
    """
    keys = ["instance_id", "node_id", "origin_us", "role"]
    place = ["instance_id", "node_id", "_bin"]
    most = F.greatest(F.lit(slack_us), F.lit(1))
    stalls = episodes.filter("kind = 'stall'").groupBy("instance_id", "node_id", "origin_us", "release_us").agg(F.count(F.lit(1)).alias("_times"))
    asked = stalls.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("release_us") / most) + d for d in (-1, 0, 1)])))
    asked = asked.filter("instance_id IS NOT NULL AND node_id IS NOT NULL AND _bin IS NOT NULL")
    long = events.filter(F.col("duration_us") >= least_us).withColumn("_end", F.col("start_us") + F.col("duration_us"))
    long = long.select("instance_id", "node_id", F.floor(F.col("_end") / most).alias("_bin"), "_end", "start_us", "duration_us", "event_id").filter("_bin IS NOT NULL")
    kinds = dict(asked.dtypes) | dict(long.dtypes)
    schema = f"instance_id {kinds['instance_id']}, node_id {kinds['node_id']}, origin_us {kinds['origin_us']}, role string, statements long, samples array<struct<least: bigint, event_id: {kinds['event_id']}>>"

    def met(rows: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or windows.empty:
            return pd.DataFrame(columns=["instance_id", "node_id", "origin_us", "role", "statements", "samples"])
        rows = rows.sort_values(["duration_us", "event_id"], ascending=[False, True])
        release, known = windows["release_us"].to_numpy("int64"), windows["origin_us"].notna().to_numpy()
        bound = np.where(known, windows["origin_us"].fillna(0).to_numpy("int64") - slack_us, np.iinfo(np.int64).max)
        counts, first = split_windows(rows["_end"].to_numpy("int64"), rows["start_us"].to_numpy("int64"), release - slack_us, release + slack_us, bound, samples)
        took, names = rows["duration_us"].to_numpy("int64"), rows["event_id"].to_numpy()
        instance, node = rows["instance_id"].iloc[0], rows["node_id"].iloc[0]
        out = []
        for w, (origin, times) in enumerate(zip(windows["origin_us"].to_numpy(), windows["_times"].to_numpy(), strict=True)):
            for side, role in enumerate(("possible_holder", "queued")):
                if counts[w, side]:
                    found = [{"least": -took[n], "event_id": names[n]} for n in first[w, side] if n < len(names) for _ in range(min(times, samples))]
                    out.append((instance, node, int(origin) if known[w] else None, role, counts[w, side] * times, found[:samples]))
        return pd.DataFrame(out, columns=["instance_id", "node_id", "origin_us", "role", "statements", "samples"])

    parts = long.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(met, schema)
    whole = parts.groupBy(*keys).agg(F.sum("statements").alias("statements"), F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, samples).alias("_found"))
    return whole.select(*keys, "statements", F.transform("_found", lambda x, n: F.struct((n + 1).alias("_n"), x["event_id"].alias("event_id"))).alias("samples"))


def describe_lag(episodes: DataFrame, ddl: DataFrame, top: int = 3) -> DataFrame:
    """The worst episodes per instance, with the DDL nearest a stall's origin (within 90 s) and whether other nodes
    lagged too."""
    stalls = episodes.filter("origin_us IS NOT NULL").select("instance_id", "node_id", "start_us", F.col("origin_us").alias("at_us"))
    trigger = nearest_within(stalls, ddl.select("instance_id", F.col("event_epoch_us").alias("at_us"), "event_id"), 90_000_000, ["instance_id"])
    trigger = trigger.select("instance_id", "node_id", "start_us", F.col("near.event_id").alias("ddl_event"), (F.col("near.at_us") - F.col("at_us")).alias("ddl_distance_us"))
    spans = episodes.select("instance_id", "node_id", "peak_s", F.col("start_us").alias("lo"), (F.col("end_us") + 1).alias("hi"))
    nodes = {"_least": (F.col("node_id"), "min"), "_most": (F.col("node_id"), "max")}
    around = overlapping(spans, spans.filter(F.col("peak_s") >= LAGGING_S), ["instance_id"], "lo", "hi", nodes)
    around = around.select("instance_id", F.col("lo").alias("start_us"), (F.col("hi") - 1).alias("end_us"), "_least", "_most")
    out = episodes.join(trigger, ["instance_id", "node_id", "start_us"], "left").join(around, ["instance_id", "start_us", "end_us"], "left").select(*episodes.columns, "ddl_event", "ddl_distance_us", "_least", "_most")
    local = (F.col("_least") == F.col("node_id")) & (F.col("_most") == F.col("node_id"))
    out = out.withColumn("node_local", F.coalesce(local, F.lit(True))).drop("_least", "_most")
    rank = F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("peak_s"), "start_us", "node_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top)


def episode_windows(episodes: DataFrame, lead_us: int = 300_000_000, width_us: int = 300_000_000) -> DataFrame:
    """Windows for the write context of episodes that are no stalls: from 5 minutes before, on bucket edges."""
    low, high = F.col("start_us") - lead_us, F.col("end_us")
    return episodes.filter("kind <> 'stall'").select("instance_id", "node_id", "start_us", "end_us", (low - F.pmod(low, F.lit(width_us))).alias("window_start_us"), (high + F.pmod(-high, F.lit(width_us))).alias("window_end_us"))


def episode_writes(episodes: DataFrame, agg: DataFrame, n: int = 5, lead_us: int = 300_000_000, width_us: int = 300_000_000) -> DataFrame:
    """The ``n`` tables most written in each episode's window, with their events in the equal window before (null if none there).

    ``agg``: ``changes.agg_5m`` with ``instance_id``, in buckets of ``width_us``. Windows become buckets, so it is an equi join.
    """
    length = F.col("window_end_us") - F.col("window_start_us")
    buckets = F.sequence(F.col("window_start_us") - length, F.col("window_end_us") - width_us, F.lit(width_us))
    spread = episode_windows(episodes, lead_us, width_us).withColumn("bucket_us", F.explode(buckets))
    rows = agg.filter("table_name <> '*'").groupBy("instance_id", "bucket_us", "database_name", "table_name").agg(F.sum("row_events").alias("_rows"))
    inside = F.col("bucket_us") >= F.col("window_start_us")
    keys = ["instance_id", "node_id", "start_us", "end_us", "window_start_us", "window_end_us"]
    found = spread.join(rows, ["instance_id", "bucket_us"]).groupBy(*keys, "database_name", "table_name").agg(F.sum(F.when(inside, F.col("_rows"))).alias("row_events"), F.sum(F.when(~inside, F.col("_rows"))).alias("row_events_before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("row_events"), "database_name", "table_name"))
    return found.filter("row_events IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= n)


def peer_health(series: DataFrame, least_reads: float = 50.0, removed_share: float = 0.05) -> DataFrame:
    """Per node and minute: usable, removed or unknown, by its read rate against the median of its peers.

    ``series``: ``instance_id, node_id, end_us, reads, slow``. Peers must read 50 a second or more for a verdict.
    """
    a, b = series.alias("a"), series.alias("b")
    peers = (F.col("a.instance_id") == F.col("b.instance_id")) & (F.col("a.end_us") == F.col("b.end_us")) & (F.col("a.node_id") != F.col("b.node_id"))
    joined = a.join(b, peers, "left").groupBy("a.instance_id", "a.node_id", "a.end_us").agg(F.first("a.reads").alias("reads"), F.first("a.slow").alias("slow"), F.expr("percentile(b.reads, 0.5)").alias("peer_reads"), F.expr("percentile(b.slow / nullif(b.reads, 0), 0.5)").alias("peer_ratio"))
    status = F.when(F.col("reads").isNull() | F.col("peer_reads").isNull() | (F.col("peer_reads") < least_reads), "unknown").when(F.col("reads") < removed_share * F.col("peer_reads"), "removed").otherwise("usable")
    return joined.withColumn("status", status)


def removed_intervals(health: DataFrame, period_us: int = MINUTE_US, least: int = 3, listed: int = 8) -> DataFrame:
    """When a node was taken out of routing: its last ``listed`` runs of ``removed`` minutes, a hole of one minute allowed, of ``least`` or more.

    ``health``: as ``peer_health`` returns it. One row per run: ``start_us`` (where its first minute begins), ``end_us, minutes``.
    """
    removed = health.filter("status = 'removed'")
    runs = islands(removed, ["instance_id", "node_id"], "end_us", F.col("end_us") - F.col("prev") <= 2 * period_us, width=1440 * period_us)
    spans = runs.groupBy("instance_id", "node_id", "run").agg((F.min("end_us") - period_us).alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("minutes")).filter(F.col("minutes") >= least)
    nth = F.row_number().over(Window.partitionBy("instance_id", "node_id").orderBy(F.desc("end_us")))
    return spans.withColumn("_n", nth).filter(F.col("_n") <= listed).drop("_n", "run")


#: What a node is compared by, from sums or means over its usable minutes, and to how many digits it is told.
PEER_RATIOS = {"slow_per_1000_reads": ("slow", "reads", 2), "ms_per_read": ("threads", "reads", 2)}
PEER_MEANS = {"reads_per_s": ("reads", 0), "cpu_pct": ("cpu", 1), "iops_pct": ("iops", 1)}
LEAST_READ_MINUTES, LEAST_SLOW, SLOW_FACTOR, SLOW_FLOOR = 5, 60, 3.0, 0.05


def peer_evidence(series: DataFrame, health: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each node with episodes against its peers over its usable minutes in them: ``status`` (ok, no_reads), ``diverged``, and for each measure
    a struct of ``node``, median of the ``peers`` and their ``ratio``, rounded; null where a side has no value.

    ``series``: ``instance_id, node_id, end_us, reads, slow, threads, cpu, iops``. Peers are measured over the node's minutes. A node is joined with
    the nodes of its instance minute by minute, which are a handful.
    """
    spans = episodes.select("instance_id", "node_id", F.col("start_us").alias("_lo"), (F.col("end_us") + 1).alias("_hi"))
    inside = stab(health, spans, ["instance_id", "node_id"], "end_us", "_lo", "_hi", {"_n": (F.lit(1), "sum")})
    minutes = health.select("instance_id", "node_id", "end_us", "status").join(inside, ["instance_id", "node_id", "end_us"])
    counted = minutes.groupBy("instance_id", "node_id").agg(F.count(F.lit(1)).alias("minutes"), F.count_if(F.col("status") == "usable").alias("read_minutes"))
    usable = minutes.filter("status = 'usable'").select("instance_id", "node_id", "end_us")
    others = series.withColumnRenamed("node_id", "_other")
    pairs = usable.join(others, ["instance_id", "end_us"])

    def of_sums(top: str, bottom: str) -> Column:
        both = F.col(top).isNotNull() & F.col(bottom).isNotNull()
        upper, lower = (F.sum(F.when(both, F.col(c).cast("double"))) for c in (top, bottom))
        return F.when(lower > 0, upper / lower * 1000)

    values = {**{n: of_sums(a, b) for n, (a, b, _) in PEER_RATIOS.items()}, **{n: F.avg(c) for n, (c, _) in PEER_MEANS.items()}}
    each = pairs.groupBy("instance_id", "node_id", "_other").agg(*[v.alias(n) for n, v in values.items()], F.sum(F.coalesce(F.col("slow"), F.lit(0)) * 60).alias("_slow"))
    own = F.col("_other") == F.col("node_id")
    sides = [f for n in values for f in (F.max(F.when(own, F.col(n))).alias(f"{n}_own"), F.percentile(F.when(~own, F.col(n)), F.lit(0.5)).alias(f"{n}_peers"))]
    found = each.groupBy("instance_id", "node_id").agg(*sides, F.max(F.when(own, F.col("_slow"))).alias("_slow"))
    out = counted.join(found, ["instance_id", "node_id"], "left").withColumn("status", F.when(F.col("read_minutes") < LEAST_READ_MINUTES, "no_reads").otherwise("ok"))
    digits = {n: d for n, (*_, d) in [*PEER_RATIOS.items(), *PEER_MEANS.items()]}
    told = {}
    for n in values:
        node, peers = F.col(f"{n}_own"), F.col(f"{n}_peers")
        against = F.greatest(peers, F.lit(SLOW_FLOOR)) if n == "slow_per_1000_reads" else peers
        row = F.struct(F.bround(node, digits[n]).alias("node"), F.bround(peers, digits[n]).alias("peers"), F.when(against > 0, F.bround(node / against, 2)).alias("ratio"))
        told[n] = F.when((F.col("status") == "ok") & node.isNotNull() & peers.isNotNull(), row)
    out = out.withColumns(told)
    slower = (F.col("_slow") >= LEAST_SLOW) & (F.col("slow_per_1000_reads.ratio") >= SLOW_FACTOR)
    return out.select("instance_id", "node_id", "status", "minutes", "read_minutes", F.when(F.col("status") == "ok", F.coalesce(slower, F.lit(False))).alias("diverged"), *values)


def diverged_since(health: DataFrame, factor: float = 3.0, least_slow: int = 60, tolerance_us: int = 2 * MINUTE_US) -> DataFrame:
    """Since when a node was slower than its peers: over 5 usable minutes, slow per read at least three times the peers'
    median, with 60 slow statements; holes of two minutes do not break the run. One row per node: its last run."""
    usable = health.filter("status = 'usable'")
    w = Window.partitionBy("instance_id", "node_id").orderBy("end_us").rowsBetween(-4, 0)
    rolled = usable.select("instance_id", "node_id", "end_us", F.sum("slow").over(w).alias("s"), F.sum("reads").over(w).alias("r"), F.avg("peer_ratio").over(w).alias("p"))
    bad = rolled.filter((F.col("s") >= least_slow) & (F.col("s") / F.col("r") >= factor * F.col("p")))
    runs = islands(bad, ["instance_id", "node_id"], "end_us", F.col("end_us") - F.col("prev") <= MINUTE_US + tolerance_us, width=1440 * MINUTE_US)
    spans = runs.groupBy("instance_id", "node_id", "run").agg(F.min("end_us").alias("since_us"), F.max("end_us").alias("until_us"))
    return spans.groupBy("instance_id", "node_id").agg(F.max_by("since_us", "run").alias("since_us"), F.max("until_us").alias("until_us"))


def readless_runs(series: DataFrame, least_minutes: int = 3) -> DataFrame:
    """Runs of three or more minutes without reads, a hole of one minute allowed."""
    quiet = series.filter("reads = 0")
    runs = islands(quiet, ["instance_id", "node_id"], "end_us", F.col("end_us") - F.col("prev") <= 2 * MINUTE_US, width=1440 * MINUTE_US)
    return runs.groupBy("instance_id", "node_id", "run").agg(F.min("end_us").alias("first_us"), F.max("end_us").alias("last_us"), F.count(F.lit(1)).alias("minutes")).filter(F.col("minutes") >= least_minutes).drop("run")


def estimate_rows(plans: DataFrame) -> DataFrame:
    """Row estimate of an execution plan: per select, sum over its steps of rows times the earlier steps' kept rows.

    ``plans``: ``plan_id, select_id, step, rows, filtered (percent, null = 100), access``.
    """
    kept = F.col("rows") * F.coalesce(F.col("filtered"), F.lit(100.0)) / 100
    ordered = F.array_sort(F.collect_list(F.struct("step", F.col("rows").cast("double").alias("rows"), kept.cast("double").alias("kept"))))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("fan"))
    per = plans.groupBy("plan_id", "select_id").agg(ordered.alias("s"), F.max(F.upper("access").isin("ALL", "INDEX")).alias("full"))
    summed = F.aggregate("s", start, lambda a, x: F.struct((a["total"] + a["fan"] * x["rows"]).alias("total"), (a["fan"] * x["kept"]).alias("fan")))
    folded = per.select("plan_id", "full", summed["total"].alias("rows"))
    return folded.groupBy("plan_id").agg(F.least(F.sum("rows"), F.lit(9.0e18)).cast("bigint").alias("est_rows"), F.max("full").alias("full_scan"))
