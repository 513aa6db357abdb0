"""Resource attribution: which statements ran while, and grew as, a resource metric rose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sql_template
from ..functions.series import pearson, sums_for_pearson

PERIOD_US = 60_000_000
LEAST_POINTS = 6
EXACT = "decimal(38,0)"


def complete_periods(start_us: int, end_us: int, period_us: int = PERIOD_US) -> tuple[int, int]:
    """First start and last end of the whole periods inside the window."""
    return -(-start_us // period_us) * period_us, end_us // period_us * period_us


def each_once(events: DataFrame) -> DataFrame:
    """``events``, each id of an instance once; a repeated id fails the query. Rows without an id are taken as they are.

    One shuffle by id, counted before it; the check is part of what the result is made of, so it can't be skipped.
    """
    keys = [c for c in ("instance_id", "event_id") if c in events.columns]
    rest = [c for c in events.columns if c not in keys]
    named = F.coalesce(F.col("event_id").cast("string"), F.lit("")) != ""
    once = events.filter(named).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_x"))
    repeated = F.raise_error(F.concat(F.lit("repeated event id: "), F.col("event_id").cast("string"))).cast("boolean")
    once = once.filter(F.when(F.col("_n") > 1, repeated).otherwise(F.lit(True)))
    return once.select(*keys, "_x.*").select(events.columns).unionByName(events.filter(~named))


def execution_series(events: DataFrame, start_us: int, end_us: int, period_us: int = PERIOD_US) -> DataFrame:
    """Microseconds that each statement family ran in each whole period, keyed by the period's end; concurrency adds up.

    ``events``: ``event_id, family, node_id, start_us, duration_us`` and where known ``instance_id``. An execution that starts outside the
    window, a negative duration and a repeated id are errors.
    """
    low, high = complete_periods(start_us, end_us, period_us)
    outside = (F.col("start_us") < start_us) | (F.col("start_us") >= end_us)
    refused = F.when(outside, F.raise_error(F.lit("an execution starts outside the window")).cast("bigint")).when(F.col("duration_us") < 0, F.raise_error(F.lit("negative duration")).cast("bigint"))
    checked = each_once(events).withColumn("duration_us", refused.otherwise(F.col("duration_us")))
    begin = F.greatest(F.col("start_us"), F.lit(low))
    end = F.least(F.col("start_us") + F.col("duration_us"), F.lit(high))
    clipped = checked.withColumns({"_a": begin, "_b": end}).filter("_a < _b")
    first, last = F.col("_a") - F.pmod("_a", F.lit(period_us)), F.col("_b") - 1 - F.pmod(F.col("_b") - 1, F.lit(period_us))
    spread = clipped.withColumn("_p", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(period_us).cast("bigint"))))
    overlap = F.least(F.col("_b"), F.col("_p") + period_us) - F.greatest(F.col("_a"), F.col("_p"))
    return spread.groupBy("node_id", "family", (F.col("_p") + period_us).alias("end_us")).agg(F.sum(overlap).cast("bigint").alias("runtime_us"), F.count(F.lit(1)).alias("executions"))


def _by_period(points: DataFrame, start_us: int, end_us: int, period_us: int) -> DataFrame:
    low, high = complete_periods(start_us, end_us, period_us)
    inside = points.filter((F.col("end_us") > low) & (F.col("end_us") <= high))
    return inside.groupBy("node_id", "end_us").agg(F.min("value").alias("value"), F.max("value").alias("most"))


def _by_node(per: DataFrame, start_us: int, end_us: int, period_us: int) -> DataFrame:
    """Per node in one pass: status, reference, and what a correlation needs; a node has one value for each period."""
    low, high = complete_periods(start_us, end_us, period_us)
    n = max(0, (high - low) // period_us)
    v = F.col("value").cast(EXACT)
    found = per.groupBy("node_id").agg(
        F.max(F.col("most") > F.col("value")).alias("conflict"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).alias("points"),
        F.element_at(F.array_sort(F.collect_list("value")), (F.floor((F.count(F.lit(1)) - 1) / 5) + 1).cast("int")).alias("reference"),
        F.sum(v).cast(EXACT).alias("vy"),
        F.sum((v * v).cast(EXACT)).cast(EXACT).alias("vyy"),
    )
    status = F.when(F.col("conflict"), "conflicting_samples").when(F.col("low") < 0, "negative_samples").when(F.lit(n) < LEAST_POINTS, "insufficient_minutes").when(F.col("points") < n, "metric_gaps").otherwise("ok")
    return found.select("node_id", status.alias("status"), "reference", "points", "vy", "vyy")


def metric_reference(points: DataFrame) -> DataFrame:
    """Per node the 20th percentile of its values: the sorted value at index floor((n - 1) / 5)."""
    values = points.groupBy("node_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return values.select("node_id", F.element_at("v", (F.floor((F.size("v") - 1) / 5) + 1).cast("int")).alias("reference"), F.size("v").alias("points"))


def metric_status(points: DataFrame, start_us: int, end_us: int, period_us: int = PERIOD_US) -> DataFrame:
    """Per node: ok, or why its metric cannot be used: conflicting, negative, too few periods, gaps."""
    return _by_node(_by_period(points, start_us, end_us, period_us), start_us, end_us, period_us).select("node_id", "status", "points")


def resource_overlap(series: DataFrame, points: DataFrame, start_us: int, end_us: int, period_us: int = PERIOD_US, reference: DataFrame | None = None) -> DataFrame:
    """Score of each family on each node: running time times how far the metric stood above its reference.

    ``points``: ``node_id, end_us, value`` with integer values (scaled). The reference is the window's own 20th
    percentile, or ``reference(node_id, reference)`` of the window before; a node without one scores 0 with a reason.
    The series is read once, the points twice.
    """
    per = _by_period(points, start_us, end_us, period_us)
    nodes = _by_node(per, start_us, end_us, period_us)
    if reference is not None:
        nodes = nodes.drop("reference").join(reference, "node_id", "left")
    nodes = nodes.withColumn("status", F.when((F.col("status") == "ok") & F.col("reference").isNull(), "metric_baseline_unavailable").otherwise(F.col("status")))
    above = per.join(nodes.filter("status = 'ok'").select("node_id", "reference"), "node_id").select("node_id", "end_us", "value", F.greatest(F.col("value") - F.col("reference"), F.lit(0)).alias("above"))
    x, y = F.col("runtime_us").cast(EXACT), F.col("value").cast(EXACT)
    used = F.when(F.col("value").isNotNull(), x)
    families = series.join(above, ["node_id", "end_us"], "left").groupBy("node_id", "family").agg(
        F.sum("runtime_us").cast(EXACT).alias("all"),
        F.sum((x * F.col("above").cast(EXACT)).cast(EXACT)).cast(EXACT).alias("score"),
        F.sum(used).cast(EXACT).alias("sx"),
        F.sum((used * used).cast(EXACT)).cast(EXACT).alias("sxx"),
        F.sum((x * y).cast(EXACT)).cast(EXACT).alias("sxy"),
    )
    everything = F.sum("score").over(Window.partitionBy("node_id"))
    r = pearson(F.col("points"), F.col("sx"), F.col("vy"), F.col("sxx"), F.col("vyy"), F.col("sxy"))
    return families.join(nodes, "node_id", "left").select(
        "node_id", "family", F.coalesce("status", F.lit("metric_missing")).alias("status"), F.coalesce("score", F.lit(0).cast(EXACT)).alias("score"), F.col("all").alias("runtime_us"),
        F.when(everything > 0, F.col("score").cast("double") / everything.cast("double")).alias("share"), r.alias("r"),
    )


def lock_free_us(overlap: Column, duration_us: Column, lock_us: Column) -> Column:
    """The share of an overlap that was not lock wait, the waits spread evenly; whole microseconds."""
    free = F.greatest(duration_us - F.least(F.coalesce(lock_us, F.lit(0)), duration_us), F.lit(0))
    return F.when(duration_us > 0, F.floor((overlap.cast(EXACT) * free.cast(EXACT)).cast(EXACT) / duration_us)).otherwise(0).cast("bigint")


def with_baseline(now: DataFrame, before: DataFrame, keys: list[str], costs: list[str]) -> DataFrame:
    """Current groups with the previous window's costs and the differences; unobserved is null, never zero."""
    old = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in costs], F.lit(True).alias("_seen"))
    out = now.join(old, keys, "left")
    return out.withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_before") for c in costs}).withColumn("baseline", F.coalesce("_seen", F.lit(False))).drop("_seen")


def family_costs(events: DataFrame) -> DataFrame:
    """What growth is measured on, per node and family: ``runtime_us, net_us`` (less lock wait), ``executions``, and for rows examined and
    lock time the sum of what is known and of how many executions it is known.

    ``events``: ``node_id, family, overlap_us`` (running time inside the window), ``duration_us, lock_time_us, rows_examined``.
    """
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    free = lock_free_us(F.col("overlap_us"), F.col("duration_us"), F.greatest(known("lock_time_us"), F.lit(0)))
    sums = [f(known(c)).alias(n) for c in ("rows_examined", "lock_time_us") for f, n in ((F.sum, c), (F.count, f"{c}_known"))]
    return events.groupBy("node_id", "family").agg(F.sum("overlap_us").alias("runtime_us"), F.sum(free).alias("net_us"), F.count(F.lit(1)).alias("executions"), *sums)


#: What every ranking is to be read with, and what is added for a reason. Fixed values.
WARNINGS = ("runtime_includes_waits", "scans_not_physical_iops", "index_coverage_not_source_completeness")
NO_BASELINE, VICTIM, NO_RISE = "missing_slow_baseline_not_zero", "lock_wait_increased_possible_victim", "resource_window_mean_not_increased"


def _with_known(costs: DataFrame) -> DataFrame:
    """Costs with the columns that the caller left out: net of nothing, known wherever there is a sum, no lock time."""
    have = set(costs.columns)
    out = costs if "net_us" in have else costs.withColumn("net_us", F.col("runtime_us"))
    for c in ("rows_examined", "lock_time_us"):
        if c not in have:
            out = out.withColumns({c: F.lit(None).cast("bigint"), f"{c}_known": F.lit(0).cast("bigint")})
        elif f"{c}_known" not in have:
            out = out.withColumn(f"{c}_known", F.when(F.col(c).isNotNull(), F.col("executions")).otherwise(0))
    return out


def growth_ranking(now: DataFrame, before: DataFrame, overlap: DataFrame, metric_rise: DataFrame | None = None) -> DataFrame:
    """Families by overlap in proportion to growth: score x max(0, net running time now - before) / running time now.

    ``now``/``before``: ``family_costs``; ``metric_rise``: ``node_id, delta`` of the resource's mean. A family that the baseline never saw
    has no growth: unobserved is not zero. Scan and lock differences count only where every execution of both sides has the value. Order: the exact
    fraction, then scan growth, then family; no rank without either. ``evidence`` says what the rank rests on, ``warnings`` what it doesn't.
    """
    costs = ["runtime_us", "net_us", "executions", "rows_examined", "rows_examined_known", "lock_time_us", "lock_time_us_known"]
    out = with_baseline(_with_known(now), _with_known(before), ["node_id", "family"], costs)
    out = out.join(overlap.select("node_id", "family", "score"), ["node_id", "family"], "left")
    grown = F.when(F.col("baseline"), F.greatest(F.col("net_us_delta"), F.lit(0))).otherwise(0)
    out = out.withColumns({"growth_us": grown.cast("bigint"), "score": F.coalesce("score", F.lit(0)).cast(EXACT)})
    for c in ("rows_examined", "lock_time_us"):
        whole = (F.col(f"{c}_known") == F.col("executions")) & (F.col(f"{c}_known_before") == F.col("executions_before"))
        out = out.withColumn(f"{c}_delta", F.when(whole, F.col(f"{c}_delta")))
    elapsed = F.greatest(F.col("runtime_us") - F.coalesce("runtime_us_before", F.lit(0)), F.lit(0))
    scan = F.col("rows_examined_delta")
    evidence = F.when(scan > 0, "scan_growth_related_evidence").when(scan.isNotNull(), "no_scan_growth").when(~F.col("baseline"), "baseline_shape_unobserved").otherwise("elapsed_overlap_only")
    out = out if metric_rise is None else out.join(metric_rise.select("node_id", F.col("delta").alias("_rise")), "node_id", "left")
    flat = F.lit(False) if metric_rise is None else F.col("_rise") <= 0
    told = [*map(F.lit, WARNINGS), F.when(~F.col("baseline"), NO_BASELINE), F.when(F.col("lock_time_us_delta") > 0, VICTIM), F.when(flat, NO_RISE)]
    out = out.withColumns({"lock_wait_excluded_us": F.greatest(elapsed - F.col("growth_us"), F.lit(0)), "evidence": evidence, "warnings": F.array_compact(F.array(*told))})
    ranked = _ranked_by_fraction(out.drop("_rise").withColumn("_scan", F.greatest(F.coalesce(scan, F.lit(0)), F.lit(0))))
    value = F.col("score").cast("double") * F.col("growth_us").cast("double") / F.greatest(F.col("runtime_us"), F.lit(1)).cast("double")
    everything = F.sum("final_score").over(Window.partitionBy("node_id"))
    return ranked.withColumn("final_score", value).withColumn("share", F.when(everything > 0, F.col("final_score") / everything)).drop("_scan")


def growth_status(ranked: DataFrame) -> DataFrame:
    """Per node whether growth explains anything: ok, only scan growth without overlap, or nothing."""
    scan, total = F.coalesce(F.max(F.col("rows_examined_delta") > 0), F.lit(False)), F.coalesce(F.sum("final_score"), F.lit(0.0))
    status = F.when(total > 0, "ok").when(scan, "scan_growth_without_overlap").otherwise("no_growth_overlap")
    return ranked.groupBy("node_id").agg(status.alias("status"))


def _divided(x: Column, d: Column) -> tuple[Column, Column]:
    """Whole quotient (below 10^31) and remainder of whole decimals."""
    rest = (x % d).cast(EXACT)
    return ((x - rest).cast(EXACT) / d).cast(EXACT), rest


def _digits(score: Column, growth: Column, runtime: Column) -> list[Column]:
    """The fraction score x growth / runtime as two groups of 19 digits before and three of 18 behind the point, for whole numbers
    with score < 10^38 and growth, runtime < 2^63.

    Two such fractions that differ do so by more than 10^-38, so equal digits mean equal fractions. Every product stays below
    10^38: growth = k runtime + g, so the fraction is score k, kept in two groups, and score g / runtime; there, with score = a runtime + b,
    it is a g + b g / runtime, where a g <= score and b g < runtime^2.
    """
    whole_number = lambda c: c.cast(EXACT)
    base, group = whole_number(F.lit(str(10**19))), whole_number(F.lit(str(10**18)))
    k, g = _divided(growth, runtime)
    high, low = _divided(score, base)
    a_high, left = _divided(high, runtime)
    a_low, b = _divided(whole_number(whole_number(left * base) + low), runtime)
    a = whole_number(whole_number(a_high * base) + a_low)
    whole, rest = _divided(whole_number(b * g), runtime)
    whole_high, whole_low = _divided(whole_number(whole_number(a * g) + whole), base)
    carry, second = _divided(whole_number(whole_number(low * k) + whole_low), base)
    out = [whole_number(whole_number(whole_number(high * k) + whole_high) + carry), second]
    for _ in range(3):
        digits, rest = _divided(whole_number(rest * group), runtime)
        out.append(digits)
    return out


def _ranked_by_fraction(rows: DataFrame) -> DataFrame:
    """``rank`` by the exact fraction, then ``_scan``, then family; null where fraction and ``_scan`` are zero."""
    runtime = F.greatest(F.col("runtime_us"), F.lit(1)).cast(EXACT)
    parts = {f"_d{n}": c for n, c in enumerate(_digits(F.col("score").cast(EXACT), F.col("growth_us").cast(EXACT), runtime))}
    rows = rows.withColumns(parts)
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy(*[F.desc(c) for c in parts], F.desc("_scan"), "family"))
    some = (F.col("score") > 0) & (F.col("growth_us") > 0)
    return rows.withColumn("rank", F.when(some | (F.col("_scan") > 0), nth)).drop(*parts)


def fraction_rank(ranked: DataFrame) -> DataFrame:
    """The rank of each family of a node by the exact fraction score x growth / running time, also beyond 38 digits.

    ``ranked``: ``node_id, family, score, growth_us, runtime_us, scan`` (integers; score as decimal). Order and rank as in ``growth_ranking``.
    """
    rows = ranked.withColumn("_scan", F.greatest(F.coalesce("scan", F.lit(0)), F.lit(0)))
    return _ranked_by_fraction(rows).select("node_id", "family", "rank")


def assign_families(events: DataFrame) -> DataFrame:
    """Statement families: (database, sql id or fingerprint), merged where two or more share a template in a database.

    ``events``: ``database_name, sql_id, fingerprint, normalized_sql``.
    """
    own = F.when(F.col("sql_id") != "", F.col("sql_id")).otherwise(F.col("fingerprint"))
    marked = events.withColumns({"_own": own, "_template": sql_template(F.col("normalized_sql"))})
    members = marked.filter("database_name <> '' AND _template <> ''").groupBy("database_name", "_template").agg(F.count_distinct("_own").alias("_members"))
    name = F.substring(F.sha1(F.concat(F.col("database_name"), F.lit("\n"), F.col("_template"))), 1, 16)
    out = marked.join(members, ["database_name", "_template"], "left")
    return out.withColumn("family", F.when(F.col("_members") >= 2, name).otherwise(F.concat_ws("/", "database_name", "_own"))).drop("_own", "_template", "_members")


def lag_increase(points: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """Growth of lag since the point one period before; without that point there is no value."""
    w = Window.partitionBy("node_id").orderBy("end_us")
    gap = F.col("end_us") - F.lag("end_us").over(w)
    out = points.withColumns({"_gap": gap, "_last": F.lag("value").over(w)})
    return out.filter(F.col("_gap") == period_us).select("node_id", "end_us", F.greatest(F.col("value") - F.col("_last"), F.lit(0)).alias("value"))


MAX_REPLICAS = 1000


def lag_candidates(events: DataFrame, primaries: list[str], replicas: DataFrame) -> DataFrame:
    """The primary's statements once per replica, as candidates for the replica's lag; more than ``MAX_REPLICAS`` replicas are refused."""
    nodes = sorted(r.node_id for r in replicas.select("node_id").distinct().limit(MAX_REPLICAS + 1).collect())
    if len(nodes) > MAX_REPLICAS:
        raise ValueError(f"more than {MAX_REPLICAS} replicas")
    own = events.filter(F.col("node_id").isin(primaries)).withColumn("origin", F.lit("primary")).drop("node_id")
    each = F.explode(F.array(*map(F.lit, nodes)).cast("array<string>"))
    return own.withColumn("node_id", each).withColumn("event_id", F.concat_ws("@", "event_id", "node_id"))


def align(series: DataFrame, metric: DataFrame) -> DataFrame:
    """Series and metric where both were observed."""
    return series.join(metric, ["node_id", "end_us"])


def dense_r(series: DataFrame, metric: DataFrame, grid: DataFrame) -> DataFrame:
    """Correlation of each family's running time with its node's metric (one value a period) over the periods of ``grid(end_us)`` that have a
    metric; a family that didn't run counts as zero. ``node_id, family, n, r``.

    Zeros add nothing to the sums, so no grid of families and periods is laid out: what depends on the metric alone is summed once per node.
    """
    known = metric.join(grid.select("end_us").distinct(), "end_us", "left_semi").filter("value IS NOT NULL")
    x, y = F.col("runtime_us").cast(EXACT), F.col("value").cast(EXACT)
    whole = lambda c, name: F.sum(c.cast(EXACT)).cast(EXACT).alias(name)
    nodes = known.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), whole(y, "sy"), whole(y * y, "syy"))
    ran = series.join(known, ["node_id", "end_us"]).groupBy("node_id", "family").agg(whole(x, "sx"), whole(x * x, "sxx"), whole(x * y, "sxy"))
    out = series.select("node_id", "family").distinct().join(ran, ["node_id", "family"], "left").join(nodes, "node_id", "left")
    sums = [F.coalesce(F.col(c), F.lit(0).cast(EXACT)) for c in ("sx", "sy", "sxx", "syy", "sxy")]
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return out.select("node_id", "family", n.alias("n"), F.when(n >= LEAST_POINTS, pearson(n, *sums)).alias("r"))


def node_evidence(points: DataFrame, before: DataFrame) -> DataFrame:
    """Mean of each counter per node in the window and the one before, and the difference."""

    def mean(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("node_id", "metric").agg(F.avg("value").alias(name), F.count(F.lit(1)).alias(f"{name}_points"))

    return mean(points, "now").join(mean(before, "before"), ["node_id", "metric"], "left").withColumn("change", F.col("now") - F.col("before"))


def exact_r(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    sums = df.groupBy(*keys).agg(*sums_for_pearson(F.col(x), F.col(y)))
    return sums.select(*keys, "n", F.when(F.col("n") >= LEAST_POINTS, pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])).alias("r"))


def lead_statement_type(evidence: DataFrame, least_share: float = 0.2, least_rise: float = 50.0) -> DataFrame:
    """Per node the statement counter that rose most, if it rose by a fifth and by 50 a second: ``node_evidence`` rows."""
    risen = evidence.filter((F.col("change") >= least_rise) & (F.col("change") >= least_share * F.col("before")))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("change"), "metric"))
    return risen.withColumn("_n", nth).filter("_n = 1").drop("_n")


def explained_share(evidence: DataFrame, added_concurrency: DataFrame, metric: str = "threads_running") -> DataFrame:
    """How much of a node's rise in running threads the slow log's added concurrency accounts for; needs a rise of one."""
    rise = evidence.filter((F.col("metric") == metric) & (F.col("change") >= 1)).select("node_id", F.col("change").alias("rise"))
    return rise.join(added_concurrency, "node_id", "left").select("node_id", "rise", "added", (F.col("added") / F.col("rise")).alias("share"))
