"""Coverage, gaps, freshness, and verification of results and parts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import overlapping, stab
from ..functions.scans import scan
from ..functions.series import merge_intervals, subtract_intervals
from ..functions.storage import scratch_folder, stored

SECOND = 1_000_000


def part_catalog(df: DataFrame) -> DataFrame:
    """Per part and date: lower-case databases and tables, operations, span and rows."""
    return df.groupBy("_source_part_key", "event_date").agg(
        F.array_sort(F.collect_set(F.lower("database_name"))).alias("databases"),
        F.array_sort(F.collect_set(F.lower("table_name"))).alias("tables"),
        F.array_sort(F.collect_set(F.upper("operation"))).alias("operations"),
        F.min("event_epoch_us").alias("first_us"),
        F.max("event_epoch_us").alias("last_us"),
        F.count(F.lit(1)).alias("rows"),
    )


def missing_parts(expected: DataFrame, ready: DataFrame, identity: str = "sha256") -> DataFrame:
    """Expected parts that are not ready; one with a stale identity counts as missing."""
    return expected.join(ready.select("path", identity), ["path", identity], "left_anti")


def covered_spans(files: DataFrame, ingested: DataFrame, tolerance_us: int = 2 * SECOND) -> DataFrame:
    """Union per instance of the spans of ingested files, those of other hosts included; a point lasts a second."""
    spans = files.join(ingested.select("id").distinct(), "id", "left_semi").select("instance_id", "lo", F.greatest("hi", F.col("lo") + SECOND).alias("hi"))
    return merge_intervals(spans, ["instance_id"], tolerance=tolerance_us)


def coverage_runs(files: DataFrame, ingested: DataFrame, start_us: int, end_us: int, tolerance_us: int = 2 * SECOND) -> DataFrame:
    """Runs of the window per instance with a reason: covered, or why not, by what the files not ingested say.

    ``files``: ``id, instance_id, lo, hi, state`` (done, collecting, pending, missing). A gap of which no file tells is
    ``source_unlisted`` between known files, ``not_collected_yet`` after the last, ``no_data`` where there is none.
    """
    covered = covered_spans(files, ingested, tolerance_us)
    clip = [F.greatest("lo", F.lit(start_us)).alias("lo"), F.least("hi", F.lit(end_us)).alias("hi")]
    inside = covered.select("instance_id", *clip).filter("lo < hi")
    window = files.select("instance_id").distinct().select("instance_id", F.lit(start_us).alias("lo"), F.lit(end_us).alias("hi"))
    # what is read several times below is stored, else the driver plans it anew for each
    folder = scratch_folder(files.sparkSession)
    inside = stored(inside, folder, "inside")
    gaps = stored(subtract_intervals(window, inside, ["instance_id"]), folder, "gaps")
    waiting = files.join(ingested.select("id").distinct(), "id", "left_anti").select("instance_id", "lo", F.greatest("hi", F.col("lo") + SECOND).alias("hi"), "state")
    states = {f"_{x}": ((F.col("state") == x).cast("int"), "max") for x in ("missing", "collecting", "pending")}
    told = overlapping(gaps, waiting, ["instance_id"], "lo", "hi", states).select("instance_id", "lo", "hi", *[(F.col(c) == 1).alias(c) for c in states])
    last = files.groupBy("instance_id").agg(F.max("hi").alias("_last"), F.min("lo").alias("_first"))
    hit = gaps.join(stored(told, folder, "told"), ["instance_id", "lo", "hi"], "left").join(last, "instance_id", "left")
    reason = (
        F.when(F.col("_missing"), "source_missing")
        .when(F.col("_collecting"), "collecting")
        .when(F.col("_pending"), "pending")
        .when(F.col("lo") >= F.col("_last"), "not_collected_yet")
        .when(F.col("hi") <= F.col("_first"), "no_data")
        .otherwise("source_unlisted")
    )
    out = hit.select("instance_id", "lo", "hi", reason.alias("reason"))
    return inside.select("instance_id", "lo", "hi", F.lit("covered").alias("reason")).unionByName(out).withColumn("span_us", F.col("hi") - F.col("lo"))


def sequence_holes(files: DataFrame) -> DataFrame:
    """Numbers missing between neighbouring files of a host, from the digits at the end of their names."""
    numbered = files.withColumn("_n", F.regexp_extract("log_file_name", r"(\d+)$", 1).cast("bigint")).filter("_n IS NOT NULL")
    before = F.lag("_n").over(Window.partitionBy("host").orderBy("_n"))
    return numbered.withColumn("_b", before).filter("_n - _b > 1").select("host", (F.col("_b") + 1).alias("first_missing"), (F.col("_n") - 1).alias("last_missing"), (F.col("_n") - F.col("_b") - 1).alias("missing"))


def accept_files(files: DataFrame, primary: DataFrame) -> DataFrame:
    """Files of the host that was primary while they were written: containment in ``primary(instance_id, host, lo, hi)``;
    a file that straddles a switch is accepted from both hosts."""
    keys = ["instance_id", "host"]
    lasting = files.withColumn("_hi", F.greatest("hi", F.col("lo") + 1))
    held = overlapping(lasting, primary.withColumn("_hi", F.col("hi")), keys, "lo", "_hi", {"_n": (F.lit(1), "sum")})
    return lasting.join(held, [*keys, "lo", "_hi"], "left_semi").select(files.columns)


def align_window(intervals: list[tuple[int, int]], start_us: int, end_us: int, width_us: int = 300_000_000) -> tuple[int, int] | None:
    """The window itself inside one covered interval; cut to a bucket edge where only its start is covered; else none."""
    for lo, hi in intervals:
        if lo <= start_us < hi:
            if end_us <= hi:
                return start_us, end_us
            cut = hi - hi % width_us
            return (start_us, cut) if cut > start_us else None
    return None


def align_windows(windows: DataFrame, spans: DataFrame, width_us: int = 300_000_000) -> DataFrame:
    """``align_window`` for many windows at once: ``windows(instance_id, id, start_us, end_us)`` against disjoint covered ``spans``.

    A window without a covered start, or covered for less than one bucket edge, has no aligned window (nulls).
    """
    held = stab(windows, spans, ["instance_id"], "start_us", "lo", "hi", {"_covered": (F.col("hi"), "max")})
    out = windows.join(held, ["instance_id", "start_us"], "left").select(*windows.columns, "_covered")
    cut = F.col("_covered") - F.pmod("_covered", F.lit(width_us))
    end = F.when(F.col("_covered") > F.col("start_us"), F.when(F.col("end_us") <= F.col("_covered"), F.col("end_us")).when(cut > F.col("start_us"), cut))
    return out.withColumns({"aligned_start_us": F.when(end.isNotNull(), F.col("start_us")), "aligned_end_us": end}).drop("_covered")


def ready_prefixes(windows: DataFrame, spans: DataFrame, least_us: int = 360 * SECOND) -> DataFrame:
    """The longest covered prefix of each window that ends on a whole minute, against disjoint covered ``spans(instance_id, lo, hi)``: columns
    ``ready_start_us, ready_end_us``, null where the start is not covered or the prefix is shorter than ``least_us``."""
    held = stab(windows, spans, ["instance_id"], "start_us", "lo", "hi", {"_covered": (F.col("hi"), "max")})
    out = windows.join(held, ["instance_id", "start_us"], "left").select(*windows.columns, "_covered")
    end = F.least("end_us", "_covered")
    cut = F.when(F.col("_covered").isNotNull(), end - F.pmod(end, F.lit(60 * SECOND)))
    ready = F.coalesce(cut - F.col("start_us") >= least_us, F.lit(False))
    return out.withColumns({"ready_start_us": F.when(ready, F.col("start_us")), "ready_end_us": F.when(ready, cut)}).drop("_covered")


def nearest_windows(windows: DataFrame, spans: DataFrame, width_us: int = 30 * 86_400 * SECOND) -> DataFrame:
    """The covered window of the same length nearest to each asked for, the earlier at ties: ``nearest_start_us, nearest_end_us``, null if none.

    A window of some length may start from a span's beginning to that length before its end. Per instance and length these ranges are
    disjoint, so the nearest start lies in the last range that begins at or before the one asked for, or is the beginning of the next. Both
    are carried along the times in bins of ``width_us``, from either side. Ranges are laid out once for each length asked for.
    """
    keys = ["instance_id", "length"]
    asked = windows.select("instance_id", (F.col("end_us") - F.col("start_us")).alias("length"), F.col("start_us").alias("at"), F.lit(1).alias("side"), F.struct(*windows.columns).alias("w"))
    ranges = spans.join(asked.select(*keys).distinct(), "instance_id").filter(F.col("hi") - F.col("lo") >= F.col("length"))
    ranges = ranges.select(*keys, F.col("lo").alias("at"), F.lit(0).alias("side"), (F.col("hi") - F.col("length")).alias("last"))
    both = asked.unionByName(ranges, allowMissingColumns=True)
    both = scan(both, keys, ["at", "side"], width_us, below=(F.col("last"), "mark")).withColumns({"back": -F.col("at"), "turn": -F.col("side")})
    both = scan(both, keys, ["back", "turn"], width_us, above=(F.when(F.col("side") == 0, F.col("at")), "mark")).filter("side = 1")
    start, high = F.col("w.start_us"), F.col("above")
    low = F.when(F.col("below").isNotNull(), F.least(F.col("below"), start))
    best = F.when(high.isNull() | (start - low <= high - start), low).otherwise(high)
    return both.select("w.*", best.alias("nearest_start_us"), (best + F.col("length")).alias("nearest_end_us"))


def sync_estimate(files: DataFrame) -> DataFrame:
    """Median seconds per file (from four files) and arrival interval (from three), and the time for what waits."""
    order = Window.partitionBy("instance_id").orderBy("created_us")
    marked = files.withColumns({"_took": (F.col("done_us") - F.col("started_us")) / SECOND, "_gap": (F.col("created_us") - F.lag("created_us").over(order)) / SECOND})
    out = marked.groupBy("instance_id").agg(
        F.count("_took").alias("done"), F.count("_gap").alias("gaps"), F.expr("percentile(_took, 0.5)").alias("_m"), F.expr("percentile(_gap, 0.5)").alias("_g"), F.count_if(F.col("done_us").isNull()).alias("waiting")
    )
    each = F.when(F.col("done") >= 4, F.col("_m"))
    return out.select("instance_id", "done", "waiting", each.alias("seconds_per_file"), F.when(F.col("gaps") >= 3, F.col("_g")).alias("arrival_s"), (each * F.col("waiting")).alias("eta_s"))


def source_freshness(df: DataFrame, now_us: int, budgets: DataFrame) -> DataFrame:
    """Per source ok, stale, warming (nothing yet) or invalid (from the future), by its age budget."""
    last = df.groupBy("source").agg(F.max("ts_us").alias("last_us"))
    age = F.lit(now_us) - F.col("last_us")
    status = F.when(F.col("last_us").isNull(), "warming").when(age < 0, "invalid").when(age > F.col("budget_us"), "stale").otherwise("ok")
    return budgets.join(last, "source", "left").select("source", "last_us", status.alias("status"))


def backlog_health(files: DataFrame, rows: DataFrame, now_us: int, stuck_after: int = 5) -> DataFrame:
    """Per instance: files pending, failed, stuck; how far the row store is behind the collected files."""
    out = files.groupBy("instance_id").agg(
        F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if((F.col("state") != "done") & (F.col("attempts") >= stuck_after)).alias("stuck"),
        F.min(F.when(F.col("state") == "pending", F.col("hi"))).alias("oldest_pending_us"),
        F.max(F.when(F.col("state") == "done", F.col("hi"))).alias("newest_done_us"),
        F.count_if((F.col("state") == "lost") & (F.col("hi") >= now_us - 86_400 * SECOND)).alias("lost_day"),
    )
    stored = rows.groupBy("instance_id").agg(F.max("event_epoch_us").alias("stored_us"))
    behind = ((F.col("newest_done_us") - F.col("stored_us")) / SECOND).cast("bigint")
    return out.join(stored, "instance_id", "left").withColumn("behind_s", behind).withColumn("healthy", F.coalesce((F.col("behind_s") <= 3600) & (F.col("stuck") == 0) & (F.col("failed") == 0), F.lit(False)))


def dataset_stats(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.sum("rows").alias("events"), F.count(F.lit(1)).alias("parts"), F.min("first_us").alias("oldest_us"), F.max("last_us").alias("latest_us"))


def hourly_names(df: DataFrame) -> DataFrame:
    hour = F.col("event_epoch_us") - F.pmod("event_epoch_us", F.lit(3_600 * SECOND))
    return df.groupBy(hour.alias("hour_us"), "instance_id", "database_name", "table_name").agg(F.count(F.lit(1)).alias("rows"))


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: the columns, ``only_in`` (first, second) and how often. One shuffle of
    row counts, combined before it."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        raise AssertionError(f"columns differ: {columns} and {sorted(b.columns)}")
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    out = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return out.select(*columns, F.when(F.col("_n") > 0, "first").otherwise("second").alias("only_in"), F.abs("_n").alias("times"))


def assert_same_rows(a: DataFrame, b: DataFrame) -> None:
    """Fail unless both hold the same rows as often."""
    found = {r["only_in"]: r["n"] for r in row_differences(a, b).groupBy("only_in").agg(F.sum("times").alias("n")).collect()}
    if found:
        raise AssertionError(f"{found.get('first', 0)} rows only in the first, {found.get('second', 0)} only in the second")


def ordered_digest(df: DataFrame, keys: list[str], order: list[str | Column], by: list[str] = ()) -> DataFrame:
    """``by``, ``rows`` and ``digest`` of the key columns of a whole result in its order, ties by the key columns; equal for any
    partitioning. With ``by`` one digest for each value, over the places in the whole, so that a difference shows where it is.

    Rows are sorted by range and stored; a row's number in the whole follows from its number in its partition and the sizes of the
    partitions, which are all that the driver gets. The digest adds up hashes of number and row, so it is combined before any shuffle.
    """
    spark = df.sparkSession
    text = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"c{n}") for n, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    ordered = df.orderBy(*order, *keys).select(*by, text.alias("_row"))
    rows = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), scratch_folder(spark), "ordered")
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["_part"]: r["size"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("size")).collect()}
    parts = sorted(sizes)
    before = spark.createDataFrame(list(zip(parts, accumulate([0, *map(sizes.get, parts)]))), "_part long, _before long")
    sha = F.sha2(F.concat_ws(":", F.col("_before") + F.col("_n"), "_row"), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for at in (1, 16)]
    found = rows.join(F.broadcast(before), "_part").groupBy(*by)  # one row per partition is broadcast
    out = found.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(",", F.count(F.lit(1)), *sums).alias("sums"))
    return out.select(*by, "rows", F.sha2("sums", 256).alias("digest"))


def ordered_hash(df: DataFrame, keys: list[str], order: list[str]) -> str:
    """The digest of a whole result in its order."""
    return ordered_digest(df, keys, order).first()["digest"]


def verify_parts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Parts that differ between two inventories: missing, extra, or of other rows, digest or revision."""
    s = source.select("path", *[F.col(c).alias(f"s_{c}") for c in ("rows", "sha256", "revision")], F.lit(True).alias("_s"))
    t = target.select("path", *[F.col(c).alias(f"t_{c}") for c in ("rows", "sha256", "revision")], F.lit(True).alias("_t"))
    both = s.join(t, "path", "full_outer")
    differs = ~F.col("s_rows").eqNullSafe(F.col("t_rows")) | ~F.col("s_sha256").eqNullSafe(F.col("t_sha256")) | ~F.col("s_revision").eqNullSafe(F.col("t_revision"))
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(differs, "different")
    return both.withColumn("status", status).filter("status IS NOT NULL").drop("_s", "_t")


def backtest(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """Per case: whether each true family ranks at or above its limit; a family that is not ranked fails."""
    joined = truth.join(ranking.select("case_id", "family", "rank"), ["case_id", "family"], "left")
    return joined.groupBy("case_id").agg(F.min(F.coalesce(F.col("rank") <= F.col("max_rank"), F.lit(False))).alias("passed"), F.max("rank").alias("worst_rank"), F.count_if(F.col("rank").isNull()).alias("missing"))
