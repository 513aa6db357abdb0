"""Time series building blocks: grids, runs, interval unions, exact correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan

EXACT = "decimal(38,0)"


def trend_width(start_us: int, end_us: int, width_us: int = 300_000_000, most: int = 480) -> int:
    """Width of trend buckets: the base width times what keeps them at ``most`` or fewer."""
    buckets = (end_us - start_us) // width_us + 1
    return width_us * max(1, -(-buckets // most))


def grain_for(start_us: int, end_us: int) -> str:
    """Which aggregates answer a window: up to 6 hours 5 minutes, up to 8 days hours, else days."""
    span = end_us - start_us
    return "5m" if span <= 6 * 3_600_000_000 else "hour" if span <= 8 * 86_400_000_000 else "day"


def comparison_window(start_us: int, end_us: int, explicit: tuple[int, int] | None = None) -> tuple[int, int]:
    """The window before, of equal length and ending where this one begins; an explicit one must not overlap."""
    if explicit is None:
        return start_us - (end_us - start_us), start_us
    low, high = explicit
    if low >= high or low < end_us and start_us < high:
        raise ValueError("the comparison window overlaps or is empty")
    return low, high


def grid(spark, start_us: int, end_us: int, width_us: int) -> DataFrame:
    """``ts``: the starts of all buckets that the window touches."""
    first, last = start_us - start_us % width_us, end_us - end_us % width_us
    return spark.range(first, last + 1, width_us).select(F.col("id").alias("ts"))


def islands(df: DataFrame, keys: list[str], order: str, together: Column, name: str = "run", width: int | None = None) -> DataFrame:
    """Number the runs of consecutive rows of ``keys``; ``together`` says whether a row continues its predecessor's run
    (it may use ``prev``, the predecessor's ``order``). With ``width``, for few keys of many rows, in bins of the order."""
    if width is not None:
        marked = scan(df, keys, [order], width, prev=(F.col(order), "previous"))
        marked = marked.withColumn("_new", F.when(F.col("prev").isNotNull() & together, 0).otherwise(1))
        return scan(marked, keys, [order], width, **{name: (F.col("_new"), "total")}).drop("prev", "_new")
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("prev", F.lag(order).over(w)).withColumn("_new", F.when(F.col("prev").isNotNull() & together, 0).otherwise(1))
    return marked.withColumn(name, F.sum("_new").over(w)).drop("prev", "_new")


def carried(df: DataFrame, keys: list[str], order: list[str], mark: Column, name: str, width: int | None = None) -> DataFrame:
    """State carried forward per key: the last row whose ``mark`` is not null sets it, an empty mark clears it.

    With ``width``, for few keys of many rows, in bins of the first order column."""
    if width is not None:
        return scan(df, keys, order, width, _held=(mark, "mark")).withColumn(name, F.when(F.col("_held") != "", F.col("_held"))).drop("_held")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(mark, ignorenulls=True).over(w)
    return df.withColumn(name, F.when(held != "", held))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "lo", end: str = "hi", tolerance: int = 0) -> DataFrame:
    """Union of intervals per key: one row per run of intervals that touch within ``tolerance``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= before + tolerance, 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def subtract_intervals(df: DataFrame, gaps: DataFrame, keys: list[str], start: str = "lo", end: str = "hi") -> DataFrame:
    """Half-open intervals of ``df`` (disjoint per key) less those of ``gaps``, by a sweep over all boundaries."""
    points = [(df, start, 1, 0), (df, end, -1, 0), (gaps, start, 0, 1), (gaps, end, 0, -1)]
    swept = None
    for src, column, base, gap in points:
        part = src.select(*keys, F.col(column).alias("at"), F.lit(base).alias("base"), F.lit(gap).alias("gap"))
        swept = part if swept is None else swept.unionByName(part)
    level = swept.groupBy(*keys, "at").agg(F.sum("base").alias("base"), F.sum("gap").alias("gap"))
    w = Window.partitionBy(*keys).orderBy("at")
    level = level.select(*keys, F.col("at").alias(start), F.lead("at").over(w).alias(end), F.sum("base").over(w).alias("b"), F.sum("gap").over(w).alias("g"))
    pieces = level.filter(f"b > 0 AND g = 0 AND `{end}` IS NOT NULL").drop("b", "g")
    return merge_intervals(pieces, keys, start, end)


def sums_for_pearson(x: Column, y: Column) -> list[Column]:
    """Exact sums over rows where both are known: ``n, sx, sy, sxx, syy, sxy``; the inputs are integers."""
    both = x.isNotNull() & y.isNotNull()
    dx, dy = x.cast(EXACT), y.cast(EXACT)

    def total(v: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(both, v)).cast(EXACT), F.lit(0).cast(EXACT)).alias(name)

    return [F.count_if(both).alias("n"), total(dx, "sx"), total(dy, "sy"), total((dx * dx).cast(EXACT), "sxx"), total((dy * dy).cast(EXACT), "syy"), total((dx * dy).cast(EXACT), "sxy")]


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from exact sums, within -1 and 1; null where a side is constant."""
    m = n.cast(EXACT)

    def d(a: Column, b: Column) -> Column:
        return (a.cast(EXACT) * b.cast(EXACT)).cast(EXACT)

    cov, vx, vy = d(m, sxy) - d(sx, sy), d(m, sxx) - d(sx, sx), d(m, syy) - d(sy, sy)
    r = cov.cast("double") / F.sqrt(vx.cast("double")) / F.sqrt(vy.cast("double"))
    return F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
