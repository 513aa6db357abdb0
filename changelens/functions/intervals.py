"""Points in intervals and overlapping intervals, by bins of many widths instead of pairs.

Time is cut into bins of about a second (``2**BASE_BITS`` microseconds), of eight times that, and so on for ``LEVELS`` widths. A half-open
interval ``[lo, hi)`` is the union of a few whole bins of each width (14 at most) and of the parts of base bins at its two ends. A point lies in one
bin of each width. So whether, how often and by what a point is covered follows from equi joins on key, width and bin; what is asked of the
intervals is aggregated by bin first, and no pair of a point with an interval is made but within the base bins where an interval begins or ends.
A key with few points or few intervals needs no bins: its pairs are a fixed multiple of its rows, while an interval has some sixty bins.
A hot key has many bins; the widest bins of a hot key are spread by adaptive skew splitting, as one side has one row for each bin.

Measures are ``name: (column, how)`` with ``how`` one of sum, min, max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_BITS, STEP_BITS, LEVELS = 20, 3, 13
#: Of a key with as many points or intervals at most, pairs are made.
FEW = 16
_HOW = {"sum": F.sum, "min": F.min, "max": F.max}
Measures = dict[str, tuple[Column, str]]


def _bits(level: int | Column) -> int | Column:
    return BASE_BITS + STEP_BITS * level


def _shifted(how: str, value: Column, bits: int | Column) -> Column:
    return F.call_function(how, value, F.lit(bits).cast("int"))


def _inside(lo: Column, hi: Column, level: int | Column) -> tuple[Column, Column]:
    """First and end of the whole bins of a width that lie in the interval."""
    bits = _bits(level)
    return _shifted("shiftright", lo + _shifted("shiftleft", F.lit(1).cast("bigint"), bits) - 1, bits), _shifted("shiftright", hi, bits)


def whole_bins(lo: Column, hi: Column) -> Column:
    """The fewest whole bins that make up the interval, less its ends: an array of ``(level, bin)``.

    Levels are the elements of an array, not copies of the expression: 13 copies, each with its own bounds, again in the filters that
    Spark infers from an explosion, take the driver more memory and time than the rows take.
    """

    def bounds(level: Column) -> Column:
        first, end = _inside(lo, hi, level)
        up_first, up_end = _inside(lo, hi, level + 1)
        above = (level < LEVELS - 1) & (up_first < up_end)  # wider bins hold the middle
        return F.struct(level.alias("level"), first.alias("first"), end.alias("end"), F.when(above, _shifted("shiftleft", up_first, STEP_BITS)).alias("until"), F.when(above, _shifted("shiftleft", up_end, STEP_BITS)).alias("since"))

    def bins(level: Column, first: Column, end: Column) -> Column:
        found = F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(found, lambda b: F.struct(level.alias("level"), b.alias("bin")))

    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), bounds)
    return F.flatten(F.transform(levels, lambda x: F.concat(bins(x["level"], x["first"], F.coalesce(x["until"], x["end"])), bins(x["level"], F.coalesce(x["since"], x["end"]), x["end"]))))


def end_bins(lo: Column, hi: Column) -> Column:
    """The base bins that the interval covers in part: none, one or two."""
    first, end = _inside(lo, hi, 0)
    begins, ends = F.shiftright(lo, BASE_BITS), F.shiftright(hi - 1, BASE_BITS)
    return F.array_distinct(F.array_compact(F.array(F.when((begins < first) | (first > end), begins), F.when((ends >= end) | (first > end), ends))))


def point_bins(at: Column) -> Column:
    """The bin of each width that a point lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.struct(level.alias("level"), _shifted("shiftright", at, _bits(level)).alias("bin")))


def _split(points: DataFrame, intervals: DataFrame, keys: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """Both sides of the light keys and of the heavy ones, those that have more than ``FEW`` rows on each side. Keys of one side alone go."""
    p, n = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for df, c in ((points, "_p"), (intervals, "_n")))
    kinds = p.join(n.hint("merge"), keys).select(*keys, (F.least("_p", "_n") > FEW).alias("_heavy"))
    chosen = [kinds.filter(F.col("_heavy") == heavy).drop("_heavy").hint("merge") for heavy in (False, True)]
    return [(points.join(k, keys), intervals.join(k, keys)) for k in chosen]


def _by_bins(points: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and intervals, each by the whole bins that they lie in or are made of."""
    found = points.withColumn("_x", F.explode(point_bins(F.col("_at")))), intervals.withColumn("_x", F.explode(whole_bins(F.col("_lo"), F.col("_hi"))))
    probes, wholes = (df.withColumns({"_level": F.col("_x.level"), "_bin": F.col("_x.bin")}).drop("_x") for df in found)
    return probes, wholes


def _in_base_bins(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the intervals that begin or end in their base bin and hold them."""
    ends = intervals.withColumn("_bin", F.explode(end_bins(F.col("_lo"), F.col("_hi"))))
    return points.withColumn("_bin", F.shiftright("_at", BASE_BITS)).join(ends.hint("merge"), [*keys, "_bin"]).filter("_at >= _lo AND _at < _hi")


def _stabbed(points: DataFrame, intervals: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    """Measures of the intervals that hold a point, in a few parts, by bins."""
    merge = [_HOW[how](n).alias(n) for n, (_, how) in measures.items()]
    probes, wholes = _by_bins(points, intervals)
    nodes = wholes.groupBy(*keys, "_level", "_bin").agg(*merge)
    names = [*[c for c in points.columns if c not in measures], *measures]
    return probes.join(nodes.hint("merge"), [*keys, "_level", "_bin"]).select(*names).unionByName(_in_base_bins(points, intervals, keys).select(*names))


def _gathered(intervals: DataFrame, points: DataFrame, keys: list[str], measures: Measures) -> DataFrame:
    """Measures of the points that an interval holds, in a few parts, by bins."""
    merge = [_HOW[how](n).alias(n) for n, (_, how) in measures.items()]
    probes, wholes = _by_bins(points, intervals)
    nodes = probes.groupBy(*keys, "_level", "_bin").agg(*merge)
    names = [*keys, "_lo", "_hi", *measures]
    return wholes.join(nodes.hint("merge"), [*keys, "_level", "_bin"]).select(*names).unionByName(_in_base_bins(points, intervals, keys).select(*names))


def _measured(df: DataFrame, by: list[Column | str], measures: Measures) -> DataFrame:
    """Rows that agree in ``by`` as one, with their measures."""
    columns = [c.alias(n) for n, (c, _) in measures.items()]
    rows = df.select(*by, *columns)
    return rows.groupBy(*[c for c in rows.columns if c not in measures]).agg(*[_HOW[how](n).alias(n) for n, (_, how) in measures.items()])


def _merged(df: DataFrame, by: list[Column | str], measures: Measures) -> DataFrame:
    return df.groupBy(*by).agg(*[_HOW[how](n).alias(n) for n, (_, how) in measures.items()])


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str, measures: Measures) -> DataFrame:
    """For each distinct ``(keys, at)`` that lies in any interval: the measures over all intervals that hold it."""
    rows = _measured(intervals.filter(F.col(lo) < F.col(hi)), [*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")], measures)
    asked = points.select(*keys, F.col(at).alias("_at")).filter("_at IS NOT NULL").distinct()
    (p, n), heavy = _split(asked, rows, keys)
    pairs = p.join(n.hint("merge"), keys).filter("_at >= _lo AND _at < _hi").select(*keys, "_at", *measures)
    return _merged(pairs.unionByName(_stabbed(*heavy, keys, measures)), [*keys, F.col("_at").alias(at)], measures)


def gather(intervals: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, measures: Measures) -> DataFrame:
    """For each distinct interval ``(keys, lo, hi)`` that holds any point: the measures over all points in it."""
    asked = intervals.filter(F.col(lo) < F.col(hi)).select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).distinct()
    rows = _measured(points.filter(F.col(at).isNotNull()), [*keys, F.col(at).alias("_at")], measures)
    (p, n), (many, wide) = _split(rows, asked, keys)
    pairs = p.join(n.hint("merge"), keys).filter("_at >= _lo AND _at < _hi").select(*keys, "_lo", "_hi", *measures)
    return _merged(pairs.unionByName(_gathered(wide, many, keys, measures)), [*keys, F.col("_lo").alias(lo), F.col("_hi").alias(hi)], measures)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, measures: Measures) -> DataFrame:
    """For each distinct ``(keys, lo, hi)`` of ``left`` that overlaps any half-open interval of ``right``: the measures over those.

    Two intervals overlap if the right one holds the left one's beginning, or begins inside the left one behind that.
    """
    own = left.select(*keys, F.col(lo).alias("_from"), F.col(hi).alias("_to")).filter("_from < _to").distinct()
    rows = _measured(right.filter(F.col(lo) < F.col(hi)), [*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")], measures)
    (a, b), (many, wide) = _split(own, rows, keys)
    names = [*keys, "_from", "_to", *measures]
    pairs = a.join(b.hint("merge"), keys).filter("_from < _hi AND _lo < _to").select(*names)
    held = _stabbed(many.withColumn("_at", F.col("_from")), wide, keys, measures).select(*names)
    behind = many.select(*keys, (F.col("_from") + 1).alias("_lo"), F.col("_to").alias("_hi")).filter("_lo < _hi")
    found = _gathered(behind, _merged(wide, [*keys, F.col("_lo").alias("_at")], measures), keys, measures)
    found = found.select(*keys, (F.col("_lo") - 1).alias("_from"), F.col("_hi").alias("_to"), *measures)
    return _merged(pairs.unionByName(held).unionByName(found), [*keys, F.col("_from").alias(lo), F.col("_to").alias(hi)], measures)
