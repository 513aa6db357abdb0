"""Ordered scans in two levels, for few keys with long histories.

A window over a key takes the key's whole history into one task. Here the order column, a number such as a time, is cut into bins of
``width``: rows meet by key and bin, and what a bin needs of the rows before it is one carry row. Carries come from an aggregation by key and
bin, combined before its shuffle, and a window over the bins of a key, of which there are as many as bins in its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, keys: list[str], order: list[str], width: int, **outs: tuple[Column, str]) -> DataFrame:
    """``df`` with a column for each of ``outs``, ``name=(column, how)``, along the rows of a key by ``order``:

    ``previous``: the column's value in the row before (null for the first); ``total``: its sum so far, this row included;
    ``mark``: its last value that is not null, this row included. The first of ``order`` is cut into bins; a row without it is in a
    bin of its own, before all others. ``order`` should name rows uniquely.
    """
    at = F.struct(*order)
    rows = df.withColumns({"_bin": F.floor(F.col(order[0]) / F.lit(width)).cast("bigint"), "_row": F.lit(1), **{f"_v_{n}": c for n, (c, _) in outs.items()}})
    last = {
        "previous": lambda v: F.max_by(v, at),
        "total": F.sum,
        "mark": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), at)),
    }
    per = rows.groupBy(*keys, "_bin").agg(*[last[how](f"_v_{n}").alias(f"_v_{n}") for n, (_, how) in outs.items()])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    over = {
        "previous": lambda v: F.last(v).over(before),
        "total": lambda v: F.sum(v).over(before),
        "mark": lambda v: F.last(v, ignorenulls=True).over(before),
    }
    carries = per.select(*keys, "_bin", F.lit(0).alias("_row"), *[over[how](f"_v_{n}").alias(f"_v_{n}") for n, (_, how) in outs.items()])
    w = Window.partitionBy(*keys, "_bin").orderBy("_row", *order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    found = {
        "previous": lambda v: F.lag(v).over(w),
        "total": lambda v: F.sum(v).over(so_far),
        "mark": lambda v: F.last(v, ignorenulls=True).over(so_far),
    }
    both = rows.unionByName(carries, allowMissingColumns=True)
    both = both.withColumns({n: found[how](f"_v_{n}") for n, (_, how) in outs.items()}).filter("_row = 1")
    return both.drop("_bin", "_row", *[f"_v_{n}" for n in outs])


def highest_total(steps: DataFrame, keys: list[str], order: list[str], width: int, value: str, name: str) -> DataFrame:
    """Per key the highest running total of ``value``: of each bin its sum and its highest total come together, never rows of two bins."""
    w = Window.partitionBy(*keys, "_bin").orderBy(*order)
    rows = steps.withColumn("_bin", F.floor(F.col(order[0]) / F.lit(width)).cast("bigint")).withColumn("_total", F.sum(value).over(w))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum(value).alias("_sum"), F.max("_total").alias("_high"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumn("_reached", before + F.col("_high")).groupBy(*keys).agg(F.max("_reached").alias(name))
