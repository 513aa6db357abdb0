"""Slow-log analytics: canonical events, grouping-set summaries, rankings, exact correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket
from ..functions.series import pearson, sums_for_pearson

IDENTITY = ["instance_id", "event_id"]
SLOW_ORDERS = ("executions", "query_time_ms", "query_time_max_ms", "rows_examined", "rows_examined_max", "lock_time_ms", "rows_sent")
LEAST_BUCKETS = 6


def canonical_slow(df: DataFrame) -> DataFrame:
    """One row per (instance, event): the occurrence with the smallest part path, then part id."""
    rest = [c for c in df.columns if c not in IDENTITY]
    picked = df.groupBy(*IDENTITY).agg(F.min_by(F.struct(*rest), F.struct("_source_part_path", "_source_part_id")).alias("_row"))
    return picked.select(*IDENTITY, "_row.*").select(*df.columns)


def _measures() -> list[Column]:
    scan = F.struct("rows_examined", "query_time_ms", "event_epoch_us", "event_id")
    time = F.struct("query_time_ms", "rows_examined", "event_epoch_us", "event_id")
    out = [F.count(F.lit(1)).alias("executions")]
    for c in ("rows_examined", "rows_sent", "query_time_ms", "lock_time_ms"):
        out += [F.sum(c).alias(c), F.max(c).alias(c.replace("_ms", "_max_ms") if c.endswith("_ms") else f"{c}_max")]
    return [
        *out,
        F.sum("sql_bytes").alias("sql_bytes"),
        F.min("event_epoch_us").alias("first_us"),
        F.max("event_epoch_us").alias("last_us"),
        F.max_by("event_id", scan).alias("max_scan_event"),
        F.max_by("event_id", time).alias("max_time_event"),
        F.count_distinct(F.struct("database_name", "table_name")).alias("objects"),
        F.count_distinct("fingerprint").alias("fingerprints"),
    ]


def slow_summary(canonical: DataFrame, width_us: int) -> DataFrame:
    """One pass for four groupings: statement, object, operation and bucket; ``mask`` tells them apart (15, 19, 29, 30)."""
    rows = canonical.select(
        "*",
        bucket(F.col("event_epoch_us"), width_us).alias("ts"),
        F.col("fingerprint").alias("g_fingerprint"),
        F.col("database_name").alias("g_database"),
        F.col("table_name").alias("g_table"),
        F.col("operation").alias("g_operation"),
    )
    keys = [F.col(c) for c in ("g_fingerprint", "g_database", "g_table", "g_operation", "ts")]
    f, d, t, o, b = keys
    grouped = rows.groupingSets([[f], [d, t], [o], [b]], f, d, t, o, b)
    return grouped.agg(F.grouping_id().alias("mask"), *_measures())


#: Grouping masks of the summary, by what the rows describe.
MASKS = {"statements": 15, "objects": 19, "operations": 29, "trend": 30}


def top_accounts(canonical: DataFrame, n: int = 3) -> DataFrame:
    """Per statement: how many accounts, and the ``n`` most frequent (ties by name); blanks do not count."""
    counts = canonical.filter("database_account <> ''").groupBy("fingerprint", "database_account").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("n"), "database_account"))
    ranked = counts.withColumn("_r", rank)
    return ranked.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", "database_account")))), lambda x: x["database_account"]).alias("top_accounts"),
    )


def rank_slow(summary: DataFrame, order: str = "query_time_ms", n: int = 20) -> DataFrame:
    """Statements in one of seven orders, ties by fingerprint descending, with averages per execution (half to even)."""
    if order not in SLOW_ORDERS:
        raise ValueError(f"unknown order {order!r}")
    rows = summary.filter(F.col("mask") == MASKS["statements"]).withColumnRenamed("g_fingerprint", "fingerprint")
    each = {f"{c}_avg": F.bround(F.col(c) / F.col("executions"), 0).cast("bigint") for c in ("rows_examined", "query_time_ms")}
    return rows.withColumns(each).orderBy(F.desc(order), F.desc("fingerprint")).limit(n)


def with_profiles(statements: DataFrame, profiles: DataFrame) -> DataFrame:
    """Statements with action and text by (instance, fingerprint); over several instances the smallest."""
    own = profiles.groupBy("fingerprint").agg(F.min("action").alias("action"), F.min("normalized_sql").alias("normalized_sql"))
    return statements.drop("action", "normalized_sql").join(own, "fingerprint", "left")


def slow_correlation(canonical: DataFrame, start_us: int, end_us: int, width_us: int) -> DataFrame:
    """How each statement's count follows the total over complete buckets: of changes (main), of levels, of levels
    against the rest.

    Buckets without an execution count as zero, those cut by the window are left out. The sums are exact integers. For
    the dense grid only non-zero buckets are materialised: a statement's changes are non-zero next to its own buckets, so
    all sums follow from those and from the total series.
    """
    spark = canonical.sparkSession
    first = -(-start_us // width_us) * width_us
    last = ((end_us + 1) // width_us - 1) * width_us
    n = max(0, (last - first) // width_us + 1)
    rows = canonical.filter(F.col("event_epoch_us").between(first, last + width_us - 1)) if n else canonical.limit(0)
    counts = rows.groupBy("fingerprint", bucket(F.col("event_epoch_us"), width_us).alias("ts")).agg(F.count(F.lit(1)).alias("x"))
    total = counts.groupBy("ts").agg(F.sum("x").alias("y"))
    base = spark.range(0, n).select((F.lit(first) + F.col("id") * width_us).alias("ts")).join(total, "ts", "left").select("ts", F.coalesce("y", F.lit(0)).alias("y"))
    order = Window.orderBy("ts")  # one row per bucket of the window
    base = base.withColumn("dy", F.col("y") - F.lag("y").over(order))
    whole = base.agg(F.sum("y").alias("ty"), F.sum(F.col("y") * F.col("y")).alias("tyy"), F.sum("dy").alias("tdy"), F.sum(F.col("dy") * F.col("dy")).alias("tdyy"), F.count_distinct("y").alias("levels"))
    # each own bucket gives its level to itself and, negated, to the change into the next bucket
    at = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("x").alias("x"), F.col("x").alias("dx")), F.struct(F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("x"), (-F.col("x")).alias("dx"))))
    spread = counts.select("fingerprint", "ts", at.alias("e")).select("fingerprint", (F.col("ts") + F.col("e.k") * width_us).alias("ts"), "e.x", "e.dx")
    merged = spread.groupBy("fingerprint", "ts").agg(F.sum("x").alias("x"), F.sum("dx").alias("dx")).join(F.broadcast(base), "ts")
    # the first bucket has no predecessor, so no change
    change = F.when(F.col("dy").isNotNull(), F.col("dx"))
    ex = "decimal(38,0)"

    def s(v: Column) -> Column:
        return F.coalesce(F.sum(v.cast(ex)).cast(ex), F.lit(0).cast(ex))

    sums = merged.groupBy("fingerprint").agg(
        s(F.col("x")).alias("sx"), s(F.col("x") * F.col("x")).alias("sxx"), s(F.col("x") * F.col("y")).alias("sxy"),
        s(change).alias("sdx"), s(change * change).alias("sdxx"), s(change * F.col("dy")).alias("sdxy"),
        F.count_if(F.col("x") > 0).alias("active_buckets"),
    ).crossJoin(F.broadcast(whole))
    m = F.lit(n)
    rest_y, rest_yy = F.col("ty") - F.col("sx"), F.col("tyy") - 2 * F.col("sxy") + F.col("sxx")
    level = pearson(m, F.col("sx"), F.col("ty"), F.col("sxx"), F.col("tyy"), F.col("sxy"))
    delta = pearson(m - 1, F.col("sdx"), F.col("tdy"), F.col("sdxx"), F.col("tdyy"), F.col("sdxy"))
    against = pearson(m, F.col("sx"), rest_y, F.col("sxx"), rest_yy, F.col("sxy") - F.col("sxx"))
    constant = (m * F.col("sxx") - F.col("sx") * F.col("sx")) == 0
    status = F.when(m < LEAST_BUCKETS, "insufficient_buckets").when(F.col("levels") <= 1, "constant_total").when(constant, "constant_sql").otherwise("ok")
    ok = F.col("status") == "ok"
    return sums.withColumn("status", status).select(
        "fingerprint", "status", F.when(ok, delta).alias("r_change"), F.when(ok, level).alias("r_level"), F.when(ok, against).alias("r_rest"),
        (F.col("sx").cast("double") / F.col("ty").cast("double")).alias("share"), "active_buckets", m.cast("int").alias("buckets"),
    )


def order_by_correlation(df: DataFrame, column: str = "r_change") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), "fingerprint")


def correlate(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Exact correlation of two integer columns per group, over rows where both are known."""
    sums = df.groupBy(*keys).agg(*sums_for_pearson(F.col(x), F.col(y)))
    r = pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.select(*keys, "n", r.alias("r"))
