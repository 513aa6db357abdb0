"""Structured Streaming forms of the incremental behaviours. Each takes a streaming DataFrame and returns one, or a
``foreachBatch`` function for sinks that must be exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .key_index import bucket_of, folders, suspected, write_index


def with_event_clock(df: DataFrame, lateness: str, column: str = "event_epoch_us") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(column)).withWatermark("event_time", lateness)


def late_slow_events(df: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Slow events once each: a record appears when its statement ends and is read again for two hours."""
    return with_event_clock(df, lateness).dropDuplicatesWithinWatermark(["instance_id", "event_id"])


def stored_and_tail(stored: DataFrame, tail: DataFrame) -> DataFrame:
    """Stored rows and those of the live tail that are not stored yet."""
    fresh = tail.join(stored.select("instance_id", "event_id"), ["instance_id", "event_id"], "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def change_aggregates(df: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling aggregates of change events."""
    rows = with_event_clock(df, lateness)
    first = F.col("row_index") == 1
    return rows.groupBy(F.window("event_time", width), "instance_id", "database_name", "table_name", "operation").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(first).alias("executions"),
        F.sum(F.when(first, F.col("execution_time_ms")).otherwise(0)).alias("exec_time_ms"),
        F.min("event_epoch_us").alias("first_us"),
        F.max("event_epoch_us").alias("last_us"),
    )


def minute_rollup(df: DataFrame, keys: list[str], sums: list[str], time_us: str, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling one-minute sums with how many values were known."""
    rows = with_event_clock(df, lateness, time_us)
    return rows.groupBy(F.window("event_time", "1 minute"), *keys).agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in sums], *[F.count(c).alias(f"{c}_known") for c in sums])


def binding_intervals(df: DataFrame) -> DataFrame:
    """First and last sighting of each binding, kept up to date."""
    return df.groupBy("uid", "ip").agg(F.min("seen_us").alias("first_seen_us"), F.max("seen_us").alias("last_seen_us"))


def once_per_batch(write: Callable[[DataFrame, str], None], base: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that is safe to repeat: each batch id has its own folder, overwritten as a whole."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{base}/batch={batch_id:012d}")

    return run


#: Up to so many folders of earlier batches are named to the scan; where more may hold a key, all keys of history are compared.
MAX_FOLDERS = 2000


def beside_earlier(new: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows with the least digest of their key in the batch (``_first``) and the one of earlier batches (``_old``).

    Rows are moved by their key once; the window, the join and what is kept of a key later go by it.
    """
    return new.withColumn("_first", F.min("_digest").over(Window.partitionBy(key))).join(before, key, "left")


def insert_only(path: str, key: str = "event_id", buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """Append what is new by key; repeats are dropped and conflicts are kept beside, under ``_conflicts``.

    A batch is judged against the batches before it. Of those, only the folders (batch and bucket) are read whose filter, under
    ``_index``, may hold a key of the batch, and of them only key and digest; new keys read no rows but for false alarms. Its own
    folder is never read, so that a batch may be repeated, also after it broke off half written. Null keys are never compared
    with earlier batches' and one of them is kept for each batch.
    """
    index = f"{path}_index"

    def earlier(new: DataFrame, batch_id: int) -> DataFrame:
        spark = new.sparkSession
        found = suspected(new, index, batch_id, key)
        few = found.limit(MAX_FOLDERS + 1).collect() if found is not None else []
        if not few:
            return spark.createDataFrame([], f"{key} string, _old string")
        if len(few) <= MAX_FOLDERS:
            before = spark.read.option("basePath", path).parquet(*folders(path, few))
        else:
            before = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") < batch_id)
        return before.select(key, F.col("_digest").alias("_old"))

    def run(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != key]
        new = batch.withColumns({"_digest": F.sha2(F.to_json(F.struct(*rest)), 256), "_bucket": bucket_of(key, buckets)})
        judged = beside_earlier(new, earlier(new, batch_id), key)
        own = f"{path}/batch={batch_id:012d}"
        fresh = judged.filter("_old IS NULL AND _digest = _first").dropDuplicates([key]).drop("_old", "_first")
        fresh.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(own)
        judged.filter("_digest <> coalesce(_old, _first)").drop("_old", "_first", "_digest", "_bucket").write.mode("overwrite").parquet(f"{path}_conflicts/batch={batch_id:012d}")
        write_index(batch.sparkSession.read.schema(fresh.schema).parquet(own), index, batch_id, key, buckets)

    return run


#: Up to so many touched hours are named to the scan, which then lists no other partitions; more are joined.
MAX_HOURS = 1000


def rebuild_hours(facts_path: str, out_path: str, aggregate: Callable[[DataFrame], DataFrame], time_us: str, width_us: int = 3_600_000_000) -> Callable[[DataFrame, int], None]:
    """Append a batch to the facts, then rebuild the hours that it touched, late ones too; a repeat gives the same.

    ``aggregate`` maps fact rows with an ``hour_us`` column to rows that keep it; hours may be ``width_us`` wide. A batch is
    written with one file for each hour.
    """
    hour = F.col(time_us) - F.pmod(F.col(time_us), F.lit(width_us))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("hour_us", hour)
        marked.repartition("hour_us").write.mode("overwrite").partitionBy("hour_us").parquet(f"{facts_path}/batch={batch_id:012d}")
        facts = spark.read.parquet(facts_path)
        touched = marked.select("hour_us").distinct()
        few = [r["hour_us"] for r in touched.limit(MAX_HOURS + 1).collect()]
        rebuilt = aggregate(facts.filter(F.col("hour_us").isin(few)) if len(few) <= MAX_HOURS else facts.join(touched, "hour_us", "left_semi"))
        rebuilt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour_us").parquet(out_path)

    return run
