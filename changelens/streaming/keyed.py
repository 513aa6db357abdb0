"""Tables that streams keep up to date by key: every batch is a folder of its own, the latest batch of a key counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """Rows by ``keys`` below ``path``, in ``buckets`` of the keys' hash.

    ``write`` is a ``foreachBatch`` function: a batch that is repeated overwrites its own folder and changes nothing else. Rows with
    ``gone`` take their key out; rows with ``late`` are kept beside and returned by ``late``. A batch has each key once at most.
    """

    def __init__(self, path: str, keys: list[str], buckets: int = 16):
        self.path, self.keys, self.buckets = path, keys, buckets

    def write(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        for flag in ("gone", "late"):
            if flag not in batch.columns:
                batch = batch.withColumn(flag, F.lit(False))
        rows = batch.withColumn("_bucket", bucket).repartition("_bucket")
        rows.write.mode("overwrite").partitionBy("late", "_bucket").parquet(f"{self.path}/batch={batch_id:012d}")

    def _all(self, spark: SparkSession, late: bool) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(self.path).filter(F.col("late") == late)

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows that hold now."""
        rows = self._all(spark, False)
        rest = [c for c in rows.columns if c not in (*self.keys, "batch", "late", "_bucket")]
        # keys lie in one bucket, so the groups of a bucket are those of the whole
        last = rows.groupBy("_bucket", *self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
        return last.select(*self.keys, "last.*").filter("NOT gone").drop("gone")

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came too late to be placed."""
        return self._all(spark, True).select(*self.keys, "batch")

    def compact(self, spark: SparkSession, target: str) -> KeyedStore:
        """A new store of the rows that hold now, as its first batch, so that reading doesn't grow with rewritten rows."""
        store = KeyedStore(target, self.keys, self.buckets)
        store.write(self.read(spark), 0)
        return store


def partial_sums(path: str, aggregate: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores each batch's own aggregates; ``merge_partials`` adds them up.

    Nothing is held between batches, so rows may be late by any time, and a repeated batch overwrites its own folder.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return run


def merge_partials(partials: DataFrame, keys: list[str], sums: list[str] = (), least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """One row per key of stored partial aggregates: sums added, least and most taken."""
    parts = [(F.sum, sums), (F.min, least), (F.max, most)]
    return partials.groupBy(*keys).agg(*reduce(lambda a, b: a + b, [[f(c).alias(c) for c in names] for f, names in parts], []))


def change_partials(rows: DataFrame, width_us: int = 300_000_000) -> DataFrame:
    """A batch's own part of the tumbling aggregates of change events."""
    first = F.col("row_index") == 1
    start = F.col("event_epoch_us") - F.pmod(F.col("event_epoch_us"), F.lit(width_us))
    return rows.groupBy(start.alias("start_us"), "instance_id", "database_name", "table_name", "operation").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(first).alias("executions"),
        F.sum(F.when(first, F.col("execution_time_ms")).otherwise(0)).alias("exec_time_ms"),
        F.min("event_epoch_us").alias("first_us"),
        F.max("event_epoch_us").alias("last_us"),
    )


CHANGE_KEYS = ["start_us", "instance_id", "database_name", "table_name", "operation"]


def merged_changes(partials: DataFrame) -> DataFrame:
    return merge_partials(partials, CHANGE_KEYS, ["events", "executions", "exec_time_ms"], ["first_us"], ["last_us"])


def minute_partials(rows: DataFrame, keys: list[str], sums: list[str], time_us: str, width_us: int = 60_000_000) -> DataFrame:
    """A batch's own part of one-minute sums, with how many values were known."""
    start = F.col(time_us) - F.pmod(F.col(time_us), F.lit(width_us))
    return rows.groupBy(start.alias("start_us"), *keys).agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in sums], *[F.count(c).alias(f"{c}_known") for c in sums])


def merged_minutes(partials: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return merge_partials(partials, ["start_us", *keys], ["count", *sums, *[f"{c}_known" for c in sums]])


def binding_partials(rows: DataFrame) -> DataFrame:
    """First and last sighting of each binding in a batch."""
    return rows.groupBy("uid", "ip").agg(F.min("seen_us").alias("first_seen_us"), F.max("seen_us").alias("last_seen_us"))


def merged_bindings(partials: DataFrame, expire_before_us: int | None = None) -> DataFrame:
    """Bindings with first and last sighting; those not seen since ``expire_before_us`` go."""
    out = merge_partials(partials, ["uid", "ip"], (), ["first_seen_us"], ["last_seen_us"])
    return out if expire_before_us is None else out.filter(F.col("last_seen_us") >= expire_before_us)
