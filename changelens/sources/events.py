"""Sources and sinks of change events: NDJSON, evolving Parquet, clustered Parquet, CSV export, retention, text dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bucket
from ..schemas import CHANGE_EVENT, REQUIRED, struct_of, with_defaults, with_event_time

DAY_US = 86_400_000_000
UNIT = "\x1f"


def _failing(test, message: str, value):
    """``value``, or an error where ``test`` holds."""
    return F.when(test, F.raise_error(F.lit(message)).cast("bigint")).otherwise(value)


def read_change_ndjson(spark: SparkSession, path: str, *, file_id: str, instance_id: str, host_id: str, file_name: str) -> DataFrame:
    """Change events of NDJSON files: typed defaults for what lacks, capitals for operations, ids for blank ones.

    An event without a time fails the load. A blank id becomes a digest of file, positions, row and the operation as
    written.
    """
    raw = spark.read.schema(struct_of(CHANGE_EVENT)).json(path)
    blank = F.coalesce(F.trim("event_id"), F.lit("")) == ""
    parts = [F.lit(file_id), *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("start_position", "end_position", "row_index")], F.coalesce("operation", F.lit(""))]
    named = raw.withColumn("event_id", F.when(blank, F.sha2(F.concat_ws(UNIT, *parts), 256)).otherwise(F.col("event_id")))
    out = with_defaults(named, keep=False)
    op = F.upper(F.trim("operation"))
    out = out.withColumns(
        {
            "operation": F.when(op == "", "OTHER").otherwise(op),
            "instance_id": F.when(F.col("instance_id") == "", F.lit(instance_id)).otherwise(F.col("instance_id")),
            "host_instance_id": F.lit(host_id),
            "source_file_id": F.lit(file_id),
            "source_file_name": F.lit(file_name),
            "event_epoch_us": _failing(F.col("event_epoch_us") <= 0, "an event has no time", F.col("event_epoch_us")),
        }
    )
    return with_event_time(out)


def read_change_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Change events of Parquet files of any version: columns by name, absent ones with their defaults."""
    raw = spark.read.option("mergeSchema", True).parquet(*paths)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    out = with_defaults(raw)
    return out if "event_date" in out.columns else with_event_time(out)


def write_change_events(df: DataFrame, path: str, mode: str = "append", files_per_day: int = 1) -> None:
    """Write by UTC date, clustered by database, table, operation, 5-minute bucket and time, so that row groups prune.

    Days may be large: each is spread over ``files_per_day`` tasks by table.
    """
    rows = df if "event_date" in df.columns else with_event_time(df)
    salt = F.pmod(F.xxhash64(F.lower("database_name"), F.lower("table_name"), bucket(F.col("event_epoch_us"), 3_600_000_000)), F.lit(files_per_day))
    dealt = rows.withColumn("_salt", salt).repartition("event_date", "_salt").drop("_salt")
    order = [F.lower("database_name"), F.lower("table_name"), "operation", bucket(F.col("event_epoch_us")), "event_epoch_us", "end_position", "row_index"]
    dealt.sortWithinPartitions("event_date", *order).write.mode(mode).partitionBy("event_date").option("compression", "zstd").parquet(path)


def checked_write(df: DataFrame, path: str, files_per_day: int = 1) -> int:
    """``write_change_events`` that fails unless as many rows are read back as went in."""
    from pyspark.sql import Observation

    seen = Observation("written")
    write_change_events(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, "errorifexists", files_per_day)
    stored = df.sparkSession.read.parquet(path).count()
    if stored != seen.get["rows"]:
        raise RuntimeError(f"{seen.get['rows']} rows went in, {stored} came out")
    return stored


def split_statement_text(df: DataFrame, most: int = 65536) -> tuple[DataFrame, DataFrame]:
    """Facts with a hash of the statement's head in place of its text, and a dictionary of one text per date and hash."""
    head = F.substring("row_query", 1, most)
    hashed = F.when(F.col("row_query") == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(head))
    marked = df.withColumn("row_query_hash", hashed)
    words = marked.filter("row_query_hash <> 0").groupBy("event_date", "row_query_hash").agg(F.min(head).alias("row_query"))
    return marked.drop("row_query"), words


def row_store_rows(df: DataFrame) -> DataFrame:
    return df.filter("table_name <> '' OR operation = 'DDL'")


def write_slow_facts(df: DataFrame, path: str, files_per_month: int = 1) -> None:
    """The narrow slow-log facts, by month; a month is spread over ``files_per_month`` tasks by instance and day."""
    from ..schemas import SLOW_EVENT

    rows = with_defaults(df, SLOW_EVENT, keep=False).withColumn("month", F.date_format(F.timestamp_micros("event_epoch_us"), "yyyy-MM"))
    salt = F.pmod(F.xxhash64("instance_id", bucket(F.col("event_epoch_us"), DAY_US)), F.lit(files_per_month))
    rows.withColumn("_salt", salt).repartition("month", "_salt").drop("_salt").sortWithinPartitions("instance_id", "event_epoch_us").write.mode("append").partitionBy("month").parquet(path)


def csv_rows(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """At most ``max_rows`` newest events; text that a spreadsheet would run gets a leading quote."""
    newest = df.orderBy(F.desc("event_epoch_us"), F.desc("event_id")).limit(max_rows)
    safe = [F.when(F.ltrim(F.col(c)).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in newest.dtypes]
    return newest.select(*safe)


def export_csv(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    csv_rows(df, max_rows).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def apply_retention(spark: SparkSession, path: str, target: str, cutoff_us: int) -> None:
    """A copy of the dataset without what is older than the cutoff: old dates are not read, the straddling one is filtered."""
    day = F.to_date(F.timestamp_micros(F.lit(cutoff_us)))
    kept = spark.read.parquet(path).filter(F.col("event_date") >= day).filter((F.col("event_date") > day) | (F.col("event_epoch_us") >= cutoff_us))
    kept.write.mode("errorifexists").partitionBy("event_date").option("compression", "zstd").parquet(target)
