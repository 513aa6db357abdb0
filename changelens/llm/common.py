"""Helpers shared by the corpus operators: stored intermediate tables, row keys, word tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`, the white space of the text contracts.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can read and write.

    Where the setting is absent (tests on one machine) a temporary folder is used and remembered in the session;
    on a cluster its absence is an error, since executors do not share local disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/changelens-{uuid.uuid4().hex}"


def stash(df: DataFrame, folder: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether ``id_col`` names every row: no repeats and no nulls (one narrow aggregation)."""
    repeats = docs.groupBy(F.col(id_col).alias("id")).count().filter("id IS NULL OR count > 1")
    return repeats.isEmpty()


def row_key(unique: bool, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A non-null key of a row: the id where ids are unique, else a digest of id and text.

    Rows that agree in id and text share the digest, and with it every result that follows from the text.
    """
    if unique:
        return F.col(id_col)
    return F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit(""))), 256)


def keep_rows(docs: DataFrame, keys: DataFrame, unique: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys`` (one column, ``row_key``), one row per key, in the columns of ``docs``."""
    if unique:
        return docs.join(keys.select(F.col("row_key").alias(id_col)), id_col, "left_semi").select(docs.columns)
    marked = docs.select(F.struct(*docs.columns).alias("row"), row_key(False, id_col, text_col).alias("row_key"))
    kept = marked.join(keys, "row_key", "left_semi").dropDuplicates(["row_key"])
    return kept.select("row.*")


def join_counted(rows: DataFrame, counted: DataFrame, on: str | list[str], count_col: str) -> DataFrame:
    """Inner join of stored tables where ``counted`` has one row per key and, as ``count_col``, how many of ``rows`` have it.

    Keys of more than a thousandth of the rows are broadcast, which are at most a thousand; the rest meet by shuffle, so
    no key brings more than a thousandth of all rows to one task.
    """
    total = counted.agg(F.sum(count_col)).first()[0] or 0
    hot = counted.filter(F.col(count_col) > total / 1000)
    keys = [on] if isinstance(on, str) else on
    often = rows.join(F.broadcast(hot), keys)
    seldom = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(counted.filter(F.col(count_col) <= total / 1000), keys)
    return often.unionByName(seldom)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
