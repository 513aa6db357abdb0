"""Sharding by a two-pass external shuffle, in DataFrame operations only.

First pass: a seeded hash scatters the records into buckets that a task can hold. The shard of a record follows from its
id and the number of shards alone (law ``key``): of the steps b = 0, 1, ..., n - 1 a record moves to shard b with chance
1 / (b + 1), by a hash of seed, step and id, and its last move counts. With one more shard only the last step is new, so
records move only into the new shard. A shard larger than ``bucket_bytes`` is scattered further, by a second hash, into
as many buckets as it takes. Second pass: each bucket is put in order, shuffled by Fisher-Yates (Spark's seeded
``shuffle``) and laid down; its records' slots follow those of the shard's earlier buckets.

Slots follow from seed and records alone: Spark's ``shuffle`` draws from its seed, the number of the task and the task's
earlier rows, so each bucket is sent to a task by number, in numbers that the data fix, and lies at a fixed place in it.

Scale: one shuffle of the carried columns and one of the bucket counts. Bucket counts follow the bytes, so that no task
holds more than about ``bucket_bytes`` of records, and equal texts with different ids spread over all shards. Where ids
repeat, records that are equal in all columns are counted first; of those that repeat more than ``PILE`` times one is
carried with its count and dealt out again as numbered copies, so that they spread over the shard's buckets.

Defined results: null text counts as no bytes and crc32 0; null ids share one shard; repeated rows get slots of their
own; an empty table gives an empty result; carried columns keep their names inside ``record``, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stash, table, unique_ids

SHARDS = 40
SEED = 20
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16
#: Equal records beyond this number are dealt out by number.
PILE = 1000
#: Buckets go to tasks one by one up to this many tasks.
TASKS = 20_000


def shard_of(id_col: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of an id: the last step at which its seeded hash calls for a move."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda b: F.pmod(F.xxhash64(F.lit(seed), b, id_col), b + 1) == 0)
    return F.array_max(steps)


def _copies(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``copy``: 0, but a number of its own for each of more than ``PILE`` records equal in all columns."""
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    marked = rows.withColumn("digest", digest)
    often = stash(marked.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > PILE), folder, "often")
    few = marked.join(often, "digest", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("copy"))
    one = marked.join(often, "digest", "left_semi").groupBy("digest").agg(F.first(F.struct(*rows.columns)).alias("row"))
    many = one.join(often, "digest").select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return few.unionByName(many)


def shard_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row per record: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and, with ``carry``, a struct ``record``."""
    folder = shared_folder(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    own = [F.struct(*carry).alias("record")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *own)
    rows = rows.withColumn("copy", F.lit(0).cast("long")) if unique_ids(docs, id_col) else _copies(rows, folder)
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards, seed))
    narrow = stash(rows.drop("record"), folder, "sizes") if not carry else rows.drop("record")
    largest = narrow.groupBy("shard").agg(F.sum("size").alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    buckets = max(1, -(-largest // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "copy"), F.lit(buckets)).cast("int")
    counts = narrow.groupBy("shard", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stash(counts.select("shard", "bucket", before.alias("before")), folder, "starts")

    order = F.xxhash64(F.lit(seed + 2), "doc_id", "text_crc32", "copy").alias("order")
    records = (rows if carry else narrow).select("shard", bucket.alias("bucket"), F.struct(order, "doc_id", "size", "text_crc32", *(["record"] if carry else [])).alias("r"))
    each = -(-shards * buckets // TASKS)
    task = F.floor((F.col("shard") * buckets + F.col("bucket")) / each).cast("int")
    dealt = records.withColumn("task", task).repartitionById(-(-shards * buckets // each), "task")
    piles = dealt.groupBy("task", "shard", "bucket").agg(F.collect_list("r").alias("pile"))
    by_hash = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).when(a["text_crc32"] < b["text_crc32"], -1).when(a["text_crc32"] > b["text_crc32"], 1).otherwise(0)  # noqa: E731  carried columns need no order
    piles = piles.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle(F.array_sort("pile", by_hash), seed).alias("pile"))
    laid = piles.join(F.broadcast(starts) if shards * buckets <= TASKS else starts, ["shard", "bucket"]).select("shard", "before", F.posexplode("pile").alias("at", "r"))
    return laid.select(
        "r.doc_id",
        "r.size",
        "r.text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("at")).cast("long").alias("slot"),
        shard_of(F.col("r.doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
        *(["r.record"] if carry else []),
    )


def _free(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to differ from all columns."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the whole records as Parquet, a folder for each shard, rows in slot order within each file; ``_slot`` tells the place.

    Where the records have columns of the names ``_shard`` or ``_slot``, the added ones get further underscores.
    """
    laid = shard_records(docs, id_col, text_col, shards, seed, bucket_bytes, carry=docs.columns)
    shard, slot = _free("_shard", docs.columns), _free("_slot", docs.columns)
    out = laid.select(F.col("shard").alias(shard), F.col("slot").alias(slot), "record.*")
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records go through both passes; the digest is taken from the records as they were laid down."""
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("record.text", F.lit("")), "utf-8")
    laid = shard_records(docs, carry=docs.columns)
    digest = {"doc_id": F.col("record.doc_id"), "size": (F.octet_length(text) + ROW_BYTES).cast("long"), "text_crc32": F.crc32(text)}
    return laid.withColumns(digest).drop("record")
