"""Which batches and buckets may hold a key: one-word Bloom filters, stored as rows and probed by an equi join.

Each stored batch has a filter: for every bucket ``words`` integers of 64 bits, a power of two that follows from the batch's size.
A key sets ``BITS`` bits of one word, so a probe is one lookup of (words, bucket, word). About ``64 / KEYS`` bits are spent on a
key, 4 bytes beside keys and digests of some hundred, and about one absent key in ten thousand is suspected of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that share a word on average, bits that a key sets, and the least words of a bucket.
KEYS, BITS, LEAST = 2, 6, 16
_SEED = 7


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored batches, or None before the first one."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _word(key: str, words: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 20), words)


def _mask(key: str) -> Column:
    own = F.xxhash64(F.lit(_SEED), key)
    mask = F.lit(0).cast("bigint")
    for n in range(BITS):
        place = F.shiftright(own, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def write_index(rows: DataFrame, path: str, batch_id: int, key: str, buckets: int) -> None:
    """Store the filter of one batch's ``rows``, which have ``_bucket``; a repeat overwrites it."""
    most = max(1, rows.count() // (buckets * KEYS))
    words = max(LEAST, 1 << (most - 1).bit_length())
    bits = rows.groupBy("_bucket", _word(key, F.lit(words)).alias("word")).agg(F.bit_or(_mask(key)).alias("bits"))
    bits.withColumn("words", F.lit(words)).write.mode("overwrite").partitionBy("words").parquet(f"{path}/batch={batch_id:012d}")


def suspected(rows: DataFrame, path: str, batch_id: int, key: str) -> DataFrame | None:
    """``batch, _bucket`` of the batches before ``batch_id`` that may hold a key of ``rows``; None where there are none."""
    index = existing(rows.sparkSession, path)
    if index is None:
        return None
    index = index.filter(F.col("batch") < batch_id)
    sizes = [r["words"] for r in index.select("words").distinct().collect()]  # powers of two
    if not sizes:
        return None
    keys = rows.select(key, "_bucket", F.explode(F.array(*[F.lit(n).cast("int") for n in sizes])).alias("words"))
    probes = keys.select("_bucket", "words", _word(key, F.col("words")).alias("word"), _mask(key).alias("mask")).distinct()
    return probes.join(index, ["words", "_bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("batch", "_bucket").distinct()


def folders(path: str, found: Iterable) -> list[str]:
    """The folders of what ``suspected`` found."""
    return [f"{path}/batch={r['batch']:012d}/_bucket={r['_bucket']}" for r in found]
