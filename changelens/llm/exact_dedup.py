"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Each normalised text is cut into fixed-size blocks. Equal blocks get one integer name; then the names of adjacent
blocks are paired and each distinct pair gets a name, level by level, until a document has one name. Documents have
equal texts exactly when level and name agree: names are given to contents (or to pairs of names), never to hashes.

Scale: texts are normalised and cut once, into a stored table. The contents of the blocks are shuffled once, after a
map-side count, to be sorted and named. Document rows carry a 64-bit hash to meet the names; hashes that stand for more
than one content are found at naming, and their blocks meet on content. Hot groups of copies are pre-aggregated where
names are made; a block or class that is more than a thousandth of all rows (so at most a thousand of them) is broadcast
to its rows, the rest meet by plain equi joins on narrow rows. Names and levels are stored tables, so a lost executor
never renames anything.

Defined results: null text counts as empty; empty texts form one class (no blocks, level -1); repeated rows are
members of their class each, of fully equal candidates exactly one is kept; null ids sort last; other columns of the
input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, join_counted, keep_rows, row_key, shared_folder, stash, table, unique_ids

BLOCK_BYTES = 2048


def normalised(text_col: str = "text") -> Column:
    """The text without white space, null as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANKS, "")


def _hash(bits: int) -> Column:
    h = F.xxhash64("block")
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sort order within each partition: partition number and rank, so unique and repeatable."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def cut_texts(docs: DataFrame, folder: str, unique: bool, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored ``row_key, doc_id, n, sha, blocks``: each normalised text in blocks, empty texts without any."""
    data = docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(unique, id_col, text_col).alias("row_key"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        F.encode(normalised(text_col), "utf-8").alias("data"),
    )
    n_blocks = F.ceil(F.octet_length("data") / block_bytes).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n_blocks), lambda i: F.substring("data", (i - 1) * block_bytes + 1, F.lit(block_bytes)))
    none = F.array().cast("array<binary>")
    return stash(data.select("row_key", "doc_id", "n", F.unhex(F.sha2("data", 256)).alias("sha"), F.when(F.octet_length("data") > 0, cut).otherwise(none).alias("blocks")), folder, "texts")


def name_documents(texts: DataFrame, folder: str, hash_bits: int = 64) -> DataFrame:
    """``(row_key, level, name)``: one collision-free identity for each key of ``texts(row_key, blocks)``."""
    blocks = texts.select("row_key", F.posexplode("blocks").alias("pos", "block"))
    contents = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    names = stash(_named(contents, ["block"]).select(_hash(hash_bits).alias("h"), "name", "rows"), folder, "names0")
    met = stash(names.groupBy("h").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")), folder, "met0")
    placed = stash(blocks.select("row_key", "pos", _hash(hash_bits).alias("h")), folder, "placed")
    level = join_counted(placed, met.filter("n = 1").select("h", "name", "rows"), "h", "rows").select("row_key", "pos", "name")
    clashes = met.filter("n > 1").select("h")
    if not clashes.isEmpty():
        doubtful = blocks.withColumn("h", _hash(hash_bits)).join(clashes, "h", "left_semi")
        own = stash(_named(doubtful.select("block").distinct(), ["block"]).select("block", (-F.col("name") - 1).alias("name")), folder, "names0-content")
        level = level.unionByName(doubtful.join(own, "block").select("row_key", "pos", "name"))

    found = []
    k = 0
    level = stash(level, folder, "level0")
    while True:
        # Pairs of neighbours; a document whose only name is at position 0 is finished.
        pairs = level.groupBy("row_key", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos").bitwiseAND(F.lit(1)) == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos").bitwiseAND(F.lit(1)) == 1, F.col("name"))).alias("b"),
        )
        alone = level.groupBy("row_key").agg(F.max("pos").alias("last"), F.max("name").alias("name")).filter("last = 0")
        found.append(alone.select("row_key", F.lit(k).alias("level"), "name"))
        longer = level.filter("pos > 0").select("row_key").distinct()
        pairs = stash(pairs.join(longer, "row_key", "left_semi"), folder, f"pairs{k}")
        if pairs.isEmpty():
            break
        k += 1
        named = stash(_named(pairs.select("a", "b").distinct(), ["a", "b"]), folder, f"names{k}")
        joined = pairs.select("row_key", "pos", "a", F.coalesce("b", F.lit(-(2**62))).alias("b")).join(named.select("a", F.coalesce("b", F.lit(-(2**62))).alias("b"), "name"), ["a", "b"])
        level = stash(joined.select("row_key", "pos", "name"), folder, f"level{k}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row_key``.

    Of a class the row with the most code points in its original text stays, then the smallest id.
    """
    folder = shared_folder(docs.sparkSession)
    unique = unique_ids(docs, id_col)
    rows = cut_texts(docs, folder, unique, id_col, text_col, block_bytes)
    ids = name_documents(rows, folder, hash_bits)
    member = rows.drop("blocks").join(ids, "row_key", "left").select("doc_id", "row_key", "n", "sha", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("name", F.lit(-1)).alias("name"))
    # several rows may agree in length and id, so that each needs a number, which is stored with it
    member = stash(member if unique else member.withColumn("number", F.monotonically_increasing_id()), folder, "members")
    first = [] if unique else [F.col("row_key").alias("key"), F.col("number").alias("number")]
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), *first)
    classes = stash(member.groupBy("level", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")), folder, "classes")
    out = join_counted(member, classes, ["level", "name"], "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (-F.col("n") == F.col("best.n")) if unique else F.col("number") == F.col("best.number")
    return out.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each class of equal texts."""
    keys = exact_classes(docs, id_col, text_col, block_bytes).filter("kept").select("row_key")
    return keep_rows(docs, keys, unique_ids(docs, id_col), id_col, text_col)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents")).drop("row_key")


OP4_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     h AS (SELECT doc_id, n, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
