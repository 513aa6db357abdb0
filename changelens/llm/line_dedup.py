"""Removal of lines that many sites share, found by the spread of distinct sites.

A line is the text between newlines, trimmed of blanks; blank lines are left alone. For each line hash one HyperLogLog
sketch of the sites is built and merged by aggregation. Lines whose estimate lies clearly above the limit are
boilerplate, lines clearly below are not, and those near it get an exact distinct count. Boilerplate lines go from every
document.

Scale: sketches are merged on the map side, so a line in a third of all documents sends one sketch per task, and only
lines near the limit bring their sites. Lines themselves are never shuffled: 128-bit hashes and positions are, and the
joins are equi joins that adaptive execution can split. Documents are shuffled once, to meet the places to remove.

Defined results: a null site counts for no line; null text stays null with no lines; repeated rows are treated
alike; a document may lose all of its lines and then keeps its blank ones; other columns are ignored; empty tables are
allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, shared_folder, stash, table, unique_ids

MIN_SITES = 6
LOG_K = 12
#: Estimates within this share of the limit are counted exactly: over ten standard errors of a sketch of 2^12 registers.
BAND = 0.25
TRIM = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame, unique: bool, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``(row_key, site, at, h1, h2)`` for each line that is not blank."""
    cut = docs.select(row_key(unique, id_col, text_col).alias("row_key"), F.col(site_col).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("at", "raw"))
    cut = cut.withColumn("line", F.trim("raw", F.lit(TRIM))).filter("line <> ''")
    return cut.select("row_key", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, folder: str, min_sites: int = MIN_SITES, log_k: int = LOG_K, band: float = BAND) -> DataFrame:
    """``(h1, h2)`` of the lines on at least ``min_sites`` distinct sites."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.col("site").cast("string"), log_k).alias("sketch"))
    estimated = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("n")).filter(F.col("n") >= min_sites * (1 - band))
    estimated = stash(estimated, folder, "spread")
    sure = estimated.filter(F.col("n") > min_sites * (1 + band)).select("h1", "h2")
    near = estimated.filter(F.col("n") <= min_sites * (1 + band)).select("h1", "h2")
    sites = lines.select("h1", "h2", "site").filter("site IS NOT NULL").join(near, ["h1", "h2"], "left_semi").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    return stash(sure.unionByName(exact), folder, "boilerplate")


def remove_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, log_k: int = LOG_K, band: float = BAND) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, text``: the text without its boilerplate lines."""
    folder = shared_folder(docs.sparkSession)
    unique = unique_ids(docs, id_col)
    lines = lines_of(docs, unique, id_col, text_col, site_col)
    shared = boilerplate(lines, folder, min_sites, log_k, band)
    places = lines.select("row_key", "at", "h1", "h2").join(shared, ["h1", "h2"], "left_semi").groupBy("row_key").agg(F.collect_set("at").alias("gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(unique, id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, texts = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = [] if text is None else text.split("\n")
                away = set(gone or ())
                n_lines.append(sum(1 for x in own if x.strip(TRIM)))
                n_removed.append(len(away))
                texts.append("\n".join(x for i, x in enumerate(own) if i not in away) if away else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    return rows.join(places, "row_key", "left").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_lines long, n_removed long, text string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_lines(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH cut AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
     lines AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM cut),
     shared AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
     marked AS (SELECT lines.*, line IN (SELECT line FROM shared) AS gone FROM lines),
     joined AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
                       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, joined.text FROM documents LEFT JOIN joined USING (doc_id)
"""
