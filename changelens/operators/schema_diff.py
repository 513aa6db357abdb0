"""Comparison of two schema snapshots: tables, columns, indexes, foreign keys, options, with the risk of each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the families of column types; a change to a wider member of a family is safe.
FAMILIES = (
    ("tinyint", "integer", 1), ("smallint", "integer", 2), ("mediumint", "integer", 3), ("int", "integer", 4), ("bigint", "integer", 5),
    ("float", "real", 1), ("double", "real", 2),
    ("tinytext", "text", 1), ("text", "text", 2), ("mediumtext", "text", 3), ("longtext", "text", 4),
    ("tinyblob", "blob", 1), ("blob", "blob", 2), ("mediumblob", "blob", 3), ("longblob", "blob", 4),
)


def _definition(*parts: str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts])


def _compare(source: DataFrame, target: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Objects that differ, full outer by key; fields of both sides with prefixes ``s_`` and ``t_``."""
    s = source.select(*keys, *[F.col(f).alias(f"s_{f}") for f in fields], _definition(*fields).alias("_s"))
    t = target.select(*keys, *[F.col(f).alias(f"t_{f}") for f in fields], _definition(*fields).alias("_t"))
    both = s.join(t, keys, "full_outer")
    change = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("_s") != F.col("_t"), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").drop("_s", "_t")


def _of(kind: Column, what: int) -> Column:
    base = F.regexp_extract(F.lower(kind), r"^([a-z]+)", 1)
    pairs = [F.lit(x) for f in FAMILIES for x in (f[0], f[what])]
    return F.create_map(*pairs)[base]


def type_risk(old: Column, new: Column) -> Column:
    """safe for a widening within a family, risky for anything else that changes the type."""
    low, high = F.lower(old), F.lower(new)
    unsigned = high.contains("unsigned") == low.contains("unsigned")
    size = [F.regexp_extract(x, r"\((\d+)", 1).cast("int") for x in (low, high)]
    same_base = F.regexp_extract(low, r"^([a-z]+)", 1) == F.regexp_extract(high, r"^([a-z]+)", 1)
    numeric = _of(old, 1).eqNullSafe(_of(new, 1)) & _of(old, 1).isNotNull()
    scale = [F.regexp_extract(x, r",\s*(\d+)\)", 1) for x in (low, high)]
    wider = F.when(numeric, _of(new, 2) >= _of(old, 2)).otherwise(same_base & F.coalesce(size[1] >= size[0], size[0].isNull() & size[1].isNull()) & (scale[0] == scale[1]))
    return F.when(low == high, "none").when(unsigned & F.coalesce(wider, F.lit(False)), "safe").otherwise("risky")


def diff_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Column differences (what the target must become is the source), with risk."""
    fields = ["column_type", "nullable", "default_value", "extra", "comment", "collation"]
    out = _compare(source, target, ["database_name", "table_name", "name"], fields)
    strict = F.col("t_nullable") & ~F.col("s_nullable")
    moved = ~F.col("s_collation").eqNullSafe(F.col("t_collation"))
    risk = (
        F.when(F.col("change") == "missing", F.when(F.col("s_nullable") | F.col("s_default_value").isNotNull(), "safe").otherwise("risky"))
        .when(F.col("change") == "extra", "risky")
        .when(strict | moved | (type_risk(F.col("t_column_type"), F.col("s_column_type")) == "risky"), "risky")
        .otherwise("safe")
    )
    name = F.concat(F.lit("`"), F.col("name"), F.lit("`"))
    spec = F.concat_ws(" ", name, F.col("s_column_type"), F.when(~F.col("s_nullable"), "NOT NULL"), F.when(F.col("s_default_value").isNotNull(), F.concat(F.lit("DEFAULT '"), F.col("s_default_value"), F.lit("'"))))
    ddl = F.when(F.col("change") == "missing", F.concat(F.lit("ADD COLUMN "), spec)).when(F.col("change") == "extra", F.concat(F.lit("DROP COLUMN "), name)).otherwise(F.concat(F.lit("MODIFY COLUMN "), spec))
    return out.withColumns({"risk": risk, "ddl": ddl})


def diff_indexes(source: DataFrame, target: DataFrame) -> DataFrame:
    out = _compare(source, target, ["database_name", "table_name", "name"], ["is_unique", "index_type", "parts"])
    risk = F.when((F.col("change") != "extra") & F.col("s_is_unique"), "risky").when(F.col("change") == "missing", "safe").otherwise("risky")
    return out.withColumn("risk", risk)


def diff_foreign_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    return _compare(source, target, ["database_name", "table_name", "name"], ["columns", "referenced_table", "referenced_columns", "rules"]).withColumn("risk", F.lit("risky"))


def diff_options(source: DataFrame, target: DataFrame) -> DataFrame:
    out = _compare(source, target, ["database_name", "table_name"], ["engine", "collation", "row_format", "comment"])
    only_comment = F.col("s_engine").eqNullSafe(F.col("t_engine")) & F.col("s_collation").eqNullSafe(F.col("t_collation")) & F.col("s_row_format").eqNullSafe(F.col("t_row_format"))
    return out.withColumn("risk", F.when((F.col("change") == "changed") & only_comment, "safe").when(F.col("change") == "missing", "safe").otherwise("risky"))


def diff_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables missing in or extra to the target."""
    keys = ["database_name", "table_name"]
    s, t = (x.select(*keys).distinct() for x in (source, target))
    return s.join(t, keys, "left_anti").withColumn("change", F.lit("missing")).unionByName(t.join(s, keys, "left_anti").withColumn("change", F.lit("extra")))


def schema_diff(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All differences by kind; both sides map columns, indexes, foreign_keys and tables to snapshots."""
    return {
        "tables": diff_tables(source["tables"], target["tables"]),
        "columns": diff_columns(source["columns"], target["columns"]),
        "indexes": diff_indexes(source["indexes"], target["indexes"]),
        "foreign_keys": diff_foreign_keys(source["foreign_keys"], target["foreign_keys"]),
        "options": diff_options(source["tables"], target["tables"]),
    }
