"""Event pages, details, row images as SQL, primary-key history, page unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import stab
from .filters import pk_match

NEWEST = ("event_epoch_us", "source_file_name", "end_position", "row_index", "event_id")
MAX_OFFSET = 100_000
#: How deep the row store answers pages.
ROW_STORE_DEPTH = 2_000


def _copy() -> list[Column]:
    return [F.coalesce("_content_revision", F.lit(0)).alias("revision"), F.coalesce("_source_part_key", F.lit("")).alias("part")]


def one_copy(df: DataFrame, key: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One row per event: the copy with the highest revision, then the last part key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.struct(*_copy()).desc()))
    return df.withColumn("_copy", rank).filter("_copy = 1").drop("_copy")


def _newest(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Whole rows of ``limit`` events behind the ``offset`` newest, one copy of each, in no order.

    Only ids, copies and sort columns are shuffled to find the page; its few keys then pick the whole rows.
    """
    rest = [c for c in NEWEST if c != "event_id"]
    best = df.select("event_id", F.struct(*_copy(), *rest).alias("_key")).groupBy("event_id").agg(F.max("_key").alias("_key"))
    page = best.orderBy(*[F.desc(c if c == "event_id" else f"_key.{c}") for c in NEWEST]).offset(offset).limit(limit)
    hit = df.withColumn("_key", F.struct(*_copy(), *rest)).join(F.broadcast(page), ["event_id", "_key"])  # ids come once in the page
    return hit.drop("_key").dropDuplicates(["event_id"])


def search_events(df: DataFrame, limit: int = 100, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    """A page of filtered events, newest first, with one row more than asked for: whether there is a next page."""
    if not 0 <= offset <= MAX_OFFSET or limit < 1:
        raise ValueError(f"offset must lie between 0 and {MAX_OFFSET}, limit above 0")
    page = _newest(df, limit + 1, offset).orderBy(*[F.desc(c) for c in NEWEST])
    return page.select(*columns) if columns else page


def row_store_page(df: DataFrame, limit: int = 100, offset: int = 0, columns: list[str] | None = None) -> DataFrame | None:
    """A page from the row store, which goes ``ROW_STORE_DEPTH`` rows deep; None beyond, where the facts must answer."""
    return None if offset + limit > ROW_STORE_DEPTH else search_events(df, limit, offset, columns)


def merge_pages(database_side: DataFrame, audit_side: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page over both sources, one row per event. Each side brings the rows that can reach the page, no more."""
    reach = offset + limit + 1
    both = _newest(database_side, reach).unionByName(_newest(audit_side, reach), allowMissingColumns=True)
    return search_events(both, limit, offset)


def search_slow(canonical: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return canonical.orderBy(F.desc("event_epoch_us"), F.desc("event_id")).offset(offset).limit(limit + 1)


def search_audit(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc("event_epoch_us"), F.desc("event_id")).offset(offset).limit(limit + 1)


def event_detail(df: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """Whole rows of the events named by ``ids(event_id)``.

    A task hashes its share of the ids and lets the rows pass by, so that only rows asked for are sorted. ``few``: the ids of a page go to every task instead.
    """
    asked = ids.select("event_id").distinct()
    return one_copy(df.join(F.broadcast(asked) if few else asked.hint("shuffle_hash"), "event_id", "left_semi"))


def with_statement_text(page: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Statement texts for the rows of a page only, from the hash dictionary; the page is the small side."""
    return page.join(dictionary, ["event_date", "row_query_hash"], "left")


def _literal(value: Column) -> Column:
    number = value.rlike(r"^-?\d+(\.\d+)?$")
    return F.when(value.isNull(), "NULL").when(number, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def render_sql(style: str = "parser") -> Column:
    """A row change as readable SQL. ``parser``: sorted columns, ``<=>``, LIMIT 1; ``rows``: image order, ``=``."""
    if style not in ("parser", "rows"):
        raise ValueError(style)
    parser = style == "parser"

    def entries(column: str) -> Column:
        found = F.map_entries(F.from_json(column, "map<string,string>"))
        return F.array_sort(found) if parser else found

    def name(e: Column) -> Column:
        return F.concat(F.lit("`"), e["key"], F.lit("`"))

    def pairs(column: str, joiner: str, sign: str) -> Column:
        return F.array_join(F.transform(entries(column), lambda e: F.concat(name(e), F.lit(sign), _literal(e["value"]))), joiner)

    target = F.concat(F.lit("`"), F.col("database_name"), F.lit("`.`"), F.col("table_name"), F.lit("`"))
    sign, tail = (" <=> ", F.lit(" LIMIT 1;")) if parser else (" = ", F.lit(";"))
    after = entries("after_json")
    insert = F.concat(F.lit("INSERT INTO "), target, F.lit(" ("), F.array_join(F.transform(after, name), ", "), F.lit(") VALUES ("), F.array_join(F.transform(after, lambda e: _literal(e["value"])), ", "), F.lit(");"))
    update = F.concat(F.lit("UPDATE "), target, F.lit(" SET "), pairs("after_json", ", ", " = "), F.lit(" WHERE "), pairs("before_json", " AND ", sign), tail)
    delete = F.concat(F.lit("DELETE FROM "), target, F.lit(" WHERE "), pairs("before_json", " AND ", sign), tail)
    return F.when(F.col("operation") == "INSERT", insert).when(F.col("operation") == "UPDATE", update).when(F.col("operation") == "DELETE", delete)


def pk_history(df: DataFrame, database: str, table: str, value: str) -> DataFrame:
    """Row changes of one primary key, with key-only images; an unknown match fails the query."""
    rows = df.filter((F.lower("database_name") == database.lower()) & (F.lower("table_name") == table.lower()) & F.col("operation").isin("INSERT", "UPDATE", "DELETE"))
    matched = rows.withColumn("_hit", pk_match(value))
    checked = matched.filter(F.when(F.col("_hit").isNull(), F.raise_error(F.lit("primary key unknown for a row change")).cast("boolean")).otherwise(F.col("_hit")))
    return checked.drop("_hit")


def sliced_source(full: DataFrame, archived: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of ``full`` outside and of ``archived`` inside the archived ``windows(instance_id, start_us, end_us)``."""
    w = windows.select("instance_id", F.col("start_us").alias("_lo"), (F.col("end_us") + 1).alias("_hi"))
    keys = ["instance_id", "event_epoch_us"]
    times = full.select(*keys).unionByName(archived.select(*keys))
    inside = stab(times, w, ["instance_id"], "event_epoch_us", "_lo", "_hi", {"_n": (F.lit(1), "sum")}).select(*keys)
    return full.join(inside, keys, "left_anti").unionByName(archived.join(inside, keys, "left_semi"), allowMissingColumns=True)


def running_sessions(df: DataFrame, limit: int = 200) -> DataFrame:
    """Sessions that run a statement, longest first."""
    idle = F.lower("command").isin("sleep", "daemon", "binlog dump", "binlog dump gtid")
    return df.filter(~idle & (F.col("sql_text") != "")).orderBy(F.desc("time_s"), "session_id").limit(limit)


def history_page(df: DataFrame, limit: int = 100, after: tuple[int, int, str] | None = None) -> DataFrame:
    """A page of session history by key-set cursor ``(holder, first_us, session_id)``, holders and newest first."""
    if after:
        key = F.struct("holder", "first_us", "session_id")
        df = df.filter(key < F.struct(*[F.lit(x) for x in after]))
    return df.orderBy(F.desc("holder"), F.desc("first_us"), F.desc("session_id")).limit(limit)


def with_default_database(statements: DataFrame, owners: DataFrame) -> DataFrame:
    """The database a statement runs in: from its text, else the only owner of its first table, else ambiguous; never
    guessed. ``owners``: ``database_name, table_name``."""
    from ..functions.scalar import default_database, strip_comments

    name = F.regexp_extract(strip_comments(F.col("sql_text")), r"(?i)\b(?:from|join|into|update|table)\s+`?([\w$]+)`?", 1)
    told = statements.withColumns({"_told": default_database(F.col("sql_text")), "_table": F.lower(name)})
    known = owners.groupBy(F.lower("table_name").alias("_table")).agg(F.count_distinct("database_name").alias("_n"), F.min("database_name").alias("_owner"))
    out = told.join(known, "_table", "left")
    own = F.col("_told.database")
    reason = F.when(own.isNotNull(), F.col("_told.reason")).when(F.col("_n") == 1, "unique_owner").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    return out.withColumns({"default_database": F.when(own.isNotNull(), own).when(F.col("_n") == 1, F.col("_owner")), "database_reason": reason}).drop("_told", "_table", "_n", "_owner")
