"""Queries on coverage, freshness, verification, schemas and client identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import schema_diff, sessions
from . import inputs as i
from .registry import DAY, HOUR, START, over_changes, register

# Coverage


def _files(spark, d) -> DataFrame:
    """Orders as log files of their priority: half a day long from their date, in four states."""
    o = i.table(spark, d, "orders")
    lo = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("collecting")
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 20).cast("string")).alias("instance_id"), lo.alias("lo"), (lo + DAY // 2).alias("hi"), state.alias("state"))


_FILES = f"f AS (SELECT o_orderkey AS id, o_orderpriority || '-' || (o_custkey % 20) AS instance_id, epoch_us(o_orderdate) AS lo, epoch_us(o_orderdate) + {DAY // 2} AS hi, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'collecting' END AS state FROM orders)"
_A, _B = 788_918_400_000_000, 946_684_800_000_000  # 1995 to 2000


@register(f"""WITH {_FILES}, d AS (SELECT DISTINCT instance_id, lo, hi FROM f WHERE state = 'done'), m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY instance_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {DAY} THEN 0 ELSE 1 END AS n FROM d),
  r AS (SELECT *, sum(n) OVER (PARTITION BY instance_id ORDER BY lo) AS run FROM m) SELECT instance_id, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY instance_id, run""")
def covered_spans(spark, d):
    """Spans of files that were taken in; a day apart counts as touching."""
    files = _files(spark, d)
    return cov.covered_spans(files, files.filter("state = 'done'"), DAY)


_SPANS = f"""{_FILES}, dn AS (SELECT DISTINCT instance_id, lo, hi FROM f WHERE state = 'done'), mk AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY instance_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2000000 THEN 0 ELSE 1 END AS n FROM dn),
rn AS (SELECT *, sum(n) OVER (PARTITION BY instance_id ORDER BY lo) AS run FROM mk), sp AS (SELECT instance_id, greatest(min(lo), {_A}) AS lo, least(max(hi), {_B}) AS hi FROM rn GROUP BY instance_id, run HAVING greatest(min(lo), {_A}) < least(max(hi), {_B}))"""


@register(f"""WITH {_SPANS}, ed AS (SELECT instance_id, lo, hi FROM sp UNION ALL SELECT DISTINCT instance_id, {_A}, {_A} FROM f),
  gp AS (SELECT instance_id, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY instance_id ORDER BY lo, hi), {_B}) AS hi FROM ed QUALIFY hi < coalesce(lead(ed.lo) OVER (PARTITION BY instance_id ORDER BY ed.lo, ed.hi), {_B})),
  lm AS (SELECT instance_id, max(hi) AS last, min(lo) AS first FROM f GROUP BY 1),
  rs AS (SELECT g.instance_id, g.lo, g.hi, CASE WHEN bool_or(w.state = 'collecting') THEN 'collecting' WHEN bool_or(w.state = 'pending') THEN 'pending' WHEN g.lo >= any_value(last) THEN 'not_collected_yet' WHEN g.hi <= any_value(first) THEN 'no_data' ELSE 'source_unlisted' END AS reason
    FROM gp g JOIN lm USING (instance_id) LEFT JOIN f w ON w.instance_id = g.instance_id AND w.state <> 'done' AND w.lo < g.hi AND w.hi > g.lo GROUP BY 1, 2, 3)
  SELECT *, hi - lo AS span_us FROM rs UNION ALL SELECT instance_id, lo, hi, 'covered', hi - lo FROM sp""")
def coverage_runs(spark, d):
    """Five years as covered runs and gaps with reasons."""
    files = _files(spark, d)
    return cov.coverage_runs(files, files.filter("state = 'done'"), _A, _B)


@register(f"""WITH {_FILES}, p AS (SELECT instance_id, 'h' || (row_number() OVER w % 2) AS host, lo, coalesce(lead(lo) OVER w, {_B * 2}) AS hi FROM (SELECT instance_id, lo FROM f WHERE state = 'collecting' GROUP BY 1, 2) WINDOW w AS (PARTITION BY instance_id ORDER BY lo))
  SELECT id FROM f SEMI JOIN p ON p.instance_id = f.instance_id AND p.host = 'h' || (f.id % 2) AND f.lo < p.hi AND f.hi > p.lo""")
def accepted_files(spark, d):
    """Files of the host that was primary then; each unfinished file marks a switch between two hosts."""
    files = _files(spark, d).withColumn("host", F.concat(F.lit("h"), (F.col("id") % 2).cast("string")))
    w = Window.partitionBy("instance_id").orderBy("lo")
    switches = files.filter("state = 'collecting'").select("instance_id", "lo").distinct()
    primary = switches.select("instance_id", F.concat(F.lit("h"), (F.row_number().over(w) % 2).cast("string")).alias("host"), "lo", F.coalesce(F.lead("lo").over(w), F.lit(2 * _B)).alias("hi"))
    return cov.accept_files(files, primary).select("id")


@register(f"""WITH f AS (SELECT o_custkey % 50 AS instance_id, epoch_us(o_orderdate) AS created_us, CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) * 1000000 END AS took FROM orders),
  m AS (SELECT *, (created_us - lag(created_us) OVER (PARTITION BY instance_id ORDER BY created_us)) / 1000000 AS gap FROM f), g AS (SELECT instance_id, count(took) AS done, count(*) FILTER (took IS NULL) AS waiting, count(gap) AS gaps, median(took / 1000000) AS m, median(gap) AS g FROM m GROUP BY 1)
  SELECT instance_id, done, waiting, CASE WHEN done >= 4 THEN round(m, 6) END AS seconds_per_file, CASE WHEN gaps >= 3 THEN round(g, 6) END AS arrival_s, CASE WHEN done >= 4 THEN round(m * waiting, 3) END AS eta_s FROM g""")
def throughput_estimate(spark, d):
    o = i.table(spark, d, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    files = o.select((F.col("o_custkey") % 50).alias("instance_id"), at.alias("created_us"), at.alias("started_us"), F.when(F.col("o_orderstatus") != "O", at + F.floor("o_totalprice").cast("bigint") * 1_000_000).alias("done_us"))
    out = cov.sync_estimate(files)
    return out.select("instance_id", "done", "waiting", F.round("seconds_per_file", 6).alias("seconds_per_file"), F.round("arrival_s", 6).alias("arrival_s"), F.round("eta_s", 3).alias("eta_s"))


_NOW = START + 29 * DAY + 12 * HOUR


@register(f"""WITH b AS (SELECT DISTINCT user_id AS source FROM events UNION SELECT -1), l AS (SELECT user_id AS source, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1)
  SELECT source, last_us, CASE WHEN last_us IS NULL THEN 'warming' WHEN last_us > {_NOW} THEN 'invalid' WHEN {_NOW} - last_us > {6 * HOUR} THEN 'stale' ELSE 'ok' END AS status FROM b LEFT JOIN l USING (source)""")
def source_freshness(spark, d):
    """Users as sources at noon of the last day; one has sent nothing."""
    e = i.table(spark, d, "events").select(F.col("user_id").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    budgets = e.select("source").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("source"))).withColumn("budget_us", F.lit(6 * HOUR))
    return cov.source_freshness(e, _NOW, budgets)


@register(f"""WITH f AS (SELECT o_custkey % 50 AS instance_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'lost' END AS state, epoch_us(o_orderdate) AS hi, o_orderkey % 7 AS attempts FROM orders), r AS (SELECT o_custkey % 50 AS instance_id, max(epoch_us(o_orderdate)) AS stored FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
  g AS (SELECT instance_id, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state <> 'done' AND attempts >= 5) AS stuck, min(hi) FILTER (state = 'pending') AS oldest_pending_us, max(hi) FILTER (state = 'done') AS newest_done_us, count(*) FILTER (state = 'lost' AND hi >= {_B} - 86400000000) AS lost_day FROM f GROUP BY 1)
  SELECT g.*, CAST((newest_done_us - stored) // 1000000 AS BIGINT) AS behind_s, coalesce((newest_done_us - stored) // 1000000 <= 3600 AND stuck = 0, false) AS healthy FROM g LEFT JOIN r USING (instance_id)""")
def backlog_health(spark, d):
    o = i.table(spark, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).withColumn("instance_id", F.col("o_custkey") % 50)
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("lost")
    files = o.select("instance_id", state.alias("state"), F.col("us").alias("hi"), (F.col("o_orderkey") % 7).alias("attempts"))
    rows = o.filter("o_orderpriority = '1-URGENT'").select("instance_id", F.col("us").alias("event_epoch_us"))
    return cov.backlog_health(files, rows, _B).select("instance_id", "pending", "stuck", "oldest_pending_us", "newest_done_us", "lost_day", "behind_s", "healthy")


@register(over_changes("SELECT count(*) AS events, count(DISTINCT strftime(make_timestamp(event_epoch_us), '%Y-%m-%d')) AS parts, min(event_epoch_us) AS oldest_us, max(event_epoch_us) AS latest_us FROM ev"))
def dataset_statistics(spark, d):
    return cov.dataset_stats(cov.part_catalog(i.change_events(spark, d).withColumn("_source_part_key", F.lit("p"))))


@register("""WITH s AS (SELECT l_suppkey AS path, count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS h FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey AS path, count(*) FILTER (l_returnflag <> 'R' OR l_linenumber <> 7) AS rows, CAST(sum(l_partkey) AS BIGINT) AS h FROM lineitem GROUP BY 1 HAVING min(l_quantity) < 2)
  SELECT CAST(path AS VARCHAR) AS path, s.rows AS s_rows, t.rows AS t_rows, CASE WHEN t.path IS NULL THEN 'missing' ELSE 'different' END AS status FROM s LEFT JOIN t USING (path) WHERE t.path IS NULL OR s.rows <> t.rows""")
def verified_parts(spark, d):
    """Suppliers as parts: the other inventory lacks those without a small order, and counts some lines differently."""
    lines = i.table(spark, d, "lineitem")
    by = F.col("l_suppkey").cast("string").alias("path")
    digest = F.sum("l_partkey").cast("string").alias("sha256")
    source = lines.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), digest, F.lit(1).alias("revision"))
    target = lines.groupBy(by).agg(F.count_if((F.col("l_returnflag") != "R") | (F.col("l_linenumber") != 7)).alias("rows"), digest, F.lit(1).alias("revision"), F.min("l_quantity").alias("least")).filter("least < 2")
    return cov.verify_parts(source, target).select("path", "s_rows", "t_rows", "status")


@register("""WITH r AS (SELECT o_custkey AS case_id, o_orderpriority AS family, row_number() OVER (PARTITION BY o_custkey ORDER BY max(o_totalprice) DESC) AS rank FROM orders GROUP BY 1, 2), t AS (SELECT c_custkey AS case_id, unnest(['1-URGENT', '5-LOW']) AS family, unnest([2, 3]) AS max_rank FROM customer)
  SELECT case_id, min(coalesce(rank <= max_rank, false)) AS passed, max(rank) AS worst_rank, count(*) FILTER (rank IS NULL) AS missing FROM t LEFT JOIN r USING (case_id, family) GROUP BY 1""")
def ranking_backtest(spark, d):
    """Customers as cases: their urgent orders should rank first or second, the low ones among three."""
    o = i.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("family")).agg(F.max("o_totalprice").alias("most"))
    ranking = o.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("most"))))
    truth = i.table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.array(F.struct(F.lit("1-URGENT").alias("family"), F.lit(2).alias("max_rank")), F.struct(F.lit("5-LOW").alias("family"), F.lit(3).alias("max_rank")))).alias("x")).select("case_id", "x.*")
    return cov.backtest(ranking, truth)


@register("""WITH a AS (SELECT c_nationkey AS nation, c_mktsegment = 'BUILDING' AS big FROM customer), b AS (SELECT s_nationkey AS nation, s_acctbal > 0 AS big FROM supplier), x AS (SELECT *, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT *, count(*) AS n FROM b GROUP BY 1, 2),
  d AS (SELECT coalesce(x.nation, y.nation) AS nation, coalesce(x.big, y.big) AS big, coalesce(x.n, 0) - coalesce(y.n, 0) AS n FROM x FULL JOIN y ON x.nation = y.nation AND x.big = y.big) SELECT nation, big, CASE WHEN n > 0 THEN 'first' ELSE 'second' END AS only_in, abs(n) AS times FROM d WHERE n <> 0""")
def row_differences(spark, d):
    """Customers and suppliers as two answers to one question."""
    a = i.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_mktsegment") == "BUILDING").alias("big"))
    return cov.row_differences(a, i.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("big")))


@register(over_changes("""
, n AS (SELECT *, row_number() OVER (ORDER BY event_epoch_us DESC, event_id, sql_text) - 1 AS n FROM ev),
h AS (SELECT table_name, sha256(n || ':' || CAST(to_json({'c0': event_id, 'c1': sql_text}) AS VARCHAR)) AS h FROM n),
d AS (SELECT table_name, count(*) AS rows, sum(CAST('0x' || h[1:15] AS HUGEINT)) AS a, sum(CAST('0x' || h[16:30] AS HUGEINT)) AS b FROM h GROUP BY 1)
SELECT table_name, rows, sha256(rows || ',' || a || ',' || b) AS digest FROM d"""))
def ordered_digests(spark, d):
    """All change events, newest first: for each table a digest of its rows and their places."""
    return cov.ordered_digest(i.change_events(spark, d), ["event_id", "sql_text"], [F.desc("event_epoch_us")], ["table_name"])


@register(f"""WITH {_SPANS}, w AS (SELECT instance_id, id, lo + {DAY // 4} AS start_us, lo + {DAY} AS end_us FROM f)
  SELECT w.id, CASE WHEN w.end_us <= sp.hi THEN w.start_us WHEN sp.hi - sp.hi % {HOUR} > w.start_us THEN w.start_us END AS aligned_start_us, CASE WHEN w.end_us <= sp.hi THEN w.end_us WHEN sp.hi - sp.hi % {HOUR} > w.start_us THEN sp.hi - sp.hi % {HOUR} END AS aligned_end_us
  FROM w LEFT JOIN sp ON sp.instance_id = w.instance_id AND sp.lo <= w.start_us AND w.start_us < sp.hi""")
def aligned_windows(spark, d):
    """Three quarters of a day from six hours into each file, cut to what was covered between 1995 and 2000."""
    files = _files(spark, d)
    spans = cov.covered_spans(files, files.filter("state = 'done'"))
    spans = spans.select("instance_id", F.greatest("lo", F.lit(_A)).alias("lo"), F.least("hi", F.lit(_B)).alias("hi")).filter("lo < hi")
    windows = files.select("instance_id", "id", (F.col("lo") + DAY // 4).alias("start_us"), (F.col("lo") + DAY).alias("end_us"))
    return cov.align_windows(windows, spans, HOUR).select("id", "aligned_start_us", "aligned_end_us")


# Schemas


@register("""SELECT n_name AS table_name, CASE WHEN n_regionkey = 0 THEN 'missing' ELSE 'extra' END AS change FROM nation WHERE n_regionkey IN (0, 1)""")
def table_differences(spark, d):
    """Nations as tables: those of one region are missing in the target, those of another extra to it."""
    n = i.table(spark, d, "nation").select(F.lit("d").alias("database_name"), F.col("n_name").alias("table_name"), F.col("n_regionkey").alias("r"))
    return schema_diff.diff_tables(n.filter("r <> 1"), n.filter("r <> 0")).select("table_name", "change")


_TYPES = ("int", "bigint", "varchar(20)", "varchar(40)", "int unsigned")


@register("""WITH p AS (SELECT p_partkey, ['int', 'bigint', 'varchar(20)', 'varchar(40)', 'int unsigned'][p_size % 5 + 1] AS old, ['int', 'bigint', 'varchar(20)', 'varchar(40)', 'int unsigned'][p_partkey % 5 + 1] AS new, p_type = 'ECONOMY' AS strict FROM part)
  SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN strict THEN 'risky' WHEN (old, new) IN (('int', 'int'), ('int', 'bigint'), ('bigint', 'bigint'), ('varchar(20)', 'varchar(40)'), ('varchar(20)', 'varchar(20)'), ('varchar(40)', 'varchar(40)'), ('int unsigned', 'int unsigned')) THEN 'safe' ELSE 'risky' END AS risk,
    'MODIFY COLUMN `' || p_partkey || '` ' || new || CASE WHEN strict THEN ' NOT NULL' ELSE '' END AS ddl FROM p WHERE old <> new OR strict""")
def column_risks(spark, d):
    """Parts as columns whose types change; of one kind they may no longer be null."""
    types = F.array(*[F.lit(t) for t in _TYPES])
    p = i.table(spark, d, "part").withColumns({"database_name": F.lit("d"), "table_name": F.lit("t"), "name": F.col("p_partkey").cast("string"), "default_value": F.lit(None).cast("string"), "extra": F.lit(""), "comment": F.lit(""), "collation": F.lit("")})
    target = p.withColumns({"column_type": F.get(types, F.col("p_size") % 5), "nullable": F.lit(True)})
    source = p.withColumns({"column_type": F.get(types, (F.col("p_partkey") % 5).cast("int")), "nullable": F.col("p_type") != "ECONOMY"})
    return schema_diff.diff_columns(source, target).select("name", "risk", "ddl")


@register("""SELECT s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN 'missing' WHEN s_nationkey % 3 = 1 THEN 'changed' ELSE 'extra' END AS change,
  CASE WHEN s_nationkey % 3 < 2 AND s_acctbal > 0 THEN 'risky' WHEN s_nationkey % 3 = 0 THEN 'safe' ELSE 'risky' END AS risk FROM supplier""")
def index_differences(spark, d):
    """Suppliers as indexes, unique where their balance is positive: a third is missing, a third changed, a third extra."""
    s = i.table(spark, d, "supplier").select(F.lit("d").alias("database_name"), F.lit("t").alias("table_name"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_unique"), F.lit("BTREE").alias("index_type"), F.lit("a").alias("parts"), (F.col("s_nationkey") % 3).alias("r"))
    return schema_diff.diff_indexes(s.filter("r < 2"), s.filter("r > 0").withColumn("parts", F.lit("a,b"))).select("name", "change", "risk")


@register("SELECT c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'changed' ELSE 'missing' END AS change, 'risky' AS risk FROM customer WHERE c_nationkey % 2 = 1 OR c_mktsegment <> 'BUILDING'")
def foreign_key_differences(spark, d):
    c = i.table(spark, d, "customer").select(F.lit("d").alias("database_name"), F.lit("t").alias("table_name"), F.col("c_name").alias("name"), F.lit("a").alias("columns"), F.lit("nation").alias("referenced_table"), F.lit("id").alias("referenced_columns"), F.col("c_mktsegment").alias("rules"), (F.col("c_nationkey") % 2).alias("r"))
    return schema_diff.diff_foreign_keys(c, c.filter("r = 0").withColumn("rules", F.lit("BUILDING"))).select("name", "change", "risk")


@register("SELECT c_name AS table_name, CASE WHEN c_nationkey % 3 = 0 THEN 'missing' ELSE 'changed' END AS change, CASE WHEN c_nationkey % 3 = 2 THEN 'risky' ELSE 'safe' END AS risk FROM customer")
def table_option_differences(spark, d):
    """Customers as tables: a third is missing, a third has another comment, a third another engine."""
    c = i.table(spark, d, "customer").select(F.lit("d").alias("database_name"), F.col("c_name").alias("table_name"), F.lit("a").alias("engine"), F.lit("u").alias("collation"), F.lit("r").alias("row_format"), F.lit("").alias("comment"), (F.col("c_nationkey") % 3).alias("r"))
    target = c.filter("r > 0").withColumns({"comment": F.lit("x"), "engine": F.when(F.col("r") == 2, "b").otherwise("a")})
    return schema_diff.diff_options(c, target).select("table_name", "change", "risk")


# Identity


@register(f"""WITH b AS (SELECT user_id % 9 AS ip, user_id AS name, min(epoch_us(ts)) - {2 * 60_000_000} AS lo, max(epoch_us(ts)) + {2 * 60_000_000} AS hi FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
  q AS (SELECT DISTINCT user_id % 9 AS ip, epoch_us(ts) - epoch_us(ts) % {DAY} AS at_us FROM events), h AS (SELECT s_suppkey % 5 AS ip, min(s_name) AS host FROM supplier GROUP BY 1)
  SELECT CAST(q.ip AS VARCHAR) AS ip, at_us, coalesce(CASE WHEN count(b.ip) = 1 THEN CAST(max(b.name) AS VARCHAR) END, any_value(host)) AS name FROM q LEFT JOIN b ON b.ip = q.ip AND at_us BETWEEN lo AND hi LEFT JOIN h ON h.ip = q.ip GROUP BY q.ip, at_us""")
def address_names(spark, d):
    """Addresses at midnight: the only user then seen at it, else the host that has it."""
    e = i.table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ip", (F.col("user_id") % 9).cast("string"))
    seen = e.filter("event_type = 'signup'").select(F.col("user_id").cast("string").alias("uid"), "ip", F.col("us").alias("seen_us"), F.col("user_id").cast("string").alias("name"))
    hosts = i.table(spark, d, "supplier").select((F.col("s_suppkey") % 5).cast("string").alias("ip"), F.col("s_name").alias("name"))
    asked = e.select("ip", (F.col("us") - F.pmod("us", F.lit(DAY))).alias("at_us")).distinct()
    return sessions.name_ips(asked, sessions.binding_intervals(seen), hosts)


@register("SELECT CAST(o_custkey AS VARCHAR) AS uid, o_orderpriority AS ip, min(epoch_us(o_orderdate)) AS first_seen_us, max(epoch_us(o_orderdate)) AS last_seen_us FROM orders GROUP BY 1, 2 HAVING max(o_orderdate) >= TIMESTAMP '1998-01-01'")
def live_bindings(spark, d):
    """Customers bound to priorities by their orders; bindings not seen since 1998 are gone."""
    o = i.table(spark, d, "orders")
    seen = o.select(F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("ip"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seen_us"), F.lit("n").alias("name"))
    since = 883_612_800_000_000
    return sessions.binding_intervals(seen, _B - since, _B).drop("name")
