"""Queries on statement texts and on the sources that read records of other systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.udf import explain_safe, statement_verb
from ..operators import filters as fl
from ..operators import search, sessions
from ..sources import logs, telemetry
from . import inputs as i
from .registry import DAY, HOUR, START, over_changes, register


def _events(spark, d) -> DataFrame:
    e = i.table(spark, d, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    return e.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor(F.col("value") * 100).cast("bigint").alias("v"), k.alias("k"), "props")


_E = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) AS v, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS k, props FROM events)"


def _text(template: str):
    """``{k}``, ``{u}`` and ``{e}`` of a template become the event's number, user and id."""
    out = F.lit(template)
    for name, column in (("{k}", "k"), ("{u}", "user_id"), ("{e}", "event_id")):
        out = F.replace(out, F.lit(name), F.col(column).cast("string"))
    return out


def _choice(templates: list[str]):
    return F.element_at(F.array(*[_text(t) for t in templates]), (F.col("event_id") % len(templates) + 1).cast("int"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chosen(templates: list[str]) -> str:
    """The same in SQL."""
    filled = [f"replace(replace(replace({_quoted(t)}, '{{k}}', CAST(k AS VARCHAR)), '{{u}}', CAST(user_id AS VARCHAR)), '{{e}}', CAST(event_id AS VARCHAR))" for t in templates]
    return f"[{', '.join(filled)}][event_id % {len(templates)} + 1]"


# Statement texts: literal texts and what must become of them

_FORMS = [
    ("SELECT a /* {k} */ FROM t_{u} -- tail {e}\nWHERE x IN ({k}, 2,{u}) AND y  >=  -{k}", "SELECT a FROM t_{u} WHERE x IN (?) AND y>=?"),
    ("INSERT INTO log_{u} (a, b)\tVALUES ({k}, 'it''s {e}'), ( 0x1F , \"q\" )", "INSERT INTO log_{u} (a, b) VALUES (?)"),
    ("UPDATE t SET c{u} = {k}.5e-3, d='x' WHERE id <=> {e} # note", "UPDATE t SET c{u}=?, d=? WHERE id<=>?"),
    ("delete from t where @{u} = {k} and f( a , b ) != ?", "delete from t where @{u}=? and f(a, b)!=?"),
]


@register(f"WITH {_E} SELECT event_id, {_chosen([n for _, n in _FORMS])} AS normalized FROM e")
def normal_forms(spark, d):
    return _events(spark, d).select("event_id", sc.normalize_sql(_choice([t for t, _ in _FORMS])).alias("normalized"))


_ACTIONS = [
    ("/* c */ CREATE TABLE t{u} (a int)", "DDL", "DDL"), ("comment on t{u}", "DDL", "QUERY"), ("load data infile 'x'", "LOAD", "QUERY"), ("MERGE INTO t{u}", "MERGE", "QUERY"),
    ("commit", "TRANSACTION", "TRANSACTION"), ("XA START '{u}'", "TRANSACTION", "TRANSACTION"), ("do {k}", "ADMIN", "QUERY"), ("repair table t{u}", "ADMIN", "QUERY"), ("REPLACE INTO t{u} VALUES (1)", "REPLACE", "INSERT"),
    ("-- c\nupdate t{u}", "OTHER", "UPDATE"), ("(select {k})", "OTHER", "QUERY"), ("GRANT {k} TO x;", "ADMIN", "DDL"), ("start transaction", "TRANSACTION", "QUERY"), ("begin;", "TRANSACTION", "TRANSACTION"), ("with x as (select 1) select 1", "OTHER", "QUERY"), ("{k}", "OTHER", "QUERY"),
]


@register(f"WITH {_E} SELECT event_id, {_chosen([a for _, a, _ in _ACTIONS])} AS action, {_chosen([c for _, _, c in _ACTIONS])} AS class FROM e")
def statement_actions(spark, d):
    text = _choice([t for t, _, _ in _ACTIONS])
    return _events(spark, d).withColumn("t", text).select("event_id", sc.sql_action(F.col("t")).alias("action"), sc.classify_query(F.col("t")).alias("class"))


_SAFETY = [
    ("select count(*) from t{u} where a in ({k}, 2)", "yes"), ("SELECT * FROM x WHERE a='a;b{k}';", "yes"), ("with c as (select {k}) select * from c", "yes"), ("SELECT SLEEP({k}) FROM x", "no"), ("SELECT `sleep`({k})", "no"),
    ("SELECT /*!50000 SLEEP({k}), */ 1", "no"), ("SELECT mydb{u}.count({k})", "no"), ("SELECT \"ABS\"({k}) FROM x", "no"), ("SELECT @v{u} FROM x", "no"), ("SELECT * FROM x{u}; DELETE FROM x", "no"),
    ("SELECT {k} INTO OUTFILE 'x' FROM x", "no"), ("WITH x AS (SELECT {k}) DELETE FROM t", "no"), ("SELECT * FROM x{u} FOR UPDATE", "no"), ("SELECT 'open {k}", "no"), ("update t{u} set a = 1", "no"), ("select my_udf{u}({k})", "no"),
]


@register(f"WITH {_E} SELECT event_id, {_chosen([s for _, s in _SAFETY])} = 'yes' AS safe FROM e")
def plan_safety(spark, d):
    return _events(spark, d).select("event_id", explain_safe(_choice([t for t, _ in _SAFETY])).alias("safe"))


_VERBS = [("with a as (select {k}), b as (select 2) delete from t{u}", "DELETE"), ("(select {k})", "SELECT"), ("# c\n-- c\nWITH c AS (SELECT {k}) UPDATE x SET a=1", "UPDATE"), ("insert into t{u} select 1", "INSERT"), ("/* c */ drop table t{u}", "DROP")]


@register(f"WITH {_E} SELECT event_id, {_chosen([v for _, v in _VERBS])} AS verb FROM e")
def leading_verbs(spark, d):
    return _events(spark, d).select("event_id", _choice([t for t, _ in _VERBS]).alias("t")).select("event_id", statement_verb("t").alias("verb"))


_SECRETS = [
    ("ALTER USER u{u} IDENTIFIED WITH p AS 'h''{k}'", "ALTER USER u{u} IDENTIFIED WITH p AS '<redacted>'"), ("SET p{u} = PASSWORD('pw{k}')", "SET p{u} = PASSWORD('<redacted>')"), ("api_key : \"s{k}\" for {u}", "api_key : '<redacted>' for {u}"),
    ("mysql://user{u}:pw{k}@host/db", "mysql://user{u}:'<redacted>'@host/db"), ("Authorization: Bearer abc{k}.def", "Authorization: Bearer '<redacted>'"), ("mysql -u{u} -p'pw{k}'", "mysql -u{u} -p'<redacted>'"), ("GRANT {u} REQUIRE ISSUER 'pw{k}'", "GRANT {u} REQUIRE ISSUER '<redacted>'"),
    ("INSERT INTO users{u} (name, password) VALUES ('b', 'pw{k}')", "INSERT INTO users{u} (name, password) VALUES /* credential values redacted */"), ("jwt eyJabc.d{k}.e{u} end", "jwt <redacted> end"), ("UPDATE t SET a = {k} WHERE id = {u}", "UPDATE t SET a = {k} WHERE id = {u}"),
]


@register(f"WITH {_E} SELECT event_id, {_chosen([r for _, r in _SECRETS])} AS text, event_id % {len(_SECRETS)} < {len(_SECRETS) - 1} AS changed FROM e")
def redacted_statements(spark, d):
    # masking is all of the work, and a file's narrow columns make few tasks for it; a number that is given isn't coalesced
    e = _events(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return e.select("event_id", sc.redact_secrets(_choice([t for t, _ in _SECRETS])).alias("r")).select("event_id", "r.*")


@register(f"WITH {_E} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user:*:#' || substr(sha256('Z' || k), 1, 12) WHEN 1 THEN '{{*}}:session' WHEN 2 THEN 'user' ELSE '*:user:*' END AS shape FROM e")
def key_shapes(spark, d):
    key = _choice(["user:{u}:Z{k}", "{tag}:SESSION", "User", ":user:{k}"])
    return _events(spark, d).select("event_id", sc.key_shape(key, ["user", "session"]).alias("shape"))


_HOSTS = [("10.0.0.{k}:33{u}", "10.0.0.{k}"), ("[fe80::{k}]:{u}", "fe80::{k}"), ("fe80::{k}", "fe80::{k}"), ("host-{u}", "host-{u}"), ("", "")]


@register(f"WITH {_E} SELECT event_id, {_chosen([h for _, h in _HOSTS])} AS host FROM e")
def client_hosts(spark, d):
    return _events(spark, d).select("event_id", sc.client_host(_choice([t for t, _ in _HOSTS])).alias("host"))


@register(f"WITH {_E}, c AS (SELECT user_id, event_type AS name, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, name) AS r FROM c) SELECT user_id, string_agg(name || '=' || n, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY 1")
def top_counts(spark, d):
    counts = _events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(sc.top_counts(F.col("m")), lambda x: F.concat(x["name"], F.lit("="), x["count"].cast("string"))), ",").alias("top"))


@register(f"WITH {_E} SELECT event_id, ['primary', 'secondary', 'primary', 'secondary', 'unknown'][event_id % 5 + 1] AS role, ['INSERT', 'DDL', NULL, 'SELECT', 'DDL'][event_id % 5 + 1] AS operation FROM e")
def roles_and_operations(spark, d):
    role, kind = _choice([" Master", "READONLY", "writer ", "Slave", "x{u}"]), _choice([" insert", "Alter", "x{k}", "SELECT", "ddl"])
    return _events(spark, d).select("event_id", sc.normalize_role(role).alias("role"), sc.operation_of_type(kind).alias("operation"))


@register(f"WITH {_E} SELECT event_id, ['replication', 'daemon', 'system_account', NULL][event_id % 4 + 1] AS reason, event_id % 4 IN (1, 2) AS waits FROM e")
def protected_sessions(spark, d):
    user, command = _choice(["u{u}", "u{u}", "event_scheduler", "u{u}"]), _choice(["Binlog Dump GTID", "Daemon", "Query", "Query"])
    state = _choice(["", "Waiting for table metadata lock", "lock wait {k}", "Sending data"])
    return _events(spark, d).select("event_id", sessions.protected_reason(user, command).alias("reason"), sessions.waits_for_lock(state).alias("waits"))


@register("SELECT p_partkey, sha256('shop' || chr(0) || lower(p_name) || chr(0) || p_type) AS version FROM part")
def schema_versions(spark, d):
    return i.table(spark, d, "part").select("p_partkey", sc.schema_version(F.lit("Shop"), F.upper("p_name"), F.col("p_type")).alias("version"))


@register(f"WITH {_E} SELECT event_id, round([k * 3600000 + user_id * 1000 + 500, k, k / 1000, NULL][event_id % 4 + 1], 6) AS ms, round([v / 100, NULL, NULL, k][event_id % 4 + 1], 6) AS number FROM e")
def durations_and_numbers(spark, d):
    text = _choice(["{k}h{u}.5s", "{k}ms", "{k}µs", "soon"])
    number = F.element_at(F.array((F.col("v") / 100).cast("string"), F.lit("-1"), F.lit("NaN"), F.col("k").cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, d).select("event_id", F.round(sc.duration_ms(text), 6).alias("ms"), F.round(sc.finite(number), 6).alias("number"))


@register("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed') AND contains(lower(text), 'under')")
def filter_document_terms(spark, d):
    return fl.keyword_contains(i.table(spark, d, "documents"), "Licensed under", "AND", ("text",)).select("doc_id")


# Sources


def _provider(spark, d) -> DataFrame:
    """Slow-log records as a provider sends them, every tenth twice."""
    e = _events(spark, d)
    rows = e.select(
        F.when(F.col("event_id") % 2 == 0, F.floor(F.col("us") / 1000)).otherwise(0).cast("bigint").alias("Timestamp"),
        F.date_format(F.timestamp_micros((F.floor(F.col("us") / 1000) * 1000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("QueryStartTime"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string"))).alias("NodeId"),
        F.concat(F.lit("SELECT * FROM t WHERE id = "), F.col("event_id").cast("string")).alias("SQLText"),
        F.concat(F.lit("acc"), (F.col("user_id") % 5).cast("string")).alias("AccountName"),
        F.lit(None).cast("string").alias("SqlId"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string"), F.lit(":5")).alias("HostAddress"),
        F.col("user_id").alias("ThreadId"),
        (F.col("v") / 4).alias("QueryTime"),
        F.lit(None).cast("double").alias("LockTime"),
        F.col("k").alias("RowsExamined"),
        F.lit(None).cast("bigint").alias("RowsSent"),
        F.lit("SELECT").alias("SqlType"),
        F.lit("shop").alias("DBName"),
        F.lit("t").alias("TableName"),
        "event_id",
    )
    return rows.unionByName(rows.filter("event_id % 10 = 0")).drop("event_id")


@register(f"""WITH {_E} SELECT us - us % 1000 AS event_epoch_us, CASE WHEN user_id % 3 > 0 THEN 'n' || (user_id % 3) ELSE 'n0' END AS node_id, CAST(round(v / 4) AS BIGINT) AS query_time_ms, '10.0.0.' || (user_id % 9) AS client_ip, substr(sha256('original' || chr(0) || 'SELECT * FROM t WHERE id=?'), 1, 32) AS fingerprint, k AS rows_examined
  FROM e WHERE user_id % 5 <> 4""")
def slow_source(spark, d):
    out = logs.slow_events(_provider(spark, d), instance_id="i", default_node="n0", exclude_accounts=["ACC4"])
    return out.select("event_epoch_us", "node_id", "query_time_ms", "client_ip", "fingerprint", "rows_examined")


def general_log_rows(spark, d) -> DataFrame:
    """A general log: sign-ups connect, purchases use a database, errors quit, views read, clicks write."""
    e = _events(spark, d)
    kind = F.col("event_type")
    command = F.when(kind == "signup", "Connect").when(kind == "error", "Quit").otherwise("Query")
    argument = F.when(kind == "signup", "app@h on shop using TCP").when(kind == "purchase", F.concat(F.lit("use `db"), (F.col("user_id") % 3).cast("string"), F.lit("`"))).when(kind == "view", F.concat(F.lit("SELECT "), F.col("event_id").cast("string"))).when(kind == "click", "UPDATE t SET a = 1").otherwise("")
    return e.select(F.lit("s").alias("server"), F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.col("us").alias("event_epoch_us"), F.lit("app").alias("user"), command.alias("command"), argument.alias("argument"))


@register("""WITH g AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, CASE event_type WHEN 'signup' THEN 'shop' WHEN 'purchase' THEN 'db' || (user_id % 3) WHEN 'error' THEN '' END AS mark FROM events),
  h AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS db FROM g)
  SELECT us AS event_epoch_us, user_id AS thread_id, db AS database_name, 'SELECT ' || event_id AS sql_text FROM h WHERE event_type = 'view'""")
def general_log_source(spark, d):
    return logs.general_log_events(general_log_rows(spark, d), instance_id="i").select("event_epoch_us", "thread_id", "database_name", "sql_text")


@register(f"""WITH {_E}, v AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'AUDIT_STATUS' WHEN user_id % 7 = 6 THEN 'AUDIT_INSTANCE' WHEN k < 3 THEN 'AUDIT_TIME' WHEN event_id % 5 = 1 THEN 'AUDIT_ID_CONFLICT' WHEN event_id % 5 = 0 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM e) SELECT verdict, count(*) AS n FROM v GROUP BY 1""")
def audit_ingest(spark, d):
    """A fifth of the executions is stored already, a fifth stored with another text."""
    e = _events(spark, d)
    new = e.select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("i"), (F.col("user_id") % 7).cast("string")).alias("instance_id"), F.when(F.col("event_id") % 11 == 0, "WHAT").otherwise("success").alias("execution_status"), F.col("us").alias("started_epoch_us"), (F.col("us") + F.when(F.col("k") < 3, -1).otherwise(1)).alias("finished_epoch_us"), F.concat(F.lit("SELECT "), F.col("k").cast("string")).alias("sql_text"))
    at = F.col("event_id").cast("bigint") % 5
    old = new.filter(at < 2).withColumn("sql_text", F.when(at == 1, "other").otherwise(F.col("sql_text")))
    accepted, again, refused = logs.ingest_audit(new, old, [f"i{n}" for n in range(6)])
    parts = [accepted.select(F.lit("accepted").alias("verdict")), again.select(F.lit("duplicate").alias("verdict")), refused.select(F.col("reason").alias("verdict"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {_E} SELECT CAST(event_id AS VARCHAR) AS query_id, us - us % 1000000 AS timestamp_us FROM e WHERE us - us % 1000000 BETWEEN {START + DAY} AND {START + 20 * DAY} AND user_id % 5 = 2 AND k % 10 = 0 AND v >= 1000")
def olap_audit(spark, d):
    """Failed statements of one account over ten seconds; the local times are eight hours ahead."""
    local = F.date_format(F.timestamp_micros(F.col("us") + 8 * HOUR), "yyyy-MM-dd HH:mm:ss").cast("timestamp")
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("query_id"), local.alias("timestamp"), F.lit("shop").alias("db"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"), F.lit("SELECT").alias("stmt"), F.lit("h").alias("client_ip"), F.when(F.col("k") % 10 == 0, "err").otherwise("OK").alias("state"), F.col("v").alias("query_time_ms"))
    return logs.olap_audit(rows, START + DAY, START + 20 * DAY, account="U2", status="failed", slow_ms=1000).select("query_id", "timestamp_us")


@register(f"WITH {_E} SELECT event_id AS load_id, us AS create_us FROM e WHERE event_type = 'signup' AND us BETWEEN {START} AND {START + 25 * DAY} ORDER BY us DESC, event_id LIMIT 200")
def olap_loads(spark, d):
    rows = _events(spark, d).filter("event_type = 'signup'").select(F.col("event_id").alias("load_id"), F.col("us").alias("create_us"))
    return logs.olap_loads(rows, START, START + 25 * DAY)


@register(f"""WITH {_E}, r AS (SELECT *, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status FROM e WHERE event_type <> 'signup'), b AS (SELECT min(us) AS a, max(us) AS z FROM r)
  SELECT us AS ts_us, status, 's' || user_id AS shop, CAST(k AS INTEGER) AS page, v * 1.0 AS duration_ms, status = 429 AS throttled FROM r, b WHERE us BETWEEN a + 1000000 AND z - 1000000""")
def http_access(spark, d):
    e = _events(spark, d)
    path = F.concat(F.when(F.col("event_type") == "signup", "/other").otherwise("/api/list"), F.lit("?shop_id=s"), F.col("user_id").cast("string"), F.lit("&page="), F.col("k").cast("string"))
    line = F.concat(F.lit('h - "GET '), path, F.lit(' HTTP/1.1" '), F.when(F.col("event_type") == "error", "429").otherwise("200"), F.lit(" duration="), F.col("v").cast("string"), F.lit("ms"))
    return logs.http_log_rows(e.select(F.col("us").alias("ts_us"), line.alias("line")), "/api/").select("ts_us", "status", "shop", "page", "duration_ms", "throttled")


@register(f"WITH {_E} SELECT event_id AS node_id, CASE event_id % 4 WHEN 0 THEN 'checkpoint' WHEN 1 THEN 'role' ELSE 'process' END AS kind, CASE WHEN event_id % 4 = 0 THEN k * 1.0 END AS seconds, CASE WHEN event_id % 4 = 1 THEN 'PRIMARY' END AS role FROM e WHERE event_id % 4 < 3")
def running_log(spark, d):
    line = _choice(["Checkpoint took {k} s, wrote 5 MB", "Transition to PRIMARY is complete", "shutting down {k}", "connection accepted {u}"])
    out = logs.running_events(_events(spark, d).select(F.col("event_id").alias("node_id"), F.col("us").alias("ts_us"), line.alias("line")))
    return out.select("node_id", "kind", "seconds", "role")


@register(f"WITH {_E} SELECT 'n' || (user_id % 3) AS node_id, event_type AS metric, us // {HOUR * 1000 // 1000} AS timestamp_ms, CAST(any_value(k) AS DOUBLE) AS value FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT k) = 1")
def unambiguous_points(spark, d):
    """Metric points of one instance by hour, where all samples agree."""
    points = _events(spark, d).select(F.lit("i").alias("instance_id"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), F.col("event_type").alias("metric"), F.floor(F.col("us") / HOUR).cast("bigint").alias("timestamp_ms"), F.col("k").cast("double").alias("value"))
    return telemetry.without_conflicts(telemetry.read_metric_points(points, instance="i"))


@register(f"""WITH {_E} SELECT CASE event_id % 5 WHEN 0 THEN 'totals' WHEN 1 THEN 'raw_key' WHEN 2 THEN 'window' WHEN 3 THEN 'counts' ELSE 'accepted' END AS verdict, count(*) AS n, CAST(sum(k + 1) AS BIGINT) AS calls FROM e GROUP BY 1""")
def client_batch_verdicts(spark, d):
    """Batches of client counters of which four in five break a rule."""
    e = _events(spark, d).withColumn("c", F.col("k") + 1)
    r = F.col("event_id") % 5
    row = F.struct(F.lit("get").alias("command"), F.when(r == 1, F.lit("user:12:x")).otherwise("user:*").alias("shape"), F.col("c").alias("calls"), F.when(r == 3, F.col("c") + 1).otherwise(0).alias("errors"), F.col("c").alias("latency_known_calls"))
    batches = e.select(F.lit("i").alias("instance"), F.lit("p").alias("process"), F.col("event_id").cast("string").alias("batch"), F.lit(0).cast("bigint").alias("start_us"), F.when(r == 2, 10**9).otherwise(60_000_000).cast("bigint").alias("end_us"), F.create_map(F.lit("get"), F.col("c") + F.when(r == 0, 1).otherwise(0)).alias("totals"), F.array(row).alias("rows"))
    good, bad = telemetry.client_batches(batches)
    judged = good.select("batch", F.lit("accepted").alias("verdict")).unionByName(bad.select("batch", F.col("reason").alias("verdict")))
    return judged.join(e.select(F.col("event_id").cast("string").alias("batch"), "c"), "batch").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("calls"))


@register(f"WITH {_E} SELECT event_id AS profile_id, 'user:*' AS prefix, k AS keys, v AS bytes FROM e WHERE event_id % 6 <> 0")
def consistent_profiles(spark, d):
    e = _events(spark, d)
    prefixes = F.array(F.struct(F.lit("user:*").alias("prefix"), F.col("k").alias("keys"), F.col("v").alias("bytes")))
    rows = e.select(F.lit("i").alias("instance"), F.col("event_id").alias("profile_id"), prefixes.alias("prefixes"), (F.col("k") + F.when(F.col("event_id") % 6 == 0, 1).otherwise(0)).alias("total_keys"), F.col("v").alias("total_bytes"))
    return telemetry.redis_profiles(rows)[0].select("profile_id", "prefix", "keys", "bytes")


@register(f"WITH {_E} SELECT event_id, 'user:*' AS keys FROM e WHERE k <= 60")
def sampled_commands(spark, d):
    rows = _events(spark, d).select("event_id", F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("keys"), (F.col("k") / 60).alias("rate"), F.col("v").alias("latency_us"))
    return telemetry.redis_samples(rows, ["user"]).select("event_id", F.array_join("keys", ",").alias("keys"))


@register(f"WITH {_E} SELECT DISTINCT 'n' || (user_id % 3) AS node_id, us AS ts_us, event_type AS command, v AS duration_us, 'user:*' AS key, k > 1 AS partial FROM e")
def cloud_slow_commands(spark, d):
    item = F.struct(F.col("us").alias("ts_us"), F.col("event_type").alias("command"), F.col("v").alias("duration_us"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"))
    pages = _events(spark, d).select(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), F.col("k").alias("total"), F.array(item).alias("items"))
    return telemetry.redis_cloud_slow(pages.unionByName(pages), ["user"]).select("node_id", "ts_us", "command", "duration_us", "key", "partial")


@register(f"WITH {_E} SELECT event_id AS ts_us, CAST(1 AS INTEGER) AS foreign_items, 'user:*' AS key, k AS hits FROM e")
def hot_key_snapshots(spark, d):
    """Each snapshot holds one key of its own node and one of another."""
    node = F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string"))
    item = lambda n: F.struct(n.alias("node_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("k").alias("hits"))
    rows = _events(spark, d).select(node.alias("node_id"), F.col("event_id").alias("ts_us"), F.array(item(node), item(F.lit("other"))).alias("items"))
    return telemetry.redis_hot_keys(rows, ["user"]).select("ts_us", F.col("foreign").alias("foreign_items"), "key", "hits")


@register(f"WITH {_E} SELECT user_id, event_type AS metric, arg_max(k, event_id) AS value FROM e GROUP BY 1, 2")
def latest_telemetry(spark, d):
    """Events as payloads of one point for each user and metric; the last received counts."""
    rows = _events(spark, d).select(F.lit("").alias("id"), F.lit(0).cast("bigint").alias("timestamp_us"), F.lit("primary").alias("role"), F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("metric"), F.lit(60).alias("period"), F.col("event_id").alias("received_us"), F.col("k").alias("value"))
    return telemetry.dedupe_telemetry(rows).select(F.col("node_id").cast("bigint").alias("user_id"), "metric", "value")


@register(f"WITH {_E} SELECT user_id AS node_id, max(us) AS timestamp_us FROM e WHERE us BETWEEN {START + 20 * DAY - 48 * HOUR} AND {START + 20 * DAY} GROUP BY 1")
def latest_native_counters(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("node_id"), F.col("us").alias("timestamp_us"), "k")
    return telemetry.latest_native(rows, START + 20 * DAY, 48 * HOUR).select("node_id", "timestamp_us")


@register("SELECT CAST(c_custkey AS VARCHAR) AS node_id, CASE WHEN c_nationkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS role, c_mktsegment AS zone FROM customer")
def provider_roles(spark, d):
    role = F.when(F.col("c_nationkey") % 2 == 0, "Writer").otherwise("ReadOnly")
    payload = F.to_json(F.struct(F.lit("i").alias("instance_id"), F.array(F.struct(F.col("c_custkey").cast("string").alias("id"), role.alias("role"), F.col("c_mktsegment").alias("zone"), F.lit("ok").alias("status"))).alias("nodes")))
    return telemetry.node_roles(i.table(spark, d, "customer").select(payload.alias("payload")), "i").select("node_id", "role", "zone")


@register(f"WITH {_E} SELECT event_id AS ts_us, 'db.' || event_type AS namespace, k AS read_count, v AS read_us, user_id AS write_count FROM e")
def namespace_totals(spark, d):
    payload = F.concat(F.lit('{"totals":{"db.'), F.col("event_type"), F.lit('":{"readLock":{"time":'), F.col("v").cast("string"), F.lit(',"count":'), F.col("k").cast("string"), F.lit('},"writeLock":{"time":1,"count":'), F.col("user_id").cast("string"), F.lit("}}}}"))
    out = telemetry.namespace_totals(_events(spark, d).select(F.lit("n").alias("node_id"), F.col("event_id").alias("ts_us"), payload.alias("payload")))
    return out.select("ts_us", "namespace", "read_count", "read_us", "write_count")


@register(f"WITH {_E} SELECT event_id AS ts_us, 'qps' AS metric, v * 1.0 AS value FROM e UNION ALL SELECT event_id, 'cpu_usage', k * 2.0 FROM e WHERE k * 2 <= 100")
def performance_points(spark, d):
    """Percentages above 100 are none."""
    value = F.concat((F.col("k") * 2).cast("string"), F.lit("&"), F.col("v").cast("string"))
    rows = _events(spark, d).select(F.lit("n").alias("node_id"), F.col("event_id").alias("ts_us"), F.lit("cpu_usage&qps").alias("value_format"), value.alias("value"))
    return telemetry.performance_points(rows).select("ts_us", "metric", "value")


@register(f"WITH {_E} SELECT 'n' || user_id AS node_id, us // 1000 AS timestamp_ms, k * 1.0 AS value, 'period_end' AS stamp FROM e")
def cloud_points(spark, d):
    payload = F.to_json(F.array(F.struct(F.floor(F.col("us") / 1000).cast("bigint").alias("timestamp"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("nodeId"), F.col("k").cast("double").alias("Average"))))
    out = telemetry.cloud_metrics(_events(spark, d).select(F.lit("cpu").alias("metric"), F.lit(60).alias("period"), payload.alias("payload")))
    return out.select("node_id", "timestamp_ms", "value", "stamp")


@register("SELECT '10.' || c_custkey AS ip, c_name AS name, CAST(c_custkey AS VARCHAR) AS uid, 1704067200000000 AS created_us FROM customer WHERE c_nationkey % 4 <> 0")
def pod_addresses(spark, d):
    """Customers as pods; those of every fourth nation use their host's network."""
    ip = F.concat(F.lit("10."), F.col("c_custkey").cast("string"))
    pod = F.struct(F.struct(F.col("c_name").alias("name"), F.lit("x").alias("namespace"), F.col("c_custkey").cast("string").alias("uid"), F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"), F.struct((F.col("c_nationkey") % 4 == 0).alias("hostNetwork"), F.lit("n").alias("nodeName")).alias("spec"), F.struct(F.lit("9").alias("hostIP"), F.array(F.struct(ip.alias("ip")), F.struct(ip.alias("ip"))).alias("podIPs")).alias("status"))
    rows = i.table(spark, d, "customer").select(F.lit("c").alias("cluster"), F.lit(5).cast("bigint").alias("seen_us"), F.to_json(F.struct(F.array(pod).alias("items"))).alias("payload"))
    return telemetry.pod_bindings(rows).select("ip", "name", "uid", "created_us")


@register("SELECT 'a' || s_suppkey AS ip, s_name AS name FROM supplier UNION ALL SELECT 'b' || s_suppkey, s_name FROM supplier WHERE s_nationkey % 2 = 0")
def host_inventory(spark, d):
    a, b = (F.concat(F.lit(x), F.col("s_suppkey").cast("string")) for x in "ab")
    host = F.struct(F.lit("i").alias("InstanceId"), F.col("s_name").alias("InstanceName"), F.array(a).alias("PrivateIps"), F.array(a).alias("PublicIps"), F.when(F.col("s_nationkey") % 2 == 0, b).alias("EipAddress"))
    return telemetry.host_addresses(i.table(spark, d, "supplier").select(F.to_json(F.array(host)).alias("payload"))).select("ip", "name")


@register(f"WITH {_E} SELECT event_id AS ts_us, CASE WHEN event_type = 'view' THEN CASE WHEN k >= 10 THEN 'idle_trx' ELSE '' END ELSE concat_ws(',', CASE WHEN k >= 30 THEN 'long_running' END, CASE WHEN event_type = 'error' THEN 'lock_wait' END) END AS kinds FROM e WHERE event_type <> 'view' OR k < 30")
def session_snapshots(spark, d):
    """Views sleep in a transaction (those under 30 seconds are shown), the others run; errors wait for a lock."""
    view = F.col("event_type") == "view"
    row = F.struct(F.col("user_id").cast("string").alias("SessionId"), F.lit("u").alias("User"), F.lit("h:1").alias("Client"), F.when(view, "Sleep").otherwise("Query").alias("Command"), F.when(F.col("event_type") == "error", "Waiting for table metadata lock").alias("State"), F.col("k").alias("Time"), F.when(view, "t").alias("TrxId"), F.col("k").alias("TrxDuration"))
    rows = _events(spark, d).filter(~view | (F.col("k") < 30)).select(F.lit("i").alias("instance_id"), F.lit("n").alias("node_id"), F.col("event_id").alias("ts_us"), F.to_json(F.array(row)).alias("payload"))
    return telemetry.session_rows(rows).select("ts_us", F.array_join("kinds", ",").alias("kinds"))


@register(f"WITH {_E} SELECT event_id AS ts_us, concat_ws(',', CASE WHEN k >= 30 AND event_type <> 'view' THEN 'long_running' END, CASE WHEN event_type = 'error' THEN 'lock_wait' END) AS kinds FROM e")
def store_operations(spark, d):
    active = F.col("event_type") != "view"
    op = F.struct(F.col("event_id").cast("string").alias("opid"), F.lit("query").alias("op"), F.lit("d.c").alias("ns"), F.col("k").alias("secs_running"), (F.col("event_type") == "error").alias("waitingForLock"), active.alias("active"))
    rows = _events(spark, d).select(F.lit("i").alias("instance_id"), F.lit("n").alias("node_id"), F.col("event_id").alias("ts_us"), F.to_json(F.struct(F.array(op).alias("inprog"))).alias("payload"))
    return telemetry.store_sessions(rows).select("ts_us", F.array_join("kinds", ",").alias("kinds"))


@register(f"WITH {_E} SELECT 'n' || (user_id % 3) AS node_id, event_type AS kind, count(DISTINCT k) AS events FROM e GROUP BY 1, 2")
def provider_events(spark, d):
    """Events with a field that must not be kept; those that differ in nothing else are one."""
    payload = F.to_json(F.array(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("number"), F.col("k").cast("string"), F.lit("secret"), F.col("event_id").cast("string"))))
    out = telemetry.provider_events(_events(spark, d).select(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), payload.alias("payload")), ["kind", "number"])
    return out.groupBy("node_id", F.col("fields")["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("events"))


@register(over_changes("SELECT event_id, 'shop' AS database, 'qualified' AS reason FROM ev WHERE operation = 'DELETE' UNION ALL SELECT event_id, 'hinted', 'comment' FROM ev WHERE operation = 'QUERY'"))
def named_databases(spark, d):
    rows = i.change_events(spark, d)
    text = F.when(F.col("operation") == "DELETE", F.replace(F.col("sql_text"), F.lit("FROM user_"), F.lit("FROM `shop`.user_"))).otherwise(F.concat(F.lit("/* db=hinted */ "), F.col("sql_text")))
    out = rows.filter("operation IN ('DELETE', 'QUERY')").withColumn("sql_text", text)
    return search.with_default_database(out, rows.select("database_name", "table_name").filter("table_name = ''")).select("event_id", F.col("default_database").alias("database"), F.col("database_reason").alias("reason"))
