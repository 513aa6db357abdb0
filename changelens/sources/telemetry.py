"""Sources of metrics, counters, snapshots and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators.sessions import session_flags

GAUGES = ("used_memory", "used_memory_rss", "connected_clients", "blocked_clients", "instantaneous_ops_per_sec", "evicted_keys", "expired_keys", "keyspace_hits", "keyspace_misses", "total_commands_processed")


def _must(test: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def read_metric_points(df: DataFrame, *, instance: str, node: str | None = None) -> DataFrame:
    """Metric points of the instance (and node) asked for; a point of another one is an error, never relabelled."""
    out = df.withColumn("instance_id", _must(F.col("instance_id") == instance, "a metric point of another instance", F.col("instance_id")))
    if node is not None:
        out = out.withColumn("node_id", _must(F.col("node_id") == node, "a metric point of another node", F.col("node_id")))
    return out


def without_conflicts(points: DataFrame) -> DataFrame:
    """Points whose (node, metric, time) has one value only; of conflicting samples none stays."""
    keys = ["node_id", "metric", "timestamp_ms"]
    values = points.groupBy(*keys).agg(F.count_distinct("value").alias("_n"), F.first("value").alias("value"))
    return values.filter("_n = 1").drop("_n")


def redis_snapshots(df: DataFrame) -> DataFrame:
    """Counters of INFO texts: ``node_id, ts_us, info`` to one row with uptime, run id, cpu, gauges, commands, key spaces.

    A text without uptime is an error; other missing fields are listed, never zero.
    """
    lines = F.filter(F.transform(F.split("info", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & x.contains(":"))
    pairs = F.map_from_entries(F.array_distinct(F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring(x, F.instr(x, ":") + 1, 1 << 16).alias("v")))))
    base = df.withColumn("_m", pairs)

    def number(name: str) -> Column:
        return F.col("_m")[name].try_cast("double")

    def fields(prefix: str) -> Column:
        entries = F.filter(F.map_entries("_m"), lambda e: F.startswith(e["key"], F.lit(prefix)))
        return F.transform(entries, lambda e: F.struct(F.substring(e["key"], len(prefix) + 1, 256).alias("name"), F.str_to_map(e["value"], F.lit(","), F.lit("=")).alias("f")))

    long = lambda f, k: f[k].try_cast("bigint")
    commands = F.transform(fields("cmdstat_"), lambda c: F.struct(c["name"].alias("command"), long(c["f"], "calls").alias("calls"), long(c["f"], "usec").alias("usec"), long(c["f"], "rejected_calls").alias("rejected_calls"), long(c["f"], "failed_calls").alias("failed_calls")))
    spaces = F.transform(F.filter(fields("db"), lambda c: c["name"].rlike(r"^\d+$")), lambda c: F.struct(F.concat(F.lit("db"), c["name"]).alias("db"), long(c["f"], "keys").alias("keys"), long(c["f"], "expires").alias("expires")))
    errors = F.transform(fields("errorstat_"), lambda c: F.struct(c["name"].alias("error"), long(c["f"], "count").alias("count")))
    wanted = F.array(*[F.lit(g) for g in GAUGES])
    uptime = number("uptime_in_seconds")
    return base.select(
        "node_id",
        "ts_us",
        _must(uptime.isNotNull(), "INFO without uptime", uptime.cast("bigint")).cast("bigint").alias("uptime_s"),
        F.col("_m")["run_id"].alias("epoch"),
        F.struct(*[number(f"used_cpu_{c}").alias(c) for c in ("sys", "user", "sys_children", "user_children")]).alias("cpu"),
        F.map_filter(F.map_from_arrays(wanted, F.array(*[number(g) for g in GAUGES])), lambda k, v: v.isNotNull()).alias("gauges"),
        F.array_except(wanted, F.map_keys("_m")).alias("missing"),
        commands.alias("commands"),
        spaces.alias("key_spaces"),
        errors.alias("errors"),
    )


def command_counters(snapshots: DataFrame) -> DataFrame:
    """Snapshots as counter rows, ready for deltas."""
    return snapshots.select("node_id", "ts_us", "uptime_s", "epoch", F.explode("commands").alias("c")).select("node_id", "ts_us", "uptime_s", "epoch", "c.*")


def client_batches(df: DataFrame, most_rows: int = 500, most_s: int = 120) -> tuple[DataFrame, DataFrame]:
    """Accepted client-counter rows and rejected batches with a reason.

    ``df``: ``instance, process, batch, start_us, end_us, totals map, rows array``. Windows last up to two minutes, batches
    hold up to 500 rows whose calls add up to the totals, errors and known counts stay within the calls, key shapes hold no
    raw keys. A batch id that comes with other content is rejected.
    """
    row = F.col("rows")
    sums = F.aggregate(F.map_entries("totals"), F.lit(True), lambda ok, t: ok & (F.aggregate(F.filter(row, lambda r: r["command"] == t["key"]), F.lit(0).cast("bigint"), lambda a, r: a + r["calls"]) == t["value"]))
    unknown = F.exists(row, lambda r: ~F.array_contains(F.map_keys("totals"), r["command"]))
    bounded = F.forall(row, lambda r: (r["errors"] <= r["calls"]) & (r["latency_known_calls"] <= r["calls"]) & (r["calls"] >= 0))
    canonical = F.forall(row, lambda r: r["shape"].rlike(r"^[A-Za-z_*#{}:.0-9-]*$") & ~r["shape"].rlike(r"(^|:)\d+(:|$)"))
    reason = (
        F.when((F.col("end_us") <= F.col("start_us")) | (F.col("end_us") - F.col("start_us") > most_s * 1_000_000), "window")
        .when(F.size(row) > most_rows, "too_many_rows")
        .when(~bounded, "counts")
        .when(~sums | unknown, "totals")
        .when(~canonical, "raw_key")
    )
    digest = F.sha2(F.to_json(F.struct(F.struct("start_us", "end_us"), F.map_entries("totals"), "rows")), 256)
    w = Window.partitionBy("instance", "batch")
    judged = df.withColumns({"_digest": digest, "reason": reason})
    judged = judged.withColumns({"_first": F.first("_digest").over(w.orderBy("start_us", "_digest")), "_nth": F.row_number().over(w.orderBy("start_us", "_digest"))})
    final = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_digest") != F.col("_first"), "conflict")
    judged = judged.withColumn("reason", final)
    good = judged.filter("reason IS NULL AND _nth = 1").select("instance", "process", "batch", "start_us", "end_us", F.posexplode("rows").alias("row_id", "r"))
    return good.select("instance", "process", "batch", "start_us", "end_us", "row_id", "r.*"), judged.filter("reason IS NOT NULL").select("instance", "process", "batch", "reason")


def redis_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key profiles whose prefixes add up to the totals, and those that do not."""
    sums = lambda c: F.aggregate("prefixes", F.lit(0).cast("bigint"), lambda a, p: a + p[c])
    ok = (sums("keys") == F.col("total_keys")) & (sums("bytes") == F.col("total_bytes"))
    return df.filter(ok).select("instance", "profile_id", F.explode("prefixes").alias("p")).select("instance", "profile_id", "p.*"), df.filter(~F.coalesce(ok, F.lit(False)))


def redis_samples(df: DataFrame, words: list[str], most_keys: int = 16, most_us: int = 60_000_000) -> DataFrame:
    """Sampled commands within bounds, their keys masked."""
    good = df.filter((F.size("keys") <= most_keys) & F.col("rate").between(0, 1) & F.col("latency_us").between(0, most_us))
    return good.withColumn("keys", F.transform("keys", lambda k: sc.key_shape(k, words)))


def redis_cloud_rates(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Minute rates of provider payloads, whitelisted metrics only: ``node_id, payload`` as an array of samples by name."""
    samples = F.from_json("payload", "array<struct<minute_us:bigint,values:map<string,double>>>")
    long = df.select("node_id", F.explode(samples).alias("s")).select("node_id", "s.minute_us", F.explode("s.values").alias("metric", "value"))
    return long.filter(F.col("metric").isin(metrics)).dropDuplicates(["node_id", "minute_us", "metric"])


def redis_cloud_slow(df: DataFrame, words: list[str]) -> DataFrame:
    """Slow commands of a provider page: keys masked, raw text dropped, partial if the total exceeds the page."""
    out = df.select("node_id", "total", F.size("items").alias("_n"), F.explode("items").alias("x")).select("node_id", (F.col("total") > F.col("_n")).alias("partial"), "x.*")
    own = F.sha2(F.concat_ws("\x1f", "node_id", *[F.col(c).cast("string") for c in ("ts_us", "command", "duration_us", "key")]), 256)
    return out.withColumns({"id": own, "key": sc.key_shape(F.col("key"), words)}).dropDuplicates(["id"])


def redis_hot_keys(df: DataFrame, words: list[str]) -> DataFrame:
    """Hot-key snapshots; items of another node are counted, not kept."""
    out = df.select("node_id", "ts_us", F.filter("items", lambda x: x["node_id"] != F.col("node_id")).alias("_o"), F.filter("items", lambda x: x["node_id"] == F.col("node_id")).alias("_k"))
    return out.select("node_id", "ts_us", F.size("_o").alias("foreign"), F.explode_outer("_k").alias("x")).select("node_id", "ts_us", "foreign", sc.key_shape(F.col("x.key"), words).alias("key"), "x.hits")


def dedupe_telemetry(df: DataFrame) -> DataFrame:
    """The latest payload of each point; its id is given or made of time, role, node, metric and period."""
    own = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in ("timestamp_us", "role", "node_id", "metric", "period")]), 256)
    rows = df.withColumn("id", F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(own))
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("received_us", "timestamp_us")).alias("x")).select("id", "x.*")


def latest_native(df: DataFrame, end_us: int, within_us: int = 7_200_000_000) -> DataFrame:
    inside = df.filter((F.col("timestamp_us") <= end_us) & (F.col("timestamp_us") >= end_us - within_us))
    rest = [c for c in df.columns if c != "node_id"]
    return inside.groupBy("node_id").agg(F.max_by(F.struct(*rest), "timestamp_us").alias("x")).select("node_id", "x.*")


def node_roles(df: DataFrame, instance: str) -> DataFrame:
    """``node_id, role, zone, status`` of a payload; one of another instance is an error."""
    nodes = F.from_json("payload", "struct<instance_id:string,nodes:array<struct<id:string,role:string,zone:string,status:string>>>")
    out = df.select(nodes.alias("p")).select(_must(F.col("p.instance_id") == instance, "roles of another instance", F.col("p.instance_id")).alias("instance_id"), F.explode("p.nodes").alias("n"))
    return out.select("instance_id", F.col("n.id").alias("node_id"), sc.normalize_role(F.col("n.role")).alias("role"), "n.zone", "n.status")


def namespace_totals(df: DataFrame) -> DataFrame:
    """Read and write locks per namespace of ``top`` payloads: ``node_id, ts_us, payload``."""
    part = "struct<time:bigint,count:bigint>"
    totals = F.from_json(F.get_json_object("payload", "$.totals"), f"map<string,struct<readLock:{part},writeLock:{part}>>")
    long = df.select("node_id", "ts_us", F.explode(totals).alias("namespace", "t"))
    return long.select("node_id", "ts_us", "namespace", F.col("t.readLock.count").alias("read_count"), F.col("t.readLock.time").alias("read_us"), F.col("t.writeLock.count").alias("write_count"), F.col("t.writeLock.time").alias("write_us"))


def performance_points(df: DataFrame) -> DataFrame:
    """Metric points of payloads whose names and values are joined by ``&``; percentages above 100 go."""
    zipped = F.explode(F.arrays_zip(F.split("value_format", "&").alias("metric"), F.split("value", "&").alias("value")))
    out = df.select("node_id", "ts_us", zipped.alias("x")).select("node_id", "ts_us", F.col("x.metric").alias("metric"), F.col("x.value").try_cast("double").alias("value"))
    return out.filter("value IS NOT NULL AND NOT (lower(metric) RLIKE 'usage|ratio|percent' AND value > 100)").withColumn("stamp", F.lit("period_start"))


def cloud_metrics(df: DataFrame) -> DataFrame:
    """Metric points of cloud payloads, stamped at the period's end and kept apart by kind."""
    points = F.from_json("payload", "array<struct<timestamp:bigint,nodeId:string,Average:double>>")
    return df.select("metric", "period", F.explode(points).alias("p")).select(F.col("p.nodeId").alias("node_id"), "metric", F.col("p.timestamp").alias("timestamp_ms"), F.col("p.Average").alias("value"), "period", F.lit("period_end").alias("stamp"))


def pod_bindings(df: DataFrame) -> DataFrame:
    """Addresses that pods own themselves (not their host's)."""
    pod = "struct<metadata:struct<name:string,namespace:string,uid:string,creationTimestamp:string>,spec:struct<hostNetwork:boolean,nodeName:string>,status:struct<hostIP:string,podIPs:array<struct<ip:string>>>>"
    out = df.select("cluster", "seen_us", F.explode(F.from_json(F.get_json_object("payload", "$.items"), f"array<{pod}>")).alias("p")).filter("NOT coalesce(p.spec.hostNetwork, false)")
    long = out.select("cluster", "seen_us", "p", F.explode(F.array_distinct(F.transform("p.status.podIPs", lambda x: x["ip"]))).alias("ip"))
    return long.select("ip", "cluster", F.col("p.metadata.namespace").alias("namespace"), F.col("p.metadata.name").alias("name"), F.col("p.metadata.uid").alias("uid"), F.col("p.spec.nodeName").alias("node"), F.col("p.status.hostIP").alias("host_ip"), F.unix_micros(F.to_timestamp("p.metadata.creationTimestamp")).alias("created_us"), "seen_us")


def host_addresses(df: DataFrame) -> DataFrame:
    """All addresses of hosts: private, public, elastic and of network interfaces."""
    host = "struct<InstanceId:string,InstanceName:string,PrivateIps:array<string>,PublicIps:array<string>,EipAddress:string,InterfaceIps:array<string>>"
    out = df.select(F.explode(F.from_json("payload", f"array<{host}>")).alias("h"))
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.array_compact(F.concat(F.coalesce("h.PrivateIps", empty), F.coalesce("h.PublicIps", empty), F.array("h.EipAddress"), F.coalesce("h.InterfaceIps", empty))))
    return out.select(F.explode(every).alias("ip"), F.col("h.InstanceName").alias("name"), F.col("h.InstanceId").alias("instance_id")).filter("ip <> ''")


def session_rows(df: DataFrame) -> DataFrame:
    """Sessions of snapshot payloads with their flags."""
    row = "struct<SessionId:string,User:string,Client:string,DbName:string,Command:string,State:string,Time:bigint,TrxId:string,TrxDuration:bigint,SqlText:string>"
    out = df.select("instance_id", "node_id", "ts_us", F.explode(F.from_json("payload", f"array<{row}>")).alias("s"))
    none = F.lit("")
    flat = out.select("instance_id", "node_id", "ts_us", F.col("s.SessionId").alias("session_id"), F.col("s.User").alias("user"), F.col("s.Client").alias("client"), F.coalesce("s.DbName", none).alias("database_name"), F.coalesce("s.Command", none).alias("command"), F.coalesce("s.State", none).alias("state"), F.coalesce("s.Time", F.lit(0)).alias("time_s"), F.coalesce("s.TrxId", none).alias("trx_id"), F.coalesce("s.TrxDuration", F.lit(0)).alias("trx_s"), F.coalesce("s.SqlText", none).alias("sql_text"))
    return session_flags(flat)


def store_sessions(df: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Current operations of a document store with their flags: ``instance_id, node_id, ts_us, payload``."""
    op = "struct<opid:string,op:string,ns:string,client:string,secs_running:bigint,waitingForLock:boolean,active:boolean,desc:string,effectiveUsers:array<struct<user:string>>,transaction:struct<timeOpenMicros:bigint>,command:string>"
    out = df.select("instance_id", "node_id", "ts_us", F.explode(F.from_json(F.get_json_object("payload", "$.inprog"), f"array<{op}>")).alias("o"))
    none = F.lit("")
    open_s = F.coalesce((F.col("o.transaction.timeOpenMicros") / 1_000_000).cast("bigint"), F.lit(0))
    flat = out.select(
        "instance_id", "node_id", "ts_us", F.col("o.opid").alias("session_id"), F.coalesce(F.col("o.effectiveUsers")[0]["user"], none).alias("user"), F.coalesce("o.client", none).alias("client"),
        F.substring_index(F.coalesce("o.ns", none), ".", 1).alias("database_name"), F.when(F.coalesce("o.active", F.lit(False)), F.coalesce("o.op", none)).otherwise("Sleep").alias("command"),
        F.when(F.coalesce("o.waitingForLock", F.lit(False)), "lock wait").otherwise("").alias("state"), F.coalesce("o.secs_running", F.lit(0)).alias("time_s"),
        F.when(F.col("o.transaction").isNotNull(), F.col("o.opid")).otherwise("").alias("trx_id"), open_s.alias("trx_s"), F.coalesce("o.command", none).alias("sql_text"),
    )
    return session_flags(flat, thresholds) if thresholds else session_flags(flat)


def provider_events(df: DataFrame, fields: list[str]) -> DataFrame:
    """Provider events with whitelisted fields only, once each by a digest of those: ``node_id, payload``."""
    events = df.select("node_id", F.explode(F.from_json("payload", "array<map<string,string>>")).alias("m"))
    kept = F.map_filter("m", lambda k, v: k.isin(fields))
    own = F.sha2(F.concat_ws("\x1f", "node_id", *[F.coalesce(kept[f], F.lit("\x00")) for f in sorted(fields)]), 256)
    return events.select("node_id", own.alias("id"), kept.alias("fields")).dropDuplicates(["id"])
