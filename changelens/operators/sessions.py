"""Sessions: flags on live snapshots, possible lock holders, history of abnormal sessions, client identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import stab
from ..functions.scalar import client_host
from ..functions.series import islands

THRESHOLDS = {"long_s": 30, "trx_s": 30, "idle_trx_s": 10}
IDLE = ("sleep", "daemon", "binlog dump", "binlog dump gtid")


def waits_for_lock(state: Column) -> Column:
    return F.lower(state).rlike(r"waiting for .*lock|lock wait|wait_for_lock|metadata lock")


def protected_reason(user: Column, command: Column) -> Column:
    """Why a session must be left alone; null if nothing speaks against ending it."""
    return F.when(F.lower(command).isin("binlog dump", "binlog dump gtid"), "replication").when(F.lower(command) == "daemon", "daemon").when(F.lower(user).isin("system user", "event_scheduler", "rdsadmin", "root"), "system_account")


def session_flags(df: DataFrame, thresholds: dict[str, int] = THRESHOLDS) -> DataFrame:
    """``kinds`` of each session: long_running, lock_wait, long_trx, idle_trx."""
    idle = F.lower("command").isin(*IDLE)
    wait = waits_for_lock(F.col("state"))
    marks = [
        F.when(~idle & (F.col("time_s") >= thresholds["long_s"]), "long_running"),
        F.when(wait, "lock_wait"),
        F.when((F.col("trx_id") != "") & (F.col("trx_s") >= thresholds["trx_s"]), "long_trx"),
        F.when(idle & (F.col("trx_id") != "") & (F.col("trx_s") >= thresholds["idle_trx_s"]), "idle_trx"),
    ]
    return df.withColumns({"kinds": F.array_compact(F.array(*marks)), "waiting": F.coalesce(wait, F.lit(False))})


def lock_holder_candidates(flagged: DataFrame, most: int = 20) -> DataFrame:
    """Sessions that do not wait and whose transaction (or running statement) is at least as old as the oldest wait."""
    snapshot = Window.partitionBy("instance_id", "node_id", "ts_us")
    oldest = F.max(F.when(F.col("waiting"), F.col("time_s"))).over(snapshot)
    age = F.when(F.col("trx_id") != "", F.col("trx_s")).when(~F.lower("command").isin(*IDLE), F.col("time_s"))
    held = flagged.withColumns({"oldest_wait_s": oldest, "age_s": age}).filter(~F.col("waiting") & (F.col("age_s") >= F.col("oldest_wait_s")))
    rank = F.row_number().over(snapshot.orderBy(F.desc("age_s"), "session_id"))
    return held.withColumn("rank", rank).filter(F.col("rank") <= most)


def session_counts(flagged: DataFrame, by: str) -> DataFrame:
    """Sessions by user, client or database: all, active, abnormal."""
    column = {"user": F.col("user"), "client": client_host(F.col("client")), "database": F.col("database_name")}[by]
    return flagged.groupBy("instance_id", "node_id", "ts_us", column.alias(by)).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.lower("command").isin(*IDLE)).alias("active"), F.count_if(F.size("kinds") > 0).alias("abnormal"))


def session_history(sightings: DataFrame, gap_us: int = 300_000_000) -> DataFrame:
    """Abnormal sessions: sightings of one session no more than ``gap_us`` apart are one.

    The first statement seen is kept, completed by a longer one that begins with it.
    """
    keys = ["instance_id", "node_id", "session_id", "user", "client"]
    runs = islands(sightings, keys, "ts_us", F.col("ts_us") - F.col("prev") <= gap_us)
    out = runs.groupBy(*keys, "run").agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count_distinct("ts_us").alias("seen"),
        F.max("seconds").alias("max_seconds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
        F.min_by("sql_text", F.when(F.col("sql_text") != "", F.col("ts_us"))).alias("_first"),
        F.max_by("sql_text", F.struct(F.length("sql_text"), -F.col("ts_us"))).alias("_longest"),
    )
    text = F.when(F.startswith(F.col("_longest"), F.col("_first")), F.col("_longest")).otherwise(F.col("_first"))
    return out.withColumn("sql_text", text).drop("_first", "_longest", "run")


def resolve_pod(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """Whose address a client was: one observed binding, several (ambiguous), one created but not observed, or none."""
    e = events.withColumn("ip", client_host(F.col("client_ip")))
    held = bindings.withColumn("_end", F.col("last_seen_us") + 1)
    pod = F.struct("uid", "name", "namespace")
    seen = stab(e, held, ["ip"], "event_epoch_us", "first_seen_us", "_end", {"observed": (F.lit(1), "sum"), "pod": (pod, "max")})
    made = bindings.groupBy("ip").agg(F.min("created_us").alias("_created"))
    out = e.select("event_id", "ip", "event_epoch_us").join(seen.hint("merge"), ["ip", "event_epoch_us"], "left").join(made.hint("merge"), "ip", "left")
    only = F.col("observed") == 1
    reason = F.when(F.col("observed") > 1, "ambiguous_ip").when(only, "observed_interval").when(F.col("_created") <= F.col("event_epoch_us"), "historical_binding_unverified").otherwise("ip_not_observed")
    return out.select("event_id", "ip", reason.alias("reason"), F.when(only, F.col("pod.name")).alias("pod"), F.when(only, F.col("pod.namespace")).alias("namespace"))


def name_ips(ips: DataFrame, bindings: DataFrame, hosts: DataFrame, slack_us: int = 120_000_000) -> DataFrame:
    """Display names of addresses: the only binding seen around the time, else the host that has the address."""
    wide = bindings.select("ip", "name", (F.col("first_seen_us") - slack_us).alias("_lo"), (F.col("last_seen_us") + slack_us + 1).alias("_hi"))
    seen = stab(ips, wide, ["ip"], "at_us", "_lo", "_hi", {"_n": (F.lit(1), "sum"), "_pod": (F.col("name"), "max")})
    found = ips.select("ip", "at_us").distinct().join(seen, ["ip", "at_us"], "left")
    own = hosts.groupBy("ip").agg(F.min("name").alias("_host"))
    return found.join(own, "ip", "left").select("ip", "at_us", F.coalesce(F.when(F.col("_n") == 1, F.col("_pod")), F.col("_host")).alias("name"))


def binding_intervals(sightings: DataFrame, expire_us: int | None = None, now_us: int | None = None) -> DataFrame:
    """Validity of (uid, ip) bindings: first and last sighting; bindings unseen for ``expire_us`` go."""
    out = sightings.groupBy("uid", "ip").agg(F.min("seen_us").alias("first_seen_us"), F.max("seen_us").alias("last_seen_us"), F.max_by("name", "seen_us").alias("name"))
    return out if expire_us is None else out.filter(F.col("last_seen_us") >= now_us - expire_us)
