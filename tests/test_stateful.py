"""Stateful streams: any order of arrival and any cut into batches gives the result of the ordered rows."""

import itertools
import random

import pandas as pd
import pytest

from changelens.streaming import stateful
from changelens.streaming.keyed import KeyedStore

M = 60_000_000


class Held:
    """State in memory, as the processors see it."""

    def __init__(self):
        self.maps, self.values = {}, {}

    def getMapState(self, name, *_, **__):  # noqa: N802
        held = self.maps.setdefault(name, {})

        class State:
            iterator = staticmethod(lambda: iter(list(held.items())))
            updateValue = staticmethod(held.__setitem__)
            removeKey = staticmethod(held.__delitem__)

        return State

    def getValueState(self, name, *_, **__):  # noqa: N802
        values = self.values

        class State:
            exists = staticmethod(lambda: name in values)
            get = staticmethod(lambda: values[name])
            update = staticmethod(lambda v: values.__setitem__(name, v))

        return State


def played(make, batches, places):
    """What a keyed store of one key holds after the batches, and the places of late rows; each batch in a new processor."""
    held, store, late = Held(), {}, []
    for rows in batches:
        p = make()
        p.keys = ["k"]
        p.init(held)
        seen = set()
        for out in p.handleInputRows(("k",), iter([pd.DataFrame(rows)]), None):
            for r in out.itertuples(index=False):
                at = tuple(r[1 : 1 + places])
                if r.late:
                    late.append(at)
                    continue
                assert at not in seen
                seen.add(at)
                if r.gone:
                    store.pop(at, None)
                else:
                    store[at] = tuple(None if pd.isna(x) else x for x in r[1 + places : -2])
    return store, late, held


def cuts(rows, rng):
    rows = rng.sample(rows, len(rows))
    at = sorted(rng.sample(range(1, len(rows)), min(3, len(rows) - 1)))
    return [rows[a:b] for a, b in itertools.pairwise([0, *at, len(rows)])]


def test_every_order_of_sightings_gives_the_same_sessions():
    rows = [{"ts_us": t * M, "seconds": s} for t, s in ((0, 1), (4, 7), (9, 2), (20, 3), (25, None))]
    make = lambda: stateful._Sessions(5 * M, 60 * M, None)
    want = {(0,): (9 * M, 3, 7), (20 * M,): (25 * M, 2, 3)}
    for order in itertools.permutations(rows):
        assert played(make, [[r] for r in order], 1)[0] == want
        assert played(make, [order[:2], order[2:]], 1)[0] == want


def test_closed_sessions_leave_the_state_and_late_rows_are_told():
    make = lambda: stateful._Sessions(5 * M, 10 * M, None)
    row = lambda t: {"ts_us": t * M, "seconds": 1}
    store, late, held = played(make, [[row(0), row(3)], [row(100)], [row(2)], [row(91)]], 1)
    assert store == {(0,): (3 * M, 2, 1), (100 * M,): (100 * M, 1, 1), (91 * M,): (91 * M, 1, 1)}
    assert late == [(2 * M,)]
    assert set(held.maps["rows"]) == {(91 * M,), (100 * M,)}


def _deltas(rows):
    by = {}
    for r in rows:
        at = r["ts_us"]
        by[at] = min(by.get(at, (r["calls"], r["usec"])), (r["calls"], r["usec"]))
    out = {}
    for a, b in itertools.pairwise(sorted(by)):
        down = by[b][0] < by[a][0] or by[b][1] < by[a][1]
        out[(b,)] = (a, "counter_reset", None, None) if down else (a, "ok", by[b][0] - by[a][0], by[b][1] - by[a][1])
    return out


def _changes(rows):
    by = {}
    for r in rows:
        at, v = r["ts_us"], r["state"]
        by[at] = v if at not in by else min(by[at], v, key=lambda x: (x is not None, x or ""))
    return {(b,): (by[b], by[a]) for a, b in itertools.pairwise(sorted(by)) if by[a] != by[b]}


def _reads(rows):
    database, out = "", {}
    for r in sorted(rows, key=lambda r: (r["event_epoch_us"], r["seq"])):
        c, a = r["command"], r["argument"]
        if c == "Quit":
            database = ""
        elif c == "Init DB":
            database = a.strip()
        elif c == "Connect":
            database = a.split(" on ")[1].split()[0]
        elif a.startswith("use "):
            database = a[4:].strip("`")
        elif r["is_read"]:
            out[r["event_epoch_us"], r["seq"]] = (database, r["user"], a)
    return out


@pytest.mark.parametrize("seed", range(10))
def test_random_orders(seed):
    rng = random.Random(seed)
    counters = [{"ts_us": rng.randrange(40), "calls": rng.randrange(9), "usec": rng.randrange(9)} for _ in range(25)]
    states = [{"ts_us": rng.randrange(40), "state": rng.choice(["a", "b", None])} for _ in range(25)]
    log = []
    for n in range(30):
        command, text = rng.choice([("Quit", ""), ("Init DB", " shop "), ("Connect", "u@h on crm using TCP"), ("Query", "use `other`"), *[("Query", f"SELECT {n}")] * 4])
        log.append({"event_epoch_us": rng.randrange(20), "seq": n, "command": command, "argument": text, "user": "app", "is_read": text.startswith("SELECT")})
    for late in (100, 40):
        for _ in range(5):
            assert played(lambda: stateful._Deltas(late, None), cuts(counters, rng), 1)[0] == _deltas(counters)  # noqa: B023
            assert played(lambda: stateful._Changes("state", late, None), cuts(states, rng), 1)[0] == _changes(states)  # noqa: B023
            assert played(lambda: stateful._Reads(late, None), cuts(log, rng), 2)[0] == _reads(log)  # noqa: B023


def test_state_is_bounded_by_lateness():
    """Rows at most as late as allowed are placed as ever, though the state holds no more than the recent ones."""
    rng = random.Random(3)
    rows = [{"ts_us": t, "calls": rng.randrange(9), "usec": t} for t in range(1000)]
    arrived = sorted(rows, key=lambda r: r["ts_us"] + rng.randrange(50))
    batches = [arrived[i : i + 40] for i in range(0, 1000, 40)]
    store, late, held = played(lambda: stateful._Deltas(50, None), batches, 1)
    assert store == _deltas(rows) and not late
    assert len(held.maps["rows"]) <= 51


def test_streams_through_files_and_a_restart(spark, tmp_path):
    """Sightings out of order over two runs of one checkpoint; a late one joins two sessions; a repeated batch changes nothing."""
    schema = "instance_id string, node_id string, session_id string, user string, client string, ts_us long, seconds long"
    row = lambda s, t: ("i", "n", s, "u", "c", t * M, t)
    store = KeyedStore(str(tmp_path / "store"), ["instance_id", "node_id", "session_id", "user", "client", "first_us"], 4)
    for part in ([row("s", 20), row("s", 0), row("t", 5), row("s", 9)], [row("s", 4), row("t", 100), row("t", 5)]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "rows"))
        sessions = stateful.abnormal_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "rows")), 5 * M, 60 * M)
        writer = sessions.writeStream.outputMode("update").foreachBatch(store.write).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    want = [("s", 0, 9 * M, 3), ("s", 20 * M, 20 * M, 1), ("t", 5 * M, 5 * M, 2), ("t", 100 * M, 100 * M, 1)]
    held = lambda s: sorted(tuple(r) for r in s.read(spark).select("session_id", "first_us", "last_us", "seen").collect())
    assert held(store) == sorted(want)
    assert store.late(spark).count() == 0
    small = store.compact(spark, str(tmp_path / "small"))
    assert held(small) == sorted(want)
    store.write(spark.createDataFrame([], "instance_id string, node_id string, session_id string, user string, client string, first_us long, last_us long, seen long, max_seconds long"), 9)
    assert held(store) == sorted(want)


def test_numbered_snapshots_of_one_time_all_count():
    """Two snapshots of one time, in any order of arrival: each is compared with the one before it by number."""
    rows = [{"ts_us": t, "seq": n, "state": s} for t, n, s in ((1, 1, "a"), (5, 2, "b"), (5, 3, "a"), (5, 4, "a"), (9, 5, "c"))]
    want = {(5, 2): ("b", "a"), (5, 3): ("a", "b"), (9, 5): ("c", "a")}
    for order in itertools.permutations(rows):
        for batches in ([order], [order[:2], order[2:]]):
            assert played(lambda: stateful._NumberedChanges("state", "seq", 100, None), batches, 2)[0] == want


def test_a_bucket_reads_and_writes_each_key_once_a_batch():
    """Many keys in one call give what each gives alone; each is read once and written once, however many rows it holds."""
    rng = random.Random(5)
    batches = [[{"a": rng.choice(["x", "y", None]), "b": rng.choice("pq"), "ts_us": rng.randrange(60), "calls": rng.randrange(9), "usec": rng.randrange(9)} for _ in range(80)] for _ in range(3)]
    held, reads, writes = {}, [], []

    class State:
        getValue = staticmethod(lambda k: reads.append(k) or held.get(k))  # noqa: N815
        updateValue = staticmethod(lambda k, v: writes.append(k) or held.__setitem__(k, v))  # noqa: N815

    class Handle:
        getMapState = staticmethod(lambda *_, **__: State)  # noqa: N815

    store, late = {}, []
    for rows in batches:
        rule = stateful._Deltas(30, None)
        rule.keys = ["a", "b"]
        p = stateful.Buckets(rule, "a string, b string")
        p.init(Handle)
        reads.clear(), writes.clear()
        for out in p.handleInputRows((0,), iter([pd.DataFrame(rows[:50]), pd.DataFrame(rows[50:])]), None):
            for r in out.itertuples(index=False):
                if r.late:
                    late.append((r.a, r.b, r.end_us))
                else:
                    store.setdefault((r.a, r.b), {})[(r.end_us,)] = tuple(None if pd.isna(x) else x for x in r[3:-2])
        keys = {(r["a"], r["b"]) for r in rows}
        assert len(reads) == len(keys) == 6 and set(reads) == keys
        assert len(writes) <= len(keys)
    lates = []
    for key in held:
        own = [[r for r in rows if (r["a"], r["b"]) == key] for rows in batches]
        want, missed, _ = played(lambda: stateful._Deltas(30, None), own, 1)
        assert store[key] == want
        lates += [(*key, *at) for at in missed]
    assert sorted(late, key=str) == sorted(lates, key=str) and late


def test_keys_are_grouped_by_bucket_and_stay_exact(spark, tmp_path):
    """Whole numbers beyond 2^53 beside a null key, over two runs of one checkpoint."""
    schema = "server string, thread long, seq long, event_epoch_us long, user string, command string, argument string, tag string"
    big = 2**53 + 1
    rows = [("s", t, n, n * M, "u", c, a, "not read") for t in (big, big - 1, None) for n, c, a in ((1, "Init DB", f"d{t}"), (2, "Query", "SELECT 1"), (3, "Query", "SELECT 2"))]
    store = KeyedStore(str(tmp_path / "store"), ["server", "thread", "event_epoch_us", "seq"], 4)
    for part in (rows[1::3] + rows[:1], rows[2::3] + rows[3::3]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "rows"))
        reads = stateful.general_log_reads(spark.readStream.schema(schema).parquet(str(tmp_path / "rows")), 60 * M)
        writer = reads.writeStream.outputMode("update").foreachBatch(store.write).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    got = store.read(spark)
    assert dict(got.dtypes)["thread"] == "bigint"
    want = {(t, f"d{t}", f"SELECT {n}") for t in (big, big - 1, None) for n in (1, 2)}
    assert {tuple(r) for r in got.select("thread", "database_name", "sql_text").collect()} == want
