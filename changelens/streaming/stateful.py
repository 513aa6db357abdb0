"""Streams whose result for a row depends on the rows before it in event time, whatever the order of arrival.

Each key holds the rows of the last ``late_us`` of its event time, and what came before them folded into one value (the floor).
A batch is put in its place among them; what changes in the result is emitted as rows to be put into a keyed store
(``keyed.KeyedStore``): new and changed rows, and ``gone`` for rows that no longer hold. A row older than the floor can't be
placed any more; it is emitted with ``late``, so that it is seen, never dropped silently. With rows at most ``late_us`` late the
store equals the batch result for any order of files and any cut into batches.

State is ``transformWithStateInPandas`` on RocksDB, so its size follows lateness and keys, not history. ``idle_ms`` lets the state of
keys that are heard of no more expire. A call of the processor has a cost of its own, as has each access to state: the streams are grouped
by buckets of keys (``Buckets``), and what a key holds, its recent rows and its floor, is one entry of the bucket's map, read and written
once a batch. ``LateOrdered`` alone is the same for streams grouped by the key itself: a map of recent rows and a value for the floor.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalar import is_read

Item = tuple[tuple, tuple]
HOUR_US = 3_600_000_000
BUCKETS = 512
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _longs(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ") if c.endswith(" long")]


class LateOrdered(StatefulProcessor):
    """``needs``: columns that are read beside the key; ``order``: what rows of a key are placed by, event time in microseconds first;
    ``record``: what is kept of a row; ``state``: what the floor keeps; ``place`` and ``values``: key and other columns of the result."""

    needs: list[str]
    order: str
    record: str
    state: str
    place: str
    values: str

    def __init__(self, late_us: int, idle_ms: int | None = None):
        self.late_us, self.idle_ms = late_us, idle_ms

    def read(self, rows: pd.DataFrame) -> Iterable[Item | None]:
        """An item for each row, None for a row that says nothing."""
        raise NotImplementedError

    def same(self, a: tuple, b: tuple) -> tuple:
        """What stands for two rows of one place; must not depend on their order."""
        return min(a, b)

    def outputs(self, state: tuple | None, items: list[Item]) -> dict[tuple, tuple]:
        """Result rows of the held ``items``, which are in order and follow the floor's ``state``."""
        raise NotImplementedError

    def compact(self, items: list[Item]) -> list[Item]:
        return items

    def over(self, item: Item, edge_us: int) -> bool:
        return item[0][0] < edge_us

    def retire(self, state: tuple | None, items: list[Item]) -> tuple:
        """The floor's state after ``items``."""
        raise NotImplementedError

    def init(self, handle) -> None:
        ttl = {} if self.idle_ms is None else {"ttlDurationMs": self.idle_ms}
        self._rows = handle.getMapState("rows", self.order, self.record, **ttl)
        self._floor = handle.getValueState("floor", f"edge_us long, {self.state}", **ttl)

    def turn(self, old: dict, floor: tuple | None, items: Iterable[Item]) -> tuple[dict, tuple | None, list[tuple]]:
        """A key's held rows and floor after ``items``, and the rows of the result that change, without the key."""
        edge, state = (floor[0], floor[1:]) if floor else (None, None)
        new, late = dict(old), []
        for at, record in items:
            if edge is not None and at[0] < edge:
                late.append(at)
            else:
                new[at] = self.same(new[at], record) if at in new else record
        held = self.compact(sorted(new.items()))
        before, after = self.outputs(state, sorted(old.items())) if old else {}, self.outputs(state, held)
        newest = max((k[0] for k, _ in held), default=None)
        if newest is not None and (edge is None or newest - self.late_us > edge):
            past = [x for x in held if self.over(x, newest - self.late_us)]
            if past:
                held = [x for x in held if not self.over(x, newest - self.late_us)]
                floor = (newest - self.late_us, *self.retire(state, past))
        nothing = (None,) * len(_names(self.values))
        out = [(*k, *v, False, False) for k, v in after.items() if before.get(k) != v]
        out += [(*k, *nothing, True, False) for k in before.keys() - after.keys()]
        out += [(*k, *nothing, False, True) for k in late]
        return dict(held), floor, out

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        """Rows of the result, keys first."""
        out = pd.DataFrame(rows, columns=[*self.keys, *_names(self.place), *_names(self.values), "gone", "late"], dtype=object)
        return out.astype(dict.fromkeys(_longs(f"{self.place}, {self.values}"), "Int64") | {"gone": bool, "late": bool})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        floor = tuple(self._floor.get()) if self._floor.exists() else None
        old = {tuple(k): tuple(v) for k, v in self._rows.iterator()}
        kept, now, out = self.turn(old, floor, (x for batch in rows for x in self.read(batch) if x is not None))
        if now != floor:
            self._floor.update(now)
        for k in old.keys() - kept.keys():
            self._rows.removeKey(k)
        for k, v in kept.items():
            if old.get(k) != v:
                self._rows.updateValue(k, v)
        yield self.frame([(*key, *x) for x in out])

    def close(self) -> None:
        pass


class Buckets(StatefulProcessor):
    """``rule`` for every key of a bucket. A key's entry in the map is its floor and its recent rows, one array for each of their columns.

    Keys are text where they are whole numbers to Spark, so that a null among them makes no fractions of the others.
    """

    def __init__(self, rule: LateOrdered, key_ddl: str):
        self.rule, self.key_ddl = rule, key_ddl
        self.places, self.known = len(_names(rule.order)), len(_names(rule.state))

    def init(self, handle) -> None:
        ttl = {} if self.rule.idle_ms is None else {"ttlDurationMs": self.rule.idle_ms}
        floor = ["edge_us long", *[f"floor_{c}" for c in self.rule.state.split(", ")]]
        rows = [f"{name} array<{kind}>" for name, kind in (c.split() for c in f"{self.rule.order}, {self.rule.record}".split(", "))]
        self._held = handle.getMapState("held", self.key_ddl, ", ".join([*floor, *rows]), **ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        items: dict[tuple, list[Item]] = {}
        for batch in rows:
            for own, item in zip(zip(*[batch[k] for k in self.rule.keys], strict=True), self.rule.read(batch), strict=True):
                if item is not None:
                    items.setdefault(own, []).append(item)
        out = []
        for own, fresh in items.items():
            held = self._held.getValue(own)
            floor, old = self._loaded(tuple(held)) if held is not None else (None, {})
            kept, now, changed = self.rule.turn(old, floor, fresh)
            if now != floor or kept != old:
                self._held.updateValue(own, self._packed(now, kept))
            out += [(*own, *x) for x in changed]
        yield self.rule.frame(out)

    def _loaded(self, held: tuple) -> tuple[tuple | None, dict]:
        first = 1 + self.known
        rows = zip(*held[first:], strict=True)
        return None if held[0] is None else held[:first], {x[: self.places]: x[self.places :] for x in rows}

    def _packed(self, floor: tuple | None, kept: dict) -> tuple:
        columns = zip(*[(*k, *v) for k, v in kept.items()], strict=True)
        return (*(floor or (None,) * (1 + self.known)), *(map(list, columns) if kept else [[]] * len(_names(f"{self.rule.order}, {self.rule.record}"))))

    def close(self) -> None:
        pass


def _through(df: DataFrame, keys: list[str], processor: LateOrdered) -> DataFrame:
    kinds = dict(df.dtypes)
    processor.keys = keys
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    whole = {k for k in keys if kinds[k] in ("tinyint", "smallint", "int", "bigint")}

    def key(k: str) -> Column:
        return (F.col(k).cast("string") if k in whole else F.col(k)).alias(k)

    rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"), *map(key, keys), *processor.needs)
    key_ddl = ", ".join(f"`{k}` {'string' if k in whole else kinds[k]}" for k in keys)
    schema = ", ".join([key_ddl, processor.place, processor.values, "gone boolean, late boolean"])
    mode = "None" if processor.idle_ms is None else "ProcessingTime"
    out = rows.groupBy("_bucket").transformWithStateInPandas(Buckets(processor, key_ddl), schema, "Update", mode)
    return out.withColumns({k: F.col(k).cast(kinds[k]) for k in whole}) if whole else out


class _Deltas(LateOrdered):
    needs = ["ts_us", "calls", "usec"]
    order, record, state = "end_us long", "calls long, usec long", "last_us long, calls long, usec long"
    place, values = "end_us long", "start_us long, status string, calls long, usec long"

    def read(self, rows):
        return (((int(t),), (int(c), int(u))) for t, c, u in zip(rows["ts_us"], rows["calls"], rows["usec"], strict=True))

    def outputs(self, state, items):
        out = {}
        for (at,), now in items:
            if state is not None:
                down = now[0] < state[1] or now[1] < state[2]
                out[(at,)] = (state[0], "counter_reset", None, None) if down else (state[0], "ok", now[0] - state[1], now[1] - state[2])
            state = (at, *now)
        return out

    def retire(self, state, items):
        (at,), now = items[-1]
        return (at, *now)


def counter_deltas(df: DataFrame, late_us: int = 2 * HOUR_US, idle_ms: int | None = None) -> DataFrame:
    """Differences of cumulative counters per node and command, each snapshot against the one before it in time.

    Of two snapshots of one time the smaller counts. Result key: ``node_id, command, end_us``.
    """
    return _through(df, ["node_id", "command"], _Deltas(late_us, idle_ms))


class _Changes(LateOrdered):
    order, record, state = "ts_us long", "value string", "value string"
    place, values = "ts_us long", "value string, before string"

    def __init__(self, field, late_us, idle_ms):
        super().__init__(late_us, idle_ms)
        self.field, self.needs = field, ["ts_us", field]

    def read(self, rows):
        return (((int(t),), (None if v is None or v != v else v,)) for t, v in zip(rows["ts_us"], rows[self.field], strict=True))

    def same(self, a, b):
        return min(a, b, key=lambda v: (v[0] is not None, v[0] or ""))

    def outputs(self, state, items):
        out = {}
        for at, now in items:
            if state is not None and state != now:
                out[at] = (now[0], state[0])
            state = now
        return out

    def retire(self, state, items):
        return items[-1][1]


class _NumberedChanges(_Changes):
    order = place = "ts_us long, seq long"

    def __init__(self, field, seq, late_us, idle_ms):
        super().__init__(field, late_us, idle_ms)
        self.seq, self.needs = seq, [*self.needs, seq]

    def read(self, rows):
        return (((*at, int(n)), now) for (at, now), n in zip(super().read(rows), rows[self.seq], strict=True))


def snapshot_changes(df: DataFrame, field: str, late_us: int = 2 * HOUR_US, idle_ms: int | None = None, seq: str | None = None) -> DataFrame:
    """An event where a node's field differs from its snapshot before. Result key: ``node_id, ts_us``, with ``seq`` also ``seq``.

    Of two snapshots of one time the smaller value counts, null first; where ``seq`` names a number of the snapshots, each counts, in its order.
    """
    return _through(df, ["node_id"], _NumberedChanges(field, seq, late_us, idle_ms) if seq else _Changes(field, late_us, idle_ms))


class _Reads(LateOrdered):
    needs = ["event_epoch_us", "seq", "command", "argument", "user", "is_read"]
    order, record, state = "us long, seq long", "mark string, user string, text string", "mark string"
    place, values = "event_epoch_us long, seq long", "database_name string, user string, sql_text string"
    _connect, _use = re.compile(r"\son\s+(\S+)\s+using\b", re.I), re.compile(r"^\s*use\s+`?([^`;\s]+)", re.I)

    def _kept(self, command, text, user, reads):
        if command == "init db":
            return text.strip(), None, None
        if command == "connect":
            found = self._connect.search(text)
            return found[1] if found else "", None, None
        if command == "quit":
            return "", None, None
        if command in ("query", "execute"):
            found = self._use.match(text)
            if found:
                return found[1], None, None
            if reads:
                return None, user, text
        return None

    def read(self, rows):
        for t, n, c, a, u, r in zip(rows["event_epoch_us"], rows["seq"], rows["command"], rows["argument"], rows["user"], rows["is_read"], strict=True):
            kept = self._kept(c.lower(), a or "", u, r)
            yield None if kept is None else ((int(t), int(n)), kept)

    def same(self, a, b):
        return min(a, b, key=lambda v: [(x is not None, x or "") for x in v])

    def outputs(self, state, items):
        out, database = {}, state[0] if state else ""
        for at, (mark, user, text) in items:
            if mark is not None:
                database = mark
            else:
                out[at] = (database, user, text)
        return out

    def retire(self, state, items):
        marks = [mark for _, (mark, _, _) in items if mark is not None]
        return (marks[-1] if marks else state[0] if state else "",)


def general_log_reads(df: DataFrame, late_us: int = 2 * HOUR_US, idle_ms: int | None = None) -> DataFrame:
    """Read statements with the database that their session held; a late change of database corrects the reads behind it.

    ``df``: ``server, thread, seq, event_epoch_us, user, command, argument``. Result key: ``server, thread, event_epoch_us, seq``.
    """
    return _through(df.withColumn("is_read", is_read(F.col("argument"))), ["server", "thread"], _Reads(late_us, idle_ms))


class _Sessions(LateOrdered):
    needs = ["ts_us", "seconds"]
    order, record, state = "first_us long", "last_us long, seen long, max_seconds long", "none string"
    place, values = "first_us long", "last_us long, seen long, max_seconds long"

    def __init__(self, gap_us, late_us, idle_ms):
        super().__init__(late_us, idle_ms)
        self.gap_us = gap_us

    def read(self, rows):
        return (((int(t),), (int(t), 1, None if s is None or s != s else int(s))) for t, s in zip(rows["ts_us"], rows["seconds"], strict=True))

    def same(self, a, b):
        known = [x for x in (a[2], b[2]) if x is not None]
        return max(a[0], b[0]), a[1] + b[1], max(known, default=None)

    def compact(self, items):
        out: list = []
        for at, now in items:
            if out and at[0] - out[-1][1][0] <= self.gap_us:
                out[-1] = (out[-1][0], self.same(out[-1][1], now))
            else:
                out.append((at, now))
        return out

    def outputs(self, state, items):
        return dict(items)

    def over(self, item, edge_us):
        return item[1][0] + self.gap_us < edge_us

    def retire(self, state, items):
        return (None,)


def abnormal_sessions(df: DataFrame, gap_us: int = 300_000_000, late_us: int = 2 * HOUR_US, idle_ms: int | None = None) -> DataFrame:
    """Sessions of abnormal sightings no more than ``gap_us`` apart. A late sighting extends the session that it belongs to,
    or joins two of them into one: the second is ``gone``. Result key: the session's columns and ``first_us``.

    ``df``: ``instance_id, node_id, session_id, user, client, ts_us, seconds``. Only open sessions are held, not sightings.
    """
    return _through(df, ["instance_id", "node_id", "session_id", "user", "client"], _Sessions(gap_us, late_us, idle_ms))
