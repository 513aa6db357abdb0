"""Repair of conversation structure by weighted CYK parsing over intervals of turns.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant turns. The repair grammar is
in Chomsky normal form: nonterminal [p q] stands for turns whose repaired roles lead from place p of that pattern to place q,
with rules [p q] -> [p r] [r q], and a terminal rule for each edit of one turn (Keep, Rerole, Delete). Insertion closure lets
any nonterminal be led by or followed by inserted turns. A cell of the parse table holds, for one span of turns and each
nonterminal, the least (cost, audit): audits are compared as text where costs are equal. Of two audits of one span with equal costs
neither is a prefix of the other, so the order survives concatenation. Cells are combined bottom-up by span length: 1, 2, 4 and so on
within a segment, then over segments. As the nonterminals between two places are all there, every split of a span yields the same
cell, and one split is enough.

Faults: blank (no visible character), duplicate (role and text were there before), truncated (the last visible character is none
of ``.!?``); a turn's first fault counts. Blank and duplicate turns must go; a truncated turn that stays costs extra.

Scale: turns are range-partitioned by conversation, turn and digest, so a long conversation lies in several tasks; each task
parses its share in segments of ``SEGMENT`` turns. Duplicates are found by an aggregation on conversation and digest and flagged by
turn number, so no hot key is joined. Segments of a conversation meet in one task with their cells only (16 bytes a turn: an audit is one
string, as asked for); decisions go back segment by segment, and texts move once, to their decisions, by turn number.
``digests`` streams the repaired turns of a conversation through SHA-256, which can't be split, in bounded memory.

Defined results: null ids are one conversation; null turn numbers come first and count in no gap; ties of turn numbers are ordered
by role, then by digest, equal turns are neighbours; null roles and texts count as one space; a role that starts with none of ``s``,
``u``, ``a`` (or is empty) can't be kept as it is. Other columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, shared_folder, stash, table

SEGMENT = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = "0123"
#: Places of the pattern: start, after system, after user, after assistant; a conversation may end at the first and the last.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
PLACES = 4
#: The role that an inserted or changed turn gets at each place; there is only one.
NEXT = ("user", "user", "assistant", "user")

Cell = list[tuple[int, str] | None]


class Repair(NamedTuple):
    """``turns``: ``<conv_id>, pid, k, i, edit, turn, role, text``, in order of ``pid, k, i``, deleted turns (edit D) included;
    ``report``: ``<conv_id>, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation with turns."""

    turns: DataFrame
    report: DataFrame


def combine(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans: [p q] -> [p r] [r q]."""
    out: Cell = [None] * (PLACES * PLACES)
    for p in range(PLACES):
        for r in range(PLACES):
            if not (a := x[p * PLACES + r]):
                continue
            for q in range(PLACES):
                if not (b := y[r * PLACES + q]):
                    continue
                best, cost = out[p * PLACES + q], a[0] + b[0]
                if best is None or cost < best[0] or cost == best[0] and a[1] + b[1] < best[1]:
                    out[p * PLACES + q] = (cost, a[1] + b[1])
    return out


def _cell(rules: list[tuple[int, int, int, str]]) -> Cell:
    out: Cell = [None] * (PLACES * PLACES)
    for p, q, cost, audit in rules:
        at = p * PLACES + q
        if out[at] is None or (cost, audit) < out[at]:
            out[at] = (cost, audit)
    return out


@cache
def insertions() -> Cell:
    """The empty span: nothing, or the fewest insertions between two places."""
    one = _cell([(p, p, 0, "") for p in range(PLACES)] + [(p, q, INSERT, "I") for (p, s), q in STEPS.items() if s != "s"])
    two = combine(one, one)
    while two != one:
        one, two = two, combine(two, two)
    return one


@cache
def terminal(initial: str, fault: str) -> Cell:
    """The cell of one turn, closed under insertion on both sides."""
    rules = [(p, p, DELETE, "D") for p in range(PLACES)]
    if fault in (FINE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        rules += [(p, q, extra, "K") for (p, s), q in STEPS.items() if s == initial]
        rules += [(p, q, REROLE + extra, "R") for (p, s), q in STEPS.items() if s != "s"]
    return combine(combine(insertions(), _cell(rules)), insertions())


def parse(cells: list[Cell]) -> Cell:
    """The cell of a whole sequence of neighbouring spans, bottom-up by length."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[q] for q in ENDS if cell[q])


def decode(audit: str, initials: str, place: int) -> tuple[list[tuple[str, int, str | None]], int]:
    """Edits of a piece of an audit, ``(letter, turn in the piece or -1, new role or None)``, and the place reached."""
    out, at = [], 0
    for letter in audit:
        if letter in "IR":
            out.append((letter, -1 if letter == "I" else at, NEXT[place]))
            place = STEPS[place, NEXT[place][0]]
        else:
            out.append((letter, at, None))
            if letter == "K":
                place = STEPS[place, initials[at]]
        at += letter != "I"
    return out, place


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


_SEGMENTS = "pid int, k int, uids array<long>, initials string, faults string, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"


def _segments(ordered: DataFrame, kind: str, segment: int) -> DataFrame:
    """Per conversation and task (or ``segment`` turns of it) its turns, faults and parse cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        pid, k, key, uids, initials, faults, turns, done = TaskContext.get().partitionId(), 0, None, [], [], [], [], []

        def close() -> None:
            nonlocal k
            cell = parse([terminal(i, f) for i, f in zip(initials, faults, strict=True)])
            known = [t for t in turns if t is not None]
            row = (key, pid, k, list(uids), "".join(initials), "".join(faults), known[0] if known else None, known[-1] if known else None, len(set(known)))
            done.append((*row, [c[0] if c else None for c in cell], [c[1] if c else None for c in cell]))
            k += 1
            for held in (uids, initials, faults, turns):
                held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
            schema = schema or pa.schema(
                [("conv", batch.schema.field("conv").type), ("pid", pa.int32()), ("k", pa.int32()), ("uids", longs), ("initials", pa.string()), ("faults", pa.string())]
                + [("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("costs", longs), ("audits", texts)]
            )
            for conv, turn, uid, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "uid", "initial", "fault")), strict=True):
                if uids and (conv != key or len(uids) == segment):
                    close()
                key = conv
                for held, x in ((uids, uid), (initials, initial), (faults, fault), (turns, turn)):
                    held.append(x)
            if len(done) > 1000:
                yield flush()
        if uids:
            close()
        if done:
            yield flush()

    return ordered.mapInArrow(run, f"conv {kind}, {_SEGMENTS}")


_PIECES = "pid int, k int, piece string, place int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _decisions(segments: DataFrame, kind: str) -> DataFrame:
    """Per segment its piece of the audit and the place where it begins; the first of a conversation has the report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        rows: list[tuple] = []
        schema = None

        def close() -> None:
            cost, audit = best(parse([h["cell"] for h in held]))
            known = [h for h in held if h["turns"]]
            gaps = 0
            if known:
                distinct = sum(h["turns"] for h in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
                gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - distinct
            faults = [sum(h["faults"].count(f) for h in held) for f in (BLANK, DUPLICATE, CUT)]
            illegal = sum(_illegal(h["initials"]) for h in held) + sum(_illegal(a["initials"][-1] + b["initials"][0]) for a, b in zip(held, held[1:], strict=False))
            report: tuple = (gaps, *faults, illegal, cost, audit)
            at, place = 0, 0
            for h in held:
                end, left = at, len(h["initials"])
                while left:
                    left -= audit[end] != "I"
                    end += 1
                if h is held[-1]:
                    end = len(audit)
                rows.append((h["conv"], h["pid"], h["k"], audit[at:end], place, *report))
                _, place = decode(audit[at:end], h["initials"], place)
                at, report = end, (None,) * 7
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            schema = schema or pa.schema(
                [("conv", batch.schema.field("conv").type), ("pid", pa.int32()), ("k", pa.int32()), ("piece", pa.string()), ("place", pa.int32())]
                + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
            )
            for h in batch.to_pylist():
                h["cell"] = [None if c is None else (c, a) for c, a in zip(h.pop("costs"), h.pop("audits"), strict=True)]
                if held and held[0]["conv"] != h["conv"]:
                    close()
                held.append(h)
            if len(rows) > 1000:
                yield flush()
        if held:
            close()
        if rows:
            yield flush()

    narrow = segments.drop("uids").repartition("conv").sortWithinPartitions("conv", "pid", "k")
    return narrow.mapInArrow(run, f"conv {kind}, {_PIECES}")


def _edits(decided: DataFrame, kind: str) -> DataFrame:
    """Each edit in its place, with the number of its turn (null if inserted) and the new role (null if it stays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("uids", "initials", "piece", "place")]
            edits = [(n, i, letter, uids[at] if at >= 0 else None, role) for n, (uids, ini, piece, place) in enumerate(zip(*cols, strict=True)) for i, (letter, at, role) in enumerate(decode(piece, ini, place)[0])]
            if not edits:
                continue
            n, i, letter, uid, role = zip(*edits, strict=True)
            same = [batch.column(c).take(pa.array(n)) for c in ("conv", "pid", "k")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(i, pa.int32()), pa.array(letter), pa.array(uid, pa.int64()), pa.array(role, pa.string())], ["conv", "pid", "k", "i", "edit", "uid", "new_role"])

    return decided.mapInArrow(run, f"conv {kind}, pid int, k int, i int, edit string, uid long, new_role string")


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> Repair:
    """The repaired turns of every conversation and a report of its faults and edits."""
    folder = shared_folder(conversations.sparkSession)
    role, text = F.coalesce(role_col, F.lit(" ")), F.coalesce(text_col, F.lit(" "))
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    seen, initial = F.rtrim(F.col("text"), F.lit(BLANKS)), F.substring("role", 1, 1)
    own = F.when(seen == "", BLANK).when(F.substring(seen, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    marks = {"digest": digest, "uid": F.monotonically_increasing_id(), "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), "own": own}
    rows = stash(rows.withColumns(marks), folder, "turns")
    kind = dict(rows.dtypes)["conv"]
    firsts = rows.groupBy("conv", "digest").agg(F.min(F.struct("turn", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("first"))
    fault = F.when((F.col("own") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("own"))
    judged = rows.drop("text").join(firsts, "uid", "left").select("conv", "turn", "role", "digest", "uid", "initial", fault.alias("fault"))
    judged = stash(judged, folder, "judged")
    order = ["conv", "turn", "role", "digest", "uid"]
    segments = stash(_segments(judged.repartitionByRange(*order).sortWithinPartitions(*order), kind, segment), folder, "segments")
    pieces = stash(_decisions(segments, kind), folder, "pieces")
    edits = _edits(segments.select("pid", "k", "uids", "initials", "conv").join(pieces.select("pid", "k", "piece", "place"), ["pid", "k"]), kind)
    turns = edits.join(rows.select("uid", "turn", "role", "text"), "uid", "left")
    inserted = F.when(F.col("edit") == "I", F.lit(""))
    turns = turns.select(F.col("conv").alias(id_col), "pid", "k", "i", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce(inserted, "text").alias("text"))
    report = pieces.filter("audit IS NOT NULL").select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(turns, report)


def digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``<id_col>, sha256`` of the turns that stay, as ``role:text`` lines."""
    kind = dict(turns.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for batch in batches:
            convs, out = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        convs.append(key)
                        out.append(state.hexdigest())
                    state, key = hashlib.sha256(line.encode()), conv
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field(0).type), pa.array(out, pa.string())], [id_col, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type), pa.array([state.hexdigest()])], [id_col, "sha256"])

    lines = turns.filter("edit <> 'D'").select(id_col, "pid", "k", "i", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition(id_col).sortWithinPartitions(id_col, "pid", "k", "i").mapInArrow(run, f"{id_col} {kind}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Planted faults, chosen by a checksum of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = conversations.withColumn("kind", kind).filter("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns, report = repair(damage(conversations))
    hashed = digests(turns).select(F.col("conv_id").alias("hashed_id"), "sha256")
    known = report.withColumn("known_id", F.col("conv_id")).drop("conv_id")
    every = conversations.select("conv_id").distinct()
    out = every.join(known, F.col("conv_id").eqNullSafe(F.col("known_id")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


#: The same result by another way: the damage by a bitwise CRC, then a walk along each conversation with the best edits so far for each place.
OP11_SQL = """
WITH RECURSIVE crc(i, s, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, s + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc WHERE s < 8),
codes AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM crc WHERE s = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (SELECT keyed.*, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, b: xor(x // 256, t[CAST(xor(x, b) % 256 AS BIGINT) + 1])), 4294967295) % 20 AS kind FROM keyed, codes),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
  lag(substr(role, 1, 1)) OVER w AS before FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM numbered),
step(p, s, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, c, l, o) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'u'), (0, 3, 10, 'II', 'ua'), (1, 2, 5, 'I', 'u'), (1, 3, 10, 'II', 'ua'), (2, 3, 5, 'I', 'a'), (3, 2, 5, 'I', 'u')),
options AS (SELECT conv_id, n, p, q, CASE fault WHEN 3 THEN 5 ELSE 0 END AS c, 'K' AS l, [role || ':' || text] AS o FROM judged JOIN step ON s = substr(role, 1, 1) WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, n, p, q, 1 + CASE fault WHEN 3 THEN 5 ELSE 0 END, 'R', [CASE s WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] FROM judged JOIN step ON s <> 's' WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, n, p, p, 2, 'D', [] FROM judged, (VALUES (0), (1), (2), (3)) t(p)),
gaps(p, q, c, l, o) AS (SELECT p, q, c, l, CASE o WHEN '' THEN [] WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END FROM ins),
walk(conv_id, n, p, m) AS (SELECT conv_id, CAST(0 AS BIGINT), q, {'c': c, 'l': l, 'o': CAST(o AS VARCHAR[])} FROM (SELECT DISTINCT conv_id FROM judged), gaps WHERE p = 0
  UNION ALL SELECT w.conv_id, x.n, g.q, min({'c': w.m.c + x.c + g.c, 'l': w.m.l || x.l || g.l, 'o': CAST(list_concat(list_concat(w.m.o, x.o), g.o) AS VARCHAR[])})
  FROM walk w JOIN options x ON x.conv_id = w.conv_id AND x.n = w.n + 1 AND x.p = w.p JOIN gaps g ON g.p = x.q GROUP BY w.conv_id, x.n, g.q),
facts AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ends AS (SELECT w.conv_id, min(w.m) AS m FROM walk w JOIN facts f ON f.conv_id = w.conv_id AND f.n = w.n WHERE w.p IN (0, 3) GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.m.c, 0) AS BIGINT) AS cost, coalesce(e.m.l, '') AS audit, sha256(coalesce(array_to_string(e.m.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts f USING (conv_id) LEFT JOIN ends e USING (conv_id)"""
