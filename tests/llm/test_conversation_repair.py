import hashlib
import itertools
import random
import re
import zlib

from changelens.llm import conversation_repair as op
from changelens.llm.conversation_repair import best, combine, damage, digests, parse, repair, terminal

SCHEMA = "conv_id long, turn long, role string, text string, uid long, digest string, kind int, pid int, conv string, copy int"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3, "c", 4) for r in rows], SCHEMA)


def brute(symbols):
    """Least (cost, audit) by trying edits and insertions in every order, walking along the turns."""
    cells = {0: (0, "")}

    def inserted(cells):
        out = dict(cells)
        for _ in range(4):
            for p, (c, a) in list(out.items()):
                for s in "ua":
                    q = op.STEPS.get((p, s))
                    if q is not None and (q not in out or (c + 5, a + "I") < out[q]):
                        out[q] = (c + 5, a + "I")
        return out

    cells = inserted(cells)
    for initial, fault in symbols:
        after = {}
        for p, (c, a) in cells.items():
            moves = [(p, 2, "D")]
            if fault in "03":
                extra = 5 if fault == "3" else 0
                moves += [(op.STEPS[p, initial], extra, "K")] if (p, initial) in op.STEPS else []
                moves += [(op.STEPS[p, s], 1 + extra, "R") for s in "ua" if (p, s) in op.STEPS]
            for q, d, x in moves:
                if q not in after or (c + d, a + x) < after[q]:
                    after[q] = (c + d, a + x)
        cells = inserted(after)
    return min(cells[q] for q in (0, 3) if q in cells)


def test_any_split_of_a_span_gives_the_same_cell():
    rng = random.Random(5)
    for _ in range(40):
        symbols = [(rng.choice("suax"), rng.choice("0001233")) for _ in range(rng.randint(2, 9))]
        cells = [terminal(*s) for s in symbols]
        whole = parse(cells)
        assert best(whole) == brute(symbols)
        table = {(i, i + 1): c for i, c in enumerate(cells)}
        for n in range(2, len(cells) + 1):
            for i in range(len(cells) - n + 1):
                splits = [combine(table[i, m], table[m, i + n]) for m in range(i + 1, i + n)]
                assert all(s == splits[0] for s in splits)
                table[i, i + n] = splits[0]
        assert table[0, len(cells)] == whole


def test_all_short_sequences():
    for n in (1, 2, 3):
        for symbols in itertools.product(itertools.product("suax", "013"), repeat=n):
            assert best(parse([terminal(*s) for s in symbols])) == brute(symbols)


def expected(rows):
    """Reports and repaired digests of damaged rows, one conversation at a time."""
    out = {}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    for conv, turns in by.items():
        turns.sort(key=order)
        seen, symbols = set(), []
        for _, role, text in turns:
            seen_text = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "1" if not seen_text else "2" if (role, text) in seen else "3" if seen_text[-1] not in ".!?" else "0"
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, audit = brute(symbols)
        place, at, lines = 0, 0, []
        for x in audit:
            role = op.NEXT[place]
            if x == "K":
                place = op.STEPS[place, symbols[at][0]]
                lines.append(f"{turns[at][1]}:{turns[at][2]}")
            elif x in "RI":
                place = op.STEPS[place, role[0]]
                lines.append(f"{role}:{turns[at][2] if x == 'R' else ''}")
            at += x != "I"
        assert place in (0, 3)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [sum(f == x for _, f in symbols) for x in "123"]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(rows, segment=op.SEGMENT):
    turns, report = repair(rows, segment=segment)
    digest = {r.conv_id: r.sha256 for r in digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, empty)) for r in report.collect()}


def _random(seed, n, convs):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no end", "", " \t", "Why?  ", "a.b", "x" * 3000 + "."]
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice([*texts, None])) for _ in range(n)]


def test_odd_rows_in_one_and_many_segments(spark):
    rows = _random(3, 120, [1, 2, 3, 4, None]) + [(9, None, "user", "")] + [(10, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(60)]
    rows += [(11, 5, "user", "same.")] * 7
    want = expected(rows)
    for segment in (op.SEGMENT, 3):
        assert got(make(spark, rows), segment) == want


def test_empty_table(spark):
    turns, report = repair(make(spark, []))
    assert turns.count() == report.count() == digests(turns).count() == 0


def test_query_with_damage(spark, tmp_path):
    """The whole query against the rules row by row; a conversation that loses every turn stays with zeros."""
    rng = random.Random(8)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["One.", "Two!", "three", None])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "x."), (None, None, None, None), *[(c, 0, "user", "a.") for c in range(60, 120)]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    hurt = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        hurt += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = expected(hurt)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r.conv_id: tuple(r)[1:] for r in op.op11_interval_repair(spark, str(tmp_path)).collect()}
    assert any(c not in want for c, *_ in rows)
    assert found == {c: want.get(c, none) for c, *_ in rows}
    assert damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
