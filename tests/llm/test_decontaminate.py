import hashlib
import random
import re

import numpy as np

from changelens.llm.decontaminate import TestSet, contamination, decontaminate, scan_shard, suffix_array, words


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, width=13):
    w, hit, found = split(text), set(), set()
    for k, (_, t) in enumerate(items):
        own = split(t)
        if not own:
            continue
        n = min(width, len(own))
        windows = {tuple(own[a : a + n]) for a in range(len(own) - n + 1)}
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in windows:
                found.add(k)
                hit.update(range(p, p + n))
    return len(w), len(hit), sorted(found)


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    for _ in range(50):
        flat = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 60))], np.int32)

        def suffix(i):
            out = []
            while i < len(flat) and flat[i]:
                out.append(int(flat[i]))
                i += 1
            return out

        order = [suffix(i) for i in suffix_array(flat)]
        assert order == sorted(order) and len(order) == np.count_nonzero(flat)


def _random_case(rng):
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 4, 30]))]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 14, 30])))) for k in range(rng.randint(0, 6))]
    docs = []
    for _ in range(rng.randint(1, 6)):
        t = [rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(0, 60))]
        if items and rng.random() < 0.6:
            t += [*rng.choice(items)[1].split(), "q", *[rng.choice(vocabulary) for _ in range(5)]]
        docs.append(" ".join(t))
    return docs, items


def test_shards_match_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        docs, items = _random_case(rng)
        width = rng.choice([2, 3, 13])
        test = TestSet(items, width)
        for d, (spans, found, _, longest) in zip(docs, scan_shard([words(d) for d in docs], test), strict=True):
            assert (len(words(d)), sum(int(b - a) for a, b in spans), found) == brute(d, items, width)
            own = [split(t) for _, t in items]
            inside = lambda x: any(w[q : q + len(x)] == x for w in own for q in range(len(w) - len(x) + 1))
            w = split(d)
            best = max((b - a for a in range(len(w)) for b in range(a + 1, len(w) + 1) if b - a <= 40 and inside(w[a:b])), default=0)
            if longest >= width:
                assert longest == best or best == 40


def _expected(rows, items):
    out = []
    for i, t, *_ in rows:
        n, hit, found = brute(t, items)
        ids = ",".join(sorted({str(items[k][0]) for k in found}))
        out.append((i, n, hit, len(found), hashlib.sha256(ids.encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    return out


def test_contamination_with_odd_rows_and_blocks(spark, make_docs, odd_rows):
    passage = " ".join(f"bench{k}" for k in range(30))
    rows = [*odd_rows, (20, "start " + passage + " end", "en", "a"), (21, "filler " * 2000 + " ".join(passage.split()[:14]), "en", "a"), (22, "Tiny Item!", "en", "b"), (20, "start " + passage + " end", "en", "a")]
    items = [(1, passage), (2, "tiny item"), (3, None), (4, ""), (5, passage + " and more words"), (6, odd_rows[0][1])]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    want = sorted(_expected(rows, items), key=repr)
    for block_bytes, shard in ((1 << 24, 1_000_000), (200, 50)):
        got = contamination(make_docs(rows), bench, block_bytes=block_bytes, shard_words=shard)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=repr) == want
        docs = make_docs(rows)
        kept = decontaminate(docs, bench, block_bytes=block_bytes, shard_words=shard)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)


def test_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(make_docs([]), none).count() == 0
    assert not contamination(make_docs(odd_rows), none).filter("contaminated OR n_hit > 0").count()
    assert decontaminate(make_docs(odd_rows), none).count() == len(odd_rows)
