import math
import re
import statistics
import zlib
from collections import Counter, defaultdict

import pytest

from changelens.llm.common import shared_folder
from changelens.llm.katz import SLIVER, K, discounts, katz_scores, stored_model


def brute(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    uni = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    pairs = Counter(p for t, h in zip(tokens, held, strict=True) if not h for p in zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    counts = lambda c: [sum(1 for x in c.values() if x == k) for k in range(1, K + 2)]
    d1, d2 = discounts(counts(uni)), discounts(counts(pairs))
    cut = lambda d, c: d[c] * c if c <= K else c - SLIVER
    unknown = 1 - sum(cut(d1, c) for c in uni.values()) / n if n else 1.0
    p1 = lambda w: cut(d1, uni[w]) / n if uni[w] else unknown
    after = defaultdict(list)
    for (a, w), c in pairs.items():
        after[a].append((w, c))
    total = {a: sum(c for _, c in x) for a, x in after.items()}
    alpha = {a: (1 - sum(cut(d2, c) for _, c in x) / total[a]) / (1 - sum(p1(w) for w, _ in x)) for a, x in after.items()}
    for a, x in after.items():  # the model is a distribution
        mass = sum(cut(d2, c) / total[a] for _, c in x) + alpha[a] * (sum(p1(w) for w in uni if not pairs[a, w]) + unknown)
        assert mass == pytest.approx(1)
    out = []
    for (i, *_), t, h in zip(rows, tokens, held, strict=True):
        score = sum(math.log10(cut(d2, pairs[a, w]) / total[a] if pairs[a, w] else alpha.get(a, 1.0) * p1(w)) for a, w in zip(["<s>", *t[:-1]], t, strict=True))
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), score))
    return out, uni, pairs


@pytest.mark.parametrize("small", [False, True])
def test_scores_match_brute_force(spark, make_docs, odd_rows, small):
    """With tiny chunks and buckets every word is hot and every pair is split over blocks."""
    rows = [*odd_rows, *[(k, f"the cat {k % 5} sat on the mat {k % 11} the end", "en", "a") for k in range(20, 60)]]
    if small:
        rows = [r for r in rows if len(r[1] or "") < 5000]
    want, uni, pairs = brute(rows)
    folder = shared_folder(spark)
    got = katz_scores(make_docs(rows), keep_pairs=True, folder=folder, **({"chunk_tokens": 50, "bucket_tokens": 60} if small else {})).collect()
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    model = stored_model(spark, folder)
    assert Counter(r.c for r in model["pairs"].collect()) == Counter(pairs.values())
    assert Counter(r.c for r in model["unigrams"].collect() if r.c) == Counter(uni.values())


def test_empty_and_unlearned(make_docs):
    assert katz_scores(make_docs([])).count() == 0
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = katz_scores(make_docs([(k, "a b", "en", "a") for k in held])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 3


def test_discounts_stay_between_zero_and_one():
    for counts in ([100, 50, 30, 20, 15, 10], [0, 0, 0, 0, 0, 0], [5, 0, 1, 0, 0, 0], [10, 10, 10, 10, 10, 10]):
        d = discounts(counts)[1:]
        assert (d > 0).all() and (d <= 1).all()


def simple_good_turing(counts, k=K):
    """By the book, apart from the code under test: Z, the line, r*, Katz's factors."""
    r = [c for c in range(1, k + 2) if counts[c - 1]]
    z = []
    for j, c in enumerate(r):
        q = r[j - 1] if j else 0
        t = r[j + 1] if j + 1 < len(r) else 2 * c - q
        z.append(counts[c - 1] / (0.5 * (t - q)))
    line = statistics.linear_regression([math.log(c) for c in r], [math.log(y) for y in z])
    s = lambda c: math.exp(line.intercept + line.slope * math.log(c))
    tail = (k + 1) * s(k + 1) / s(1)
    return [1.0, *[((c + 1) * s(c + 1) / s(c) / c - tail) / (1 - tail) for c in range(1, k + 1)]]


@pytest.mark.parametrize("counts", [
    [49663, 12919, 5197, 2729, 2383, 1067], [193655, 25105, 6496, 2179, 2497, 618],  # words and pairs of sf0.01
    [207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580],  # of sf0.1
    [45315, 4880, 1537, 331, 336, 86], [684867, 182229, 76869, 44215, 34199, 23469], [900, 200, 0, 40, 60, 10], [0, 200, 80, 40, 60, 10],
])
def test_copies_do_not_displace_good_turing(counts):
    """n4 < n5 and the like, where an unsmoothed factor leaves (0, 1)."""
    d = discounts(counts)
    assert list(d) == pytest.approx(simple_good_turing(counts))
    assert (d[1:] > 0).all() and (d[1:] < 1).all() and (d[2:] > d[1:-1]).all()


def test_scores_of_a_copy_heavy_corpus(make_docs, monkeypatch):
    """More words and pairs occur five times than four; the expected scores use this file's own factors."""
    shape = [(1, 60), (2, 20), (3, 9), (4, 3), (5, 8), (6, 2)]
    texts = [f"w{times}x{j} v{times}x{j}" for times, many in shape for j in range(many) for _ in range(times)]
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 != 2]
    rows = [(k, t, "en", "a") for k, t in zip(learned, texts, strict=False)] + [(k, "w1x0 v5x1 new w4x0 v4x0", "en", "a") for k in range(400, 430) if zlib.crc32(str(k).encode()) % 7 == 2]
    monkeypatch.setitem(globals(), "discounts", simple_good_turing)
    want, uni, pairs = brute(rows)
    for c in (uni, pairs):
        assert sum(n == 4 for n in c.values()) < sum(n == 5 for n in c.values())
    got = {r.doc_id: r.score for r in katz_scores(make_docs(rows)).collect()}
    assert got == pytest.approx({w[0]: w[6] for w in want}, rel=1e-9)
