import math
import random
import zlib
from collections import Counter

import numpy as np

from changelens.llm import toxicity
from changelens.llm.toxicity import CATEGORIES, Lookup, _sample, drop_toxic, features, fit_logistic, score, train


def corpus(make_docs, spark, n=400):
    rng = random.Random(5)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        toxic, low = k % 5 == 0, k % 7 == 0
        own = [rng.choice(vocabulary) for _ in range(60)]
        if toxic:
            own += [rng.choice(["nastyword", "badlingo", "badlist"]) for _ in range(2)]
        if low:
            own += ["%%%", "junk***"] * 3
        rng.shuffle(own)
        rows.append((k, " ".join(own), "en", "a"))
        if k % 2 == 0 or k > n * 3 // 4:
            labels.append((k, 0 if low else 1, 1 if toxic else 0, "x"))
    return rows, make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_filter(make_docs, spark):
    rows, docs, labels = corpus(make_docs, spark)
    chain = train(docs, labels.filter("doc_id < 300"))
    got = {r.doc_id: r for r in score(docs, chain).collect()}
    assert all(got[k].toxic == (k % 5 == 0) for k in range(300, 400))
    assert np.mean([(got[k].p_low_quality > 0.5) == (k % 7 == 0) for k in range(300, 400)]) > 0.95
    kept = drop_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(400) if k % 5]
    for _, t, *_ in rows[:50]:
        own = Lookup(chain)
        wanted = set().union(*[link.weights.keys() for link in chain])
        assert own.present(t) == features(t) & wanted
    again = train(docs.repartition(7), labels.filter("doc_id < 300").repartition(3))
    assert [link.weights.keys() for link in again] == [link.weights.keys() for link in chain]


def test_odd_rows_and_labels(make_docs, spark, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, 1), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.filter("doc_id = 1")):
        chain = train(docs, lab)
        got = score(docs, chain).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.p_toxic <= 1 for r in got)
    assert not any(r.toxic for r in score(docs, train(docs, labels.limit(0))).collect())
    assert score(make_docs([]), train(make_docs([]), labels)).count() == 0


def test_logistic_regression_separates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (200, 3)).astype(float)
    w, b = fit_logistic(x, x[:, 1])
    assert ((x @ w + b > 0) == (x[:, 1] > 0)).all()


def test_repeated_ids_stay_within_the_sample(make_docs, spark):
    docs = make_docs([(k % 4 if k < 8 else 1, f"text {k}", "en", "a") for k in range(60)] + [(None, "null", "en", "a"), (2, None, "en", "a")])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    first, again = (sorted((tuple(r) for r in _sample(d, labels, CATEGORIES, 10, 1)[0].collect()), key=str) for d in (docs, docs.repartition(5)))
    assert [r[0] for r in first] == [0, 1, 2, 3] and first == again


def test_features_are_chosen_on_the_other_folds(make_docs, spark):
    """The chosen features of each fold against G statistics counted by hand over the rows of the other folds."""
    rows, docs, labels = corpus(make_docs, spark)
    want = {r.doc_id: (1 - r.quality, r.toxic) for r in labels.collect()}
    labels = labels.union(spark.createDataFrame([(k, None, k % 2, "x") for k in range(1, 60, 2)], labels.schema))
    want |= {k: (None, k % 2) for k in range(1, 60, 2)}
    text, _ = _sample(docs, labels, CATEGORIES, 4000, 1)
    counts = toxicity._feature_counts(text, 2)
    sizes = text.selectExpr(*[f"count(CASE WHEN fold = {f} THEN y{k} END) AS n{k}_{f}" for k in (0, 1) for f in range(5)], *[f"sum(CASE WHEN fold = {f} THEN y{k} END) AS ones{k}_{f}" for k in (0, 1) for f in range(5)]).first().asDict()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    for k in (0, 1):
        for out in (None, 0, 3):
            own = [(features(t), want[i][k]) for i, t, *_ in rows if i in want and want[i][k] is not None and fold(i) != out]
            n, ones, total = Counter(f for x, _ in own for f in x), Counter(f for x, y in own if y for f in x), sum(y for _, y in own)
            cells = lambda f: [(ones[f], total * n[f]), (n[f] - ones[f], (len(own) - total) * n[f]), (total - ones[f], total * (len(own) - n[f])), (len(own) - total - n[f] + ones[f], (len(own) - total) * (len(own) - n[f]))]  # noqa: E731, B023
            g = {f: 2 * sum(a * math.log(a * len(own) / e) for a, e in cells(f) if a) for f in n if n[f] >= 5}
            assert set(toxicity._telling(counts, sizes, k, out)) == {f for f in g if g[f] > toxicity.MIN_G}


def test_chain_feeds_probabilities_forward():
    first = toxicity.Link({b"=a": 2.0}, [], -1.0)
    second = toxicity.Link({b"=b": 1.0}, [3.0], -2.0)
    p = 1 / (1 + math.exp(-1.0))
    assert toxicity.scores([first, second], {b"=a", b"=b"}) == [p, 1 / (1 + math.exp(-(3 * p - 1)))]
