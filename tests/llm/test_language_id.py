import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import language_id
from changelens.llm.language_id import codebook, has_letter, held_out, identify, op6_language_codes, train


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = codebook(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * 99
        assert apart.min() >= (2 ** (n - 2) if n <= 5 else 3)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = op6_language_codes(spark, d).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(out) > 30
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = identify(docs, train(docs.filter(~held_out()))).collect()
    assert len(out) == len(odd_rows)
    letters = sorted(has_letter(t) for _, t, *_ in odd_rows)
    assert sorted(r.lang_pred != "und" for r in out) == letters
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    assert {r.lang_pred for r in out} <= {"en", "fr", "und"}


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_none_or_one_language(make_docs, langs):
    docs = make_docs([(k, "some text", x, "a") for k, x in enumerate(langs or [None])])
    out = identify(docs, train(docs)).collect()
    assert [r.lang_pred for r in out] == (langs or ["und"])
    assert identify(docs.limit(0), train(docs)).count() == 0


def test_only_text_is_read(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    model = train(docs)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    pick = lambda df: sorted((str(r.doc_id), r.lang_pred, r.score) for r in identify(df, model).collect())
    assert pick(docs) == pick(other)


def test_repeated_ids_stay_within_the_sample(make_docs, monkeypatch):
    """Ids that repeat or are null, with different texts, and one row in a thousand copies."""
    sizes = []
    monkeypatch.setattr(language_id, "Model", lambda languages, x, y, *a: sizes.append((len(languages), len(x), len({r.tobytes() for r in x}))))
    names = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(200)]
    rows = [(i, f"{lang} {name} text", lang, "a") for lang in ("en", "fr") for k, name in enumerate(names) for i in (7 if k % 2 else None,)]
    train(make_docs([*rows, *[(7, "one text", "en", "a")] * 1000]), per_language=20)
    assert sizes == [(2, 40, 40)]


def by_hand(model, text, buckets=2048):
    """Languages by n-grams counted one by one and losses summed one by one; None for texts without a letter."""
    if text is None or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    clean = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
    data = b" " + b" ".join(clean.split()) + b" "
    counts = [0] * buckets
    for n, base, factor in ((1, 0, 2654435761), (2, 1 << 24, 2246822519), (3, 1 << 28, 3266489917)):
        for at in range(len(data) - n + 1):
            gram = int.from_bytes(data[at : at + n], "big") + base
            counts[(gram * factor % 2**32) >> 21] += 1
    norm = math.sqrt(sum(counts))
    x = [math.sqrt(c) / norm for c in counts]
    margins = [sum(a * float(w) for a, w in zip(x, model.w[:, b], strict=True) if a) + float(model.b[b]) for b in range(model.code.shape[1])]
    losses = [sum(float(model.weight[k, b]) * math.log1p(math.exp(-m * int(model.code[k, b]))) for b, m in enumerate(margins)) for k in range(len(model.languages))]
    best = min(range(len(losses)), key=lambda k: (losses[k], k))
    likely = [math.exp(-(v - min(losses)) * model.code.shape[1]) for v in losses]
    return model.languages[best], likely[best] / sum(likely)


def test_predictions_match_decoding_by_hand(spark, make_docs, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs.filter(~held_out()), per_language=20)
    sample = [(r.doc_id, r.text, None, None) for r in docs.orderBy("doc_id").limit(25).collect()] + odd_rows
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in identify(make_docs(sample), model).collect())
    want = sorted((str(i), lang, round(score, 4)) for (i, t, *_) in sample for lang, score in [by_hand(model, t)])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-3 for g, w in zip(got, want, strict=True))


def test_more_values_than_may_be_learned(spark):
    """The most frequent labels are learned; rows of the others are identified as one of these."""
    rows = [(k, f"wort schule straße {k}", "de") for k in range(8)] + [(100 + k, f"house school street {k}", "en") for k in range(9)] + [(200 + k, f"dirty {k}", f"x{k}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, max_languages=2)
    assert model.languages == ["de", "en"]
    assert {r.lang_pred for r in identify(docs, model).collect()} <= {"de", "en"}
    assert len(train(docs).languages) == 512
