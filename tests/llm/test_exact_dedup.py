import hashlib
import re
from collections import Counter

import pytest

from changelens.llm.exact_dedup import exact_classes, exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t, *_ in rows:
        best = min(groups[norm(t)], key=lambda x: x[:3])
        out.append((i, best[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("block", "bits"), [(2048, 64), (40, 4)])
def test_classes_match_brute_force(spark, make_docs, odd_rows, block, bits):
    """Small blocks give many levels; four-bit hashes make contents clash, which must not join them."""
    rows = [r for r in odd_rows if len(r[1] or "") < 1000] if block == 40 else odd_rows
    got = exact_classes(make_docs(rows), block_bytes=block, hash_bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
    for sha in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1


def test_unique_ids(make_docs):
    rows = [(k, "same text" if k % 3 else f"text {k}", "en", "a") for k in range(60)]
    got = exact_classes(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_one_of_a_pile_of_equal_rows_stays_without_gathering_them(spark, make_docs):
    """A third of all rows agree in id and text; others in id, length and normalised text, or have no id."""
    rows = [(5, "a b", "en", "a")] * 40 + [(5, "ab ", "en", "a"), (None, "a b", "en", "b"), (9, "a b c", None, None)] * 20 + [(k, f"t{k}", "en", "a") for k in range(10, 30)]
    got = exact_classes(make_docs(rows).repartition(7))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = got.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == 22
    assert next(r for r in kept if r.group_size == 80).doc_id == 5
    assert len({r.row_key for r in got if r.doc_id == 5}) == 2


def test_filter_keeps_columns_and_one_row_of_each_class(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t, *_ in odd_rows})


def test_empty_table(make_docs):
    assert exact_classes(make_docs([])).count() == 0
    assert exact_dedup(make_docs([])).count() == 0
