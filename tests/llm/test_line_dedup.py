from collections import Counter, defaultdict

import pytest

from changelens.llm.line_dedup import remove_shared_lines

TRIM = " \t\r\x0b\x0c"


def expected(rows, limit):
    sites = defaultdict(set)
    for _, t, _, site in rows:
        for line in [] if t is None else t.split("\n"):
            if line.strip(TRIM) and site is not None:
                sites[line.strip(TRIM)].add(site)
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        gone = [len(sites[x.strip(TRIM)]) >= limit and x.strip(TRIM) != "" for x in lines]
        out.append((i, sum(1 for x in lines if x.strip(TRIM)), sum(gone), None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("limit", [3, 6])
def test_matches_brute_force(make_docs, odd_rows, limit):
    """Lines below, at, just above and far above the limit, in the exact band and beyond it."""
    rows = list(odd_rows)
    for k, spread in enumerate((limit - 1, limit, limit + 1, 3 * limit)):
        rows += [(100 * k + s, f" line {k}\t\n\nown {k} {s}\nline {k}", "en", f"s{s}") for s in range(spread)]
    got = remove_shared_lines(make_docs(rows), min_sites=limit)
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == expected(rows, limit)


def test_empty_table(make_docs):
    assert remove_shared_lines(make_docs([])).count() == 0
