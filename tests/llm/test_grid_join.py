import math

import numpy as np
import pytest

from changelens.llm.grid_join import linked_vectors, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, row_id string, key string, n long, node int, dim int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", "k", 2, 3, 4) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if o else None for o, (_, v) in zip(ok, rows, strict=True)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((str(name), len(near[i]), str(least), name == least))
    return sorted(out)


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def planted(seed, dim=24):
    """Lone vectors, exact copies, chains whose ends are far apart, a tight group and a loose one."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(120)]
    rows += [rows[0] * s for s in (1, 2, 0.5, 1)]
    x = rng.normal(size=dim)
    for _ in range(25):
        x = x + 0.25 * rng.normal(size=dim)
        rows.append(x.copy())
    for spread in (1e-3, 0.17):
        c = rng.normal(size=dim)
        rows += [c + spread * rng.normal(size=dim) for _ in range(60)]
    order = rng.permutation(len(rows))
    return [(int(n), rows[i].tolist()) for n, i in enumerate(order)]


@pytest.mark.parametrize(("block", "fan"), [(8192, 8), (7, 2), (16, 3)])
def test_against_all_pairs(spark, block, fan):
    """Small blocks force the recursion over intervals, and pairs of intervals that are linked as a whole."""
    rows = planted(block)
    assert got(linked_vectors(make(spark, rows), block=block, fan=fan)) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=6).tolist()
    rows = [(1, v), (1, v), (2, None), (3, []), (4, [0.0] * 6), (5, [None] * 6), (6, [math.nan, *v[1:]]), (7, [math.inf, *v[1:]]), (None, [-x for x in v]), (8, v[:5]), (9, v[:5])]
    rows += [(10, [1e200 * x for x in v]), (11, [1e-200 * x for x in v]), (12, [1.0]), (13, [2.0]), (14, [-1.0]), (None, None)]
    assert got(linked_vectors(make(spark, rows), block=4, fan=2)) == brute(rows)


def test_none_and_empty(spark):
    assert linked_vectors(make(spark, [])).count() == 0
    assert got(linked_vectors(make(spark, [(1, None), (2, [0.0])]))) == [("1", 0, "1", True), ("2", 0, "2", True)]


def test_other_thresholds_and_filter(spark):
    rows = planted(9, 8)
    for threshold in (0.8, 0.999):
        assert got(linked_vectors(make(spark, rows), threshold=threshold, block=32, fan=2)) == brute(rows, threshold)
    assert {r.vec_id for r in near_vectors(make(spark, rows)).collect()} == {int(i) for i, _, _, kept in brute(rows) if kept}
    with pytest.raises(ValueError, match="threshold"):
        linked_vectors(make(spark, rows), threshold=0)
