import numpy as np
from pyspark.sql import functions as F

from changelens.functions.windows import split_windows
from changelens.operators.lag import held_statements


def test_windows_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, q = rng.integers(1, 40), rng.integers(1, 15)
        at, value, low, bound = rng.integers(0, 20, n), rng.integers(0, 20, n), rng.integers(-2, 22, q), rng.integers(-2, 24, q)
        high = low + rng.integers(0, 12, q)
        counts, first = split_windows(at, value, low, high, bound, 3)
        for w in range(q):
            for side in (0, 1):
                want = [x for x in range(n) if low[w] <= at[x] <= high[w] and (value[x] >= bound[w]) == side]
                assert counts[w, side] == len(want)
                assert list(first[w, side]) == (want + [n] * 3)[:3]


def test_held_statements_make_no_pairs(spark):
    """Two thousand stalls, some of one time and one without origin, over two thousand statements of one node: no join of the two."""
    rng = np.random.default_rng(2)
    s = [("i", "n", int(a), int(d), f"e{k:04}") for k, (a, d) in enumerate(zip(rng.integers(0, 900, 2000), rng.integers(50, 400, 2000), strict=True))]
    e = [("i", "n", "stall", None if k == 7 else int(r) - 150 - k % 3, int(r)) for k, r in enumerate(rng.integers(0, 1200, 2000))]
    events = spark.createDataFrame(s, "instance_id string, node_id string, start_us long, duration_us long, event_id string")
    episodes = spark.createDataFrame(e, "instance_id string, node_id string, kind string, origin_us long, release_us long")
    out = held_statements(events, episodes, 60, 90, 3)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    events.createOrReplaceTempView("held_s")
    episodes.createOrReplaceTempView("held_e")
    want = spark.sql("""SELECT origin_us, role, count(*) AS n, slice(array_sort(collect_list(struct(-duration_us AS d, event_id))), 1, 3).event_id AS ids
      FROM (SELECT *, CASE WHEN start_us >= origin_us - 90 THEN 'queued' ELSE 'possible_holder' END AS role FROM held_s JOIN held_e USING (instance_id, node_id) WHERE duration_us >= 60 AND abs(start_us + duration_us - release_us) <= 90) GROUP BY 1, 2""")
    order = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert order(out.select("origin_us", "role", "statements", F.transform("samples", lambda x: x["event_id"])).collect()) == order(want.collect())
