from pyspark.sql import functions as F

import __spark_entry__ as entry
from changelens.operators.counters import mongo_rollup

M = 60_000_000


def test_a_rollup_reads_its_records_once(spark):
    """No join of the records with themselves; a minute in which a command only ran on has no counts, not zeros."""
    rows = [("p", "g", "a", 0, 2 * M + 5, 3), ("p", "g", "b", 10, 5, None), ("p", "g", "c", 3 * M, None, 4)]
    out = mongo_rollup(spark.createDataFrame(rows, "role string, group_id string, event_id string, start_us long, duration_us long, docs long"), ("docs",))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.bucket_us: (r.overlap_us, r["count"], r.docs, r.docs_known, r.max_us, r.sample, r.first_us, r.last_us) for r in out.collect()}
    nothing = (None,) * 7
    assert got == {0: (M + 5, 2, 3, 1, 2 * M + 5, "a", 0, 10), M: (M, *nothing), 2 * M: (5, *nothing), 3 * M: (0, 1, 4, 1, None, "c", 3 * M, 3 * M)}


def test_orders_of_commands_parse_the_records_once(spark):
    """Five orders of the same groups: the records are parsed for the rollup alone, not again for each order."""
    out = entry.queries()["command_orders"](spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.filter(F.col("asked") == "count").count() == 1
