import zlib
from collections import Counter

import pytest

from changelens.llm import sharding
from changelens.llm.sharding import op7_two_pass_shuffle, shard_records, write_shards


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < shards
        assert r.grown_shard in (r.shard, shards)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    ids = {}
    for r in got:
        assert ids.setdefault(r.doc_id, r.shard) == r.shard


def test_law_and_slots(make_docs, odd_rows):
    rows = [*odd_rows, *[(k, f"text {k % 3}", "en", "a") for k in range(100, 400)]]
    for size in (1 << 24, 100_000):  # one bucket to a shard, and several
        check(rows, shard_records(make_docs(rows), bucket_bytes=size).collect(), 40)
    again = [shard_records(make_docs(rows), bucket_bytes=100_000) for _ in range(2)]
    a, b = ([(r.doc_id, r.shard, r.slot) for r in x.orderBy("shard", "slot").collect()] for x in again)
    assert a == b
    order = [i for i, s, _ in a if s == a[0][1] and i is not None]
    assert order != sorted(order)


def test_growth_matches_the_larger_count(make_docs):
    docs = make_docs([(k, "t", "en", "a") for k in range(500)])
    grown = {r.doc_id: r.grown_shard for r in shard_records(docs, shards=9).collect()}
    larger = {r.doc_id: r.shard for r in shard_records(docs, shards=10).collect()}
    assert grown == larger and 20 < sum(s == 9 for s in larger.values()) < 90


def test_whole_records_are_written(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, *_ in odd_rows)
    assert shard_records(make_docs([])).count() == 0


def test_added_names_give_way(spark, make_docs, tmp_path):
    docs = make_docs([(k, f"t{k}", "en", "a") for k in range(20)]).selectExpr("*", "'mine' AS _shard", "7 AS _Slot")
    write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "__shard", "__slot"}
    assert {(r["_shard"], r["_Slot"]) for r in back.collect()} == {("mine", 7)} and back.count() == 20


@pytest.mark.parametrize("unique", [True, False])
def test_slots_follow_from_seed_and_data_alone(spark, make_docs, odd_rows, monkeypatch, unique):
    """Other partition counts and another order of the input change nothing; a pile of equal records is spread."""
    monkeypatch.setattr(sharding, "PILE", 20)
    rows = [(k, f"text {k % 3}", "en", "a") for k in range(400)]
    if not unique:
        rows += [*odd_rows, *[(9, "same " * 50, "en", "b")] * 300]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n, docs in ((4, make_docs(rows)), (11, make_docs(rows[::-1]).repartition(7))):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = shard_records(docs, bucket_bytes=3000).collect()
            check(rows, got, 40)
            found.append(Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_query_redigests_the_records(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    check(odd_rows, op7_two_pass_shuffle(spark, str(tmp_path)).collect(), 40)
