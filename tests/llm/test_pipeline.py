import corpus_pipeline
from changelens.llm.exact_dedup import normalised
from changelens.llm.simhash import fingerprint


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns, name
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert len(ids) == len(rows) <= before and ids <= {r.doc_id for r in docs.collect()}
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
        before = len(rows)
    assert sizes[-1] < 200
    assert docs.select(normalised()).distinct().count() == sizes[-1]
    assert len({fingerprint(r.text) for r in docs.collect()}) == sizes[-1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, d).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)


def _tables(spark, folder, docs, benchmark, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_and_repeated_rows_and_clashing_columns(spark, make_docs, odd_rows, tmp_path):
    """Nulls in any column, blanks, ties, repeats: each stage keeps the columns and one row of each normalised text."""
    passage = " ".join(f"bench{k}" for k in range(20))
    rows = [*odd_rows, *odd_rows, (50, passage + " and more", "en", "a"), (51, "unlike all others here", None, None)]
    d = _tables(spark, tmp_path, make_docs(rows), [(1, passage), (None, None), (2, "")], [(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, None), (4, 1, 0), (5, 1, 0)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        got = out.collect()
        kept.append(got)
        docs = spark.createDataFrame(got, docs.schema)
    plain = lambda rows: {"".join((r.text or "").split(" ")).replace("\n", "").replace("\t", "").replace("\x0b", "").replace("\x0c", "").replace("\r", "") for r in rows}
    assert len(kept[1]) == len(plain(kept[0])) == len(plain(kept[1]))
    assert {r.doc_id for r in kept[2]} - {r.doc_id for r in kept[3]} == {50}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in packed}) == len(packed) >= len(kept[3])
    again = corpus_pipeline.run(spark, d).collect()
    key = lambda rows: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(again) == key(packed)


def test_empty_tables(spark, make_docs, tmp_path):
    d = _tables(spark, tmp_path, make_docs([]), [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
