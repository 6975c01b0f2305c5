from tessera.llm.exact_dedup import exact_dedup


def _run(spark, rows, schema="doc_id long, text string, keep_id int, n int"):
    return exact_dedup(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()


def test_longest_then_smallest_id_stays(spark):
    got = _run(spark, [(1, "a b", 0, 0), (2, "a  b", 0, 0), (3, "\ta b ", 0, 0), (4, "a\x0cb ", 0, 0), (5, "ab\xa0", 0, 0)])
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [
        (1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (4, 3, 4, False), (5, 5, 1, True)
    ]


def test_null_empty_and_blank_texts_are_one_group(spark):
    got = _run(spark, [(9, None, None, None), (-(2**63), "", 0, 0), (7, " \n", 0, 0)])
    assert {(r.keep_id, r.group_size) for r in got} == {(7, 3)}
    assert [r.kept for r in got] == [False, True, False]


def test_repeated_rows_long_text_and_empty_table(spark):
    got = _run(spark, [(1, "x" * 300_000, 0, 0)] * 2 + [(2, "x" * 300_001, 0, 0), (None, "q", 0, 0)])
    assert [(r.doc_id, r.group_size, r.kept) for r in got] == [(None, 1, True), (1, 2, True), (1, 2, True), (2, 1, True)]
    assert _run(spark, []) == []


def test_colliding_hashes_change_nothing(spark, sf_dir, monkeypatch):
    from tessera.llm import exact_dedup as module

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 300")
    want = sorted(map(tuple, exact_dedup(docs).collect()))
    monkeypatch.setattr(module.F, "md5", lambda column: module.F.lit("00" * 16))
    assert sorted(map(tuple, exact_dedup(docs).collect())) == want
