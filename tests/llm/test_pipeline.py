"""The pipeline's stages on a small table: each one's decision takes effect, clean documents stay."""

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages(spark, tmp_path):
    from logtrail.llm import decontaminate, toxicity
    from logtrail.llm.common import table

    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert kept[0] >= kept[1] >= kept[2] > kept[3] >= kept[4] > 100
    last = spark.read.parquet(f"{tmp_path}/3")
    assert decontaminate.judged(decontaminate.scan(last, table(spark, DATA, "benchmark"))).filter("contaminated").count() == 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in last.select("doc_id").collect()}
    toxic = table(spark, DATA, "labels").filter("toxic = 1").count()
    assert kept[0] - kept[1] <= 2 * toxic and toxicity.FIT_ROWS == 20_000


def test_near_copies_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (None, c), (None, c + " more"), (None, "lone text of no id"), (6, None), (None, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    whichever = [x for x in got if x in rows[3:5]]
    assert len(whichever) == 1 and sorted(map(str, (x for x in got if x not in whichever))) == sorted(map(str, [rows[0], rows[2], rows[5], rows[6]]))


def test_lines_beside_columns_of_other_names(spark):
    lines = "one two\nthree four\nfive six"
    rows = [(1, lines + "\nown words", 99, 7, 45, "x"), (2, lines + "\nmore of it", 99, 8, 44, "y"), (3, None, None, 9, 0, "z"), (4, lines, 1, 2, 27, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, n_lines int, n_chars long, _rest string")
    out = corpus_pipeline.dedup_lines(spark, docs, "")
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = sorted(map(tuple, out.collect()))
    assert got == [rows[0], (2, "more of it", 99, 8, 10, "y"), rows[2]]
    assert corpus_pipeline.dedup_lines(spark, docs.filter("doc_id > 9"), "").count() == 0


def test_stages_on_odd_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, None), (None, ""), (2, "some words here"), (2, "some words here")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("own") for c in ("_row", "doc", "score", "n_words", "item_id", "class_id")})
    items = spark.createDataFrame([("i", None)], "item_id string, text string")
    kept = corpus_pipeline.decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 4
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns and near.count() == 3
    assert corpus_pipeline.pack(spark, docs, "").count() == 4
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.pack, corpus_pipeline.dedup_lines):
        assert stage(spark, docs.filter("doc_id > 9"), "").count() == 0
