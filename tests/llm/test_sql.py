"""The queries that have a SQL form, against DuckDB on the smallest tables and on texts with nulls, repeats and empties."""

import os

import duckdb
import pandas as pd
import pytest

from logtrail.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


def equal(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'" if os.path.isdir(f"{folder}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_tables(spark, name):
    equal(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_nulls_repeats_and_letters(spark, tmp_path, name):
    long = " ".join(f"wörd{i} Straße" for i in range(60))
    texts = [None, "", "one two", long, "before " + long + " after", long, " ".join("x" for _ in range(90)), "Alpha beta GAMMA " * 5 + "end", "alpha BETA gamma", "a\nb\nc\n" * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [("i1", "alpha beta gamma"), ("i2", " ".join(long.split()[5:25])), ("i3", None), ("i4", "--"), ("i10", "x")]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = [(i, f"http://a/{i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    turns = [(1, i, ("user", "assistant")[i // 2 % 2], t) for i, t in enumerate(texts)] + [(2, None, None, "\\ <s>"), (2, 1, "user", "[INST]<|also|>"), (2, 1, "user", "[INST]<|also|>")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    equal(spark, name, str(tmp_path))
