"""Tables replaced as a whole, and ingest with its counts and quarantine."""

import json

import pytest
from pyspark.sql import functions as F

from logtrail.operators import normalize
from logtrail.sources.tables import Table
from logtrail.sources.text_files import Writer, write_files


def values(df):
    return sorted(r.x for r in df.collect())


def test_replacing(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    df = lambda *x: spark.createDataFrame([(i, i % 2) for i in x], "x long, part long")
    assert table.replace(df(1, 2, 3), ("part",)) == 3
    old = table.read()
    assert table.replace(df(4), ("part",)) == 1 and table.replace(df()) == 0
    assert values(table.read()) == [] and values(table.read(2)) == [4] and values(old) == [1, 2, 3]
    table.vacuum(keep=2)
    assert table.versions() == [2, 3] and values(table.read(2)) == [4]
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    table.replace(spark.range(5).withColumnRenamed("id", "x"))
    bad = spark.range(100).select(F.when(F.col("id") < 50, F.col("id")).otherwise(F.raise_error(F.lit("half way")).cast("long")).alias("x"))
    with pytest.raises(Exception, match="half way"):
        table.replace(bad)
    assert values(table.read()) == [0, 1, 2, 3, 4] and table.versions() == [1]
    table.vacuum()
    assert sum(p.name.startswith("v") for p in (tmp_path / "t").iterdir()) == 1 and values(table.read()) == [0, 1, 2, 3, 4]


def test_two_writers_of_a_version(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    table._commit(1, "a")
    with pytest.raises(RuntimeError):
        table._commit(1, "b")
    assert table._folder(1) == "a"


def records(spark, *raw):
    return spark.createDataFrame(list(enumerate(raw)), "ordinal long, raw string")


def test_ingest_counts(spark, tmp_path):
    good, late = json.dumps({"time": "2026-07-03T10:00:00Z", "host": "h"}), json.dumps({"time": "never"})
    found = normalize.ingest_counted(spark, records(spark, late, good, good, late, late))
    assert (found.read, found.untimed, found.quarantined) == (5, 3, 0)
    assert sorted(r.id for r in found.events.collect()) == [1, 2]
    with pytest.raises(ValueError, match="at 1, 3, 4"):
        normalize.ingest_counted(spark, records(spark, good, "[1]", good, "x", '"{}"', "5"))
    path = f"file://{tmp_path}/bad"
    found = normalize.ingest_counted(spark, records(spark, good, "[1]", late, "x"), path)
    assert (found.read, found.untimed, found.quarantined, found.events.count()) == (4, 1, 2, 1)
    assert sorted((r.ordinal, r.raw, r.reason) for r in spark.read.parquet(path).collect()) == [(1, "[1]", "no JSON object"), (3, "x", "no JSON object")]
    for nothing in (records(spark, late, late), records(spark, "x", late)):
        with pytest.raises(ValueError, match="usable time"):
            normalize.ingest_counted(spark, nothing, path)
    none = normalize.ingest_counted(spark, spark.createDataFrame([], "ordinal long, raw string"))
    assert (none.read, none.untimed, none.events.count()) == (0, 0, 0)


def test_named_files(spark, tmp_path):
    folder = tmp_path / "out"
    texts = lambda rows: spark.createDataFrame(rows, "name string, text string").repartition(3)
    write_files(texts([("a.md", "one"), ("b é.md", ""), ("c.md", None)]), f"file://{folder}")
    assert {p.name: p.read_text() for p in folder.iterdir()} == {"a.md": "one", "b é.md": "", "c.md": ""}
    write_files(texts([("d.md", "two")]), f"file://{folder}")
    assert [p.name for p in folder.iterdir()] == ["d.md"]
    for bad in ([("x.md", "1"), ("x.md", "2")], [("a/b", "1")], [(None, "1")]):
        with pytest.raises(Exception):  # noqa: B017
            write_files(texts(bad), f"file://{folder}")
        assert [p.name for p in folder.iterdir()] == ["d.md"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    failing = texts([(f"{i}.md", str(i)) for i in range(50)]).withColumn("text", F.when(F.col("name") == "33.md", F.raise_error(F.lit("half way"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="half way"):
        write_files(failing, f"file://{folder}")
    assert [p.name for p in folder.iterdir()] == ["d.md"] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_named_files_of_late_tasks(tmp_path):
    folder = tmp_path / "out"
    late = Writer(f"file://{folder}")
    late.abort([])
    with pytest.raises(RuntimeError, match="has ended"):
        late.write(iter([("a.md", "1")]))
    assert not list(tmp_path.iterdir())

    writer = Writer(f"file://{folder}")

    def rows(end):
        yield "a.md", "1"
        end()
        (tmp_path / f".out-{writer.mark}").mkdir()  # as stores do that make folders by themselves
        yield "b.md", "2"

    with pytest.raises(RuntimeError, match="has ended"):
        writer.write(rows(lambda: writer.abort([])))
    assert not list(tmp_path.iterdir())

    writer = Writer(f"file://{folder}")
    done = writer.write(iter([("a.md", "1"), ("b.md", "2")]))
    with pytest.raises(RuntimeError, match="has ended"):
        writer.write(rows(lambda: writer.commit([done])))
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and sorted(p.name for p in folder.iterdir()) == ["a.md", "b.md"]
