"""Line dedup over overlapping windows of three lines.

Lines that hold no word are passed over: neither counted in a window nor removed. Every three consecutive other lines
of a document make a window, known by two 64-bit hashes. Of equal windows anywhere in the corpus that of the smallest
(doc_id, row, place) stays; the lines of all later ones are removed, overlapping windows merged into one set of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, numbered, table

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def later_windows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """_row and the places (among lines with a word) at which its windows that occur earlier in the corpus begin.

    rows: _row, doc_id, text. Windows are written once. Counts and first places are summed before the shuffle, so a
    window that a third of all documents share is one row for each task; they are written too, so that the join back
    has two shuffles of its own and Spark splits the rows of a hot window.
    """
    lines = rows.select("_row", "doc_id", F.filter(_lines(F.col("text")), _has_word).alias("x"))

    def window(i: Column) -> Column:
        three = F.slice("x", i + 1, WINDOW)
        return F.struct(F.xxhash64(three).alias("h"), F.xxhash64(F.lit("line"), three).alias("h2"), i.alias("at"))

    starts = F.sequence(F.lit(0), F.size("x") - WINDOW)
    windows = lines.filter(F.size("x") >= WINDOW).select("_row", "doc_id", F.explode(F.transform(starts, window)).alias("w"))
    windows = materialize(spark, windows.select("_row", "doc_id", "w.*"), "line-windows")
    place = F.struct("doc_id", "_row", "at")
    first = windows.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(spark, first.filter("n > 1").select("h", "h2", "first"), "line-first")
    later = windows.join(first, ["h", "h2"]).filter((F.col("_row") != F.col("first._row")) | (F.col("at") != F.col("first.at")))
    return later.groupBy("_row").agg(F.collect_set("at").alias("at"))


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with kept text, n_lines and n_removed added; other columns as they were.

    Each row is a document of its own, whatever its doc_id: rows that share an id, or have none, are told apart by a
    number, so exact repeats are later occurrences and different texts never lose lines for each other. Windows are
    ordered by doc_id (null before any other), rows of one id as they were read, then place. Documents of fewer than
    three lines with a word stay whole, null texts stay null, empty ones empty; long texts are one row's array of
    lines. Columns of docs named n_lines or n_removed give way to the new ones; no other name clashes. An empty table
    gives no rows.
    """
    rows = numbered(spark, docs, "line-rows")
    text = F.col("doc")["text"]
    places = later_windows(spark, rows.select("_row", F.col("doc")["doc_id"].cast("long").alias("doc_id"), text.alias("text")))
    out = rows.join(places, "_row", "left").withColumn("lines", _lines(text))
    worded = F.filter(F.transform("lines", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    out = out.withColumn("worded", worded)
    gone = F.array_distinct(F.flatten(F.transform("at", lambda k: F.slice("worded", k + 1, WINDOW))))
    out = out.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    kept = F.when(F.size("gone") > 0, kept).otherwise(text)
    columns = [kept.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, lines removed, and the digest of what is left. Null texts count as empty."""
    out = dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB. Windows are compared by their lines there, not by hashes.
LINES_SQL = r"""
lines AS (
  SELECT doc_id, UNNEST(string_split(COALESCE(text, ''), chr(10))) AS x, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS i
  FROM {docs}),
worded AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS c
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, c, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
later AS (
  SELECT doc_id, c FROM windows WHERE z IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, c) > 1),
gone AS (
  SELECT DISTINCT l.doc_id, w.i FROM later l CROSS JOIN (VALUES (0), (1), (2)) v(k) JOIN worded w ON w.doc_id = l.doc_id AND w.c = l.c + v.k),
deduped AS (
  SELECT l.doc_id, COUNT(*) AS n_lines, COUNT(g.i) AS n_removed, COALESCE(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
"""
ORACLE_SQL = f"WITH {LINES_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM deduped"
