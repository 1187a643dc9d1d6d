"""Documents to passages. All steps stay on the document's row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.columns import let, strip
from logtrail.schema import DEFAULT, Config
from logtrail.sources.tables import Table

BLANK_LINES = r"\n\s*\n"


def paragraphs(text: Column, separator: str = BLANK_LINES) -> Column:
    """array<struct<heading, content>>: paragraphs with the heading above them; a block that begins with # is one.

    Blocks are cut into sections where a heading begins; each block is looked at once and no array grows step by step.
    """

    def sections(blocks: Column) -> Column:
        def section(starts: Column) -> Column:
            def titled(start: Column, k: Column) -> Column:
                first = F.get(blocks, start)
                head, end = first.startswith("#"), F.coalesce(F.get(starts, k + 1), F.size(blocks))
                title = F.when(head, strip(F.regexp_replace(first, "^#+", ""))).otherwise(F.lit(""))
                rest = F.when(head, F.slice(blocks, start + 2, end - start - 1)).otherwise(F.slice(blocks, start + 1, end - start))
                return let(title, lambda t: F.transform(rest, lambda b: F.struct(t.alias("heading"), b.alias("content"))))

            return F.flatten(F.transform(starts, titled))

        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda i: (i == 0) | F.get(blocks, i).startswith("#"))
        return F.when(F.size(blocks) > 0, let(at, section)).otherwise(F.from_json(F.lit("[]"), "array<struct<heading:string,content:string>>"))

    return let(F.filter(F.transform(F.split(text, separator), strip), lambda b: b != ""), sections)


def spans(ends: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """Passages of one heading, as first and last paragraph + 1; ends: how many characters each paragraph ends at.

    A passage takes all paragraphs that fit, found in the sums by binary search, and at least one that the one before has
    not; the last `overlap` of it open the next.
    """
    sums, out, first, least = np.append(0, ends), [], 0, 1
    while True:
        last = min(max(least, int(np.searchsorted(sums, sums[first] + most, side="right")) - 1), len(ends))
        out.append((first, last))
        if last == len(ends):
            return out
        first, least = max(first, last - overlap), last + 1


def chunks(docs: DataFrame, config: Config = DEFAULT, separator: str = BLANK_LINES) -> DataFrame:
    """source, at, heading, content: passages of at most chunk_chars, in one narrow pass; a null text has none."""

    def of(headings: pa.Array, contents: pa.Array) -> list[tuple[str, str]]:
        """The passages of a document: paragraphs that follow each other under equal headings belong together."""
        titles, texts, ends, out = headings.to_pylist(), contents.to_pylist(), np.cumsum(pc.utf8_length(contents).to_numpy(zero_copy_only=False)), []
        cuts = [0, *(i for i in range(1, len(titles)) if titles[i] != titles[i - 1]), len(titles)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            before = ends[i - 1] if i else 0
            out += [(titles[i], "\n\n".join(texts[i + a : i + b])) for a, b in spans(ends[i:j] - before, config.chunk_chars, config.chunk_overlap)] if j > i else []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                found = of(batch.column(1)[k].values, batch.column(2)[k].values)
                rows += [(batch.column(0)[k].as_py(), at, *passage) for at, passage in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["source", "at", "heading", "content"])

    found = docs.select(docs["source"].cast("string").alias("source"), paragraphs(F.coalesce(docs["text"], F.lit("")), separator).alias("p"))
    return found.select("source", F.col("p")["heading"].alias("headings"), F.col("p")["content"].alias("contents")).mapInArrow(run, "source string, at long, heading string, content string")


def embed_text() -> Column:
    return F.when(F.col("heading") != "", F.concat("heading", F.lit(". "), "content")).otherwise(F.col("content"))


def embed(passages: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 5) -> DataFrame:
    """Adds `embedding`, by a function given from texts to vectors, called with `batch` texts at most."""
    columns = passages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame.pop("_text").tolist()
            yield frame.assign(embedding=[v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    schema = ", ".join(f"`{n}` {t}" for n, t in passages.dtypes) + ", embedding array<float>"
    return passages.withColumn("_text", embed_text()).select(*columns, "_text").mapInPandas(run, schema)


def stats(passages: DataFrame) -> DataFrame:
    """Passages of each source, and of all where source is null."""
    return passages.rollup("source").agg(F.count(F.lit(1)).alias("passages"))


def write(passages: DataFrame, path: str) -> int:
    """Replaces the index at path when all is written: read it by Table(spark, path).read(). The number of passages."""
    return Table(passages.sparkSession, path).replace(passages)
