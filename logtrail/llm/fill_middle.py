"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class (blanks, or anything else) with the number of units
complete at each run's end. A cut after k units is found by binary search for the run that completes unit k; where a
class has a unit for each character, the place within the run follows by arithmetic. No list of tokens is made.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logtrail.llm.common import map_batches, table

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """Marks before prefix, suffix and middle; percent of texts transformed and of these in suffix-first order.

    unit: "word" (blanks with the run of other characters after them; blanks at the end are one too) or "char".
    """

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "word"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


DEFAULT = Settings()


@dataclass(frozen=True)
class Runs:
    """ends: where each run ends, in code points; units: how many units are complete there; each: characters a unit, 0 if it is the run."""

    ends: np.ndarray
    units: np.ndarray
    each: int

    @property
    def total(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def place(self, k: int) -> int:
        """The code point after which k units are complete."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.units, k, side="left"))  # the first run that completes unit k
        before = int(self.units[run - 1]) if run else 0
        start = int(self.ends[run - 1]) if run else 0
        return start + (k - before) * self.each if self.each else int(self.ends[run])


def encode_runs(text: str, unit: str = "word") -> Runs:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.append(np.flatnonzero(blank[1:] != blank[:-1]) + 1, len(points)) if len(points) else np.zeros(0, np.int64)
    if unit == "char":
        return Runs(ends, ends, 1)
    closes = ~blank[ends - 1] if len(points) else np.zeros(0, bool)
    if len(closes):
        closes[-1] = True  # blanks at the end
    return Runs(ends, np.cumsum(closes), 0)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform_text(text: str, doc_id: int | None, s: Settings = DEFAULT) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    runs, (h1, h2, h3, h4) = encode_runs(text, s.unit), draws(s.seed, doc_id)
    if not text or h3 % 100 >= s.rate or any(mark in text for mark in s.marks):
        return runs.total, PLAIN, None, None, text
    low, high = (runs.place(k) for k in sorted((h1 % (runs.total + 1), h2 % (runs.total + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < s.suffix_first:
        return runs.total, SPM, low, high - low, f"{s.suffix}{suffix}{s.prefix}{prefix}{s.middle}{middle}"
    return runs.total, PSM, low, high - low, f"{s.prefix}{prefix}{s.suffix}{suffix}{s.middle}{middle}"


def restore_text(output: str, form: str, s: Settings = DEFAULT) -> str:
    """The text from output and form alone: no part holds a mark, and no mark begins within another."""
    if form == PLAIN:
        return output
    rest, _, middle = output.partition(s.middle)
    if form == SPM:
        suffix, _, prefix = rest.removeprefix(s.suffix).partition(s.prefix)
    else:
        prefix, _, suffix = rest.removeprefix(s.prefix).partition(s.suffix)
    return prefix + middle + suffix


def transform(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row of docs (doc_id, text); other columns are left aside.

    A null text is empty; empty texts and those that hold a mark stay as they are (plain). A null doc_id is drawn for
    as an empty number. Rows that repeat a doc_id are each judged by their own text, with the same draws. A text is
    worked on whole, in a few arrays of its length. An empty table gives no rows. One narrow pass: nothing is shuffled.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        found = [transform_text(text or "", i, settings) for i, text in zip(ids, batch.column(1).to_pylist(), strict=True)]
        n, form, before, between, output = zip(*found, strict=True) if found else [()] * 5
        arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), of, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """transformed (output, form, any others) with `restored`, the text rebuilt from those two alone."""
    names = transformed.columns

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        output, form = (batch.column(names.index(c)).to_pylist() for c in ("output", "form"))
        texts = [None if o is None else restore_text(o, f, settings) for o, f in zip(output, form, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    return map_batches(transformed, of, ", ".join(f"`{n}` {t}" for n, t in transformed.dtypes) + ", restored string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed and rebuilt; see transform and restore."""
    found = restore(transform(table(spark, sf_dir, "documents")))
    return found.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "sha2(output, 256) AS output_sha256", "sha2(restored, 256) AS restored_sha256")
