"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, each text scanned once.

Normalising lower-cases A-Z, takes every other ASCII character that is no digit or letter for a blank, and joins the
words with single blanks. A window is `width` consecutive words of an item; an item of fewer words is one window. Of an
item the automaton holds its seeds: stretches of half a window's words, one after the other without overlap, framed by
blanks so that they match whole words only. Every occurrence of a window holds a whole seed, so each seed found is
compared with its item word by word, half a window to either side, and what agrees over a whole window is hit. Seeds
take at most a node for each byte of the items, where windows would take some ten. Hits are numbers of words, and by the
word's place map to the original.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, numbered, slices, table

#: Bytes of item text in one automaton, some 40 bytes of memory each; more items are taken in blocks of about this size.
BLOCK_BYTES = 4 << 20
WIDTH = 13
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A-Z to a-z; digits, letters and bytes of longer characters as they are; all else to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCAN_SCHEMA = "n_words long, hits array<long>, items array<string>"


def normal(text: str | None) -> bytes:
    """The folded bytes of a text: as long as its UTF-8 form, so that offsets stay the same."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


class Items:
    """Items to be found in texts."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        self.width, self.words, self.ids = width, [], []
        of, size = defaultdict(list), (width + 1) // 2
        for item_id, text in items:
            words = normal(text).split()
            number = len(self.words)
            self.words.append(words)
            self.ids.append(item_id)
            if 0 < len(words) < width:
                of[b" ".join(words)].append((number, 0))
            for at in range(0, len(words) - size + 1, size) if len(words) >= width else ():
                of[b" ".join(words[at : at + size])].append((number, at))
        self.automaton = ahocorasick.Automaton() if of else None
        for seed, places in of.items():
            framed = f" {seed.decode('latin-1')} "
            self.automaton.add_word(framed, (len(framed), tuple(places)))
        if of:
            self.automaton.make_automaton()

    def around(self, words: list[bytes], at: int, number: int, start: int) -> tuple[int, int]:
        """The words of a text that are hit by the item's seed found there; none if (0, 0)."""
        item = self.words[number]
        if len(item) < self.width:
            return at, at + len(item)
        size = (self.width + 1) // 2
        reach, lo, hi = self.width - size, 0, size
        while lo < min(reach, at, start) and words[at - lo - 1] == item[start - lo - 1]:
            lo += 1
        while hi < min(size + reach, len(words) - at, len(item) - start) and words[at + hi] == item[start + hi]:
            hi += 1
        return (at - lo, at + hi) if lo + hi >= self.width else (0, 0)

    def scan(self, text: str | None) -> tuple[int, set[int], set[str]]:
        """Number of words, the places of the words that are hit, and the items with occurring windows."""
        words = normal(text).split()
        hit: set[int] = set()
        items: set[str] = set()
        if self.automaton is None or not words:
            return len(words), hit, items
        joined = f" {b' '.join(words).decode('latin-1')} "
        at = word = 0
        for last, (length, places) in self.automaton.iter(joined):
            start = last + 1 - length
            word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            for number, begins in places:
                lo, hi = self.around(words, word, number, begins)
                if hi:
                    hit.update(range(lo, hi))
                    items.add(self.ids[number])
        return len(words), hit, items

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """The hit words as (start, end) byte ranges of the original text, neighbours merged."""
        _, hit, _ = self.scan(text)
        out: list[tuple[int, int]] = []
        last = -2
        for i, m in enumerate(WORD.finditer(normal(text))) if hit else ():
            if i in hit:
                out.append((out.pop()[0] if last == i - 1 else m.start(), m.end()))
                last = i
        return out


#: A block of items: a name of its own, and the items.
Block = tuple[str, list[tuple[str, str | None]]]
#: What this Python process built last, by block and width: its tasks build it once.
_built: dict[tuple[str, int], Items] = {}


def built(block: Block, width: int) -> Items:
    key = (block[0], width)
    if key not in _built:
        _built.clear()
        _built[key] = Items(block[1], width)
    return _built[key]


def blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of bounded size: one if they fit, else by hash of the id."""
    items = items.select(items[id_column].cast("string").alias("id"), items[text_column].alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        yield uuid.uuid4().hex, [(r.id if r.id is not None else "", r.t) for r in part.toLocalIterator()]


def passed(some: DataFrame, shared: Broadcast, key: str, width: int, hits_only: bool) -> DataFrame:
    """For each row of some (key, text): the key, the word count, the places hit and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = built(shared.value, width)
        for batch in slices(batches):
            found = [items.scan(text) for text in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([sorted(hit) for _, hit, _ in found], pa.list_(pa.int64())),
                    pa.array([sorted(ids) for _, _, ids in found], pa.list_(pa.string())),
                ],
                [key, "n_words", "hits", "items"],
            )
            yield out.filter(pa.array([bool(hit) for _, hit, _ in found], pa.bool_())) if hits_only else out

    return some.select(key, "text").mapInArrow(run, f"{key} long, {SCAN_SCHEMA}")


def block_by_block(spark: SparkSession, rows: DataFrame, first: Block, rest: Iterator[Block], width: int) -> DataFrame:
    """_row, n_words, hits and items of the rows (_row, text) that any block hits.

    A block is broadcast, a pass writes the few rows that it hits, and the block is released before the next one.
    """
    found = []
    for block in _chained(first, rest):
        shared = spark.sparkContext.broadcast(block)
        found.append(materialize(spark, passed(rows, shared, "_row", width, True), "decontaminate-hits"))
        shared.unpersist()
    whole = reduce(DataFrame.unionByName, found)
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return whole.groupBy("_row").agg(F.max("n_words").alias("n_words"), both("hits"), both("items"))


def _chained(first: Block, rest: Iterator[Block]) -> Iterator[Block]:
    yield first
    yield from rest


def scan(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
    docs_id: str = "doc_id", docs_text: str = "text", items_id: str = "item_id", items_text: str = "text",
) -> DataFrame:
    """For each document its word count, the places of the words hit and the items found.

    Items whose text exceeds block_bytes are taken in blocks, each with an automaton of bounded size and a pass of
    its own over the documents. Rows are numbered and written before these, and the passes meet by that number, so
    each row is judged by itself whatever its id. Null and empty texts have no words; an item without words has no
    window; repeated documents give repeated rows; of a long text only the words hit are kept. A null item id counts
    as an empty one. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    some = docs.select(docs[docs_id].cast("long").alias("doc_id"), docs[docs_text].alias("text"))
    rest = blocks(items, items_id, items_text, block_bytes)
    first, second = next(rest), next(rest, None)
    if second is None:
        return passed(some, spark.sparkContext.broadcast(first), "doc_id", width, False)
    rows = numbered(spark, some, "decontaminate-rows").select("_row", "doc.*")
    found = block_by_block(spark, rows, first, _chained(second, rest), width).drop("n_words")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    none = {"hits": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")}
    out = rows.select("_row", "doc_id", n_words.cast("long").alias("n_words")).join(found, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """The digest of a scan: contaminated where at least one word in `share` is hit."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, judged row by row within the scan, with their own columns.

    One block of items: a pass keeps whole rows and needs no shuffle. Several: the rows are numbered and written
    first, and the contaminated numbers, of all passes together, are taken out. Nulls, repeats and empty tables as in
    scan; columns of any name are kept.
    """
    spark = docs.sparkSession
    rest = blocks(items, "item_id", "text", block_bytes)
    first, second = next(rest), next(rest, None)
    if second is not None:
        rows = numbered(spark, docs, "decontaminate-rows")
        texts = rows.select("_row", F.col("doc")["text"].alias("text"))
        found = block_by_block(spark, texts, first, _chained(second, rest), width)
        gone = found.filter(share * F.size("hits") >= F.col("n_words")).select("_row")
        return rows.join(gone, "_row", "left_anti").select("doc.*")
    shared, text_at = spark.sparkContext.broadcast(first), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = built(shared.value, width)
        for batch in slices(batches):
            found = [items.scan(text) for text in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array([not (hit and share * len(hit) >= n) for n, hit, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged against every benchmark item. Null texts have no words."""
    return judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
