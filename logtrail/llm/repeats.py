"""Exact repeats of a fixed length across a corpus: what suffix arrays and suffix trees share.

A document is a sequence of tokens (bytes, or words); a window is `length` consecutive ones. Every window has an
anchor: of its `core`-token substrings the one of the smallest hash. Equal windows have equal anchors at equal
offsets, so windows of different anchors need never meet. Consecutive windows with one anchor form a segment.

1. Anchors are counted; those that occur once, with all their windows, are done.
2. Equal segments of the others are taken together, whatever their number; an anchor with one such segment is done too.
3. The distinct segments that are left are dealt out by anchor to shards of bounded size, in which a suffix array or
   suffix trees find the windows that repeat. The segments of an anchor that has very many are dealt over several
   shards, each giving its distinct windows; these are merged in sorted order by binary search.
4. The repeated windows go back to all places of their segments and are merged in each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, slices

#: Tokens hashed at once; longer documents are taken in pieces that overlap by a window less one.
TOKENS_AT_ONCE = 1 << 17
#: Segments of a document cut out at once.
SEGMENTS_AT_ONCE = 4096
#: Bytes of segments in a shard, about; distinct segments of one anchor that a shard gets at most, about.
SHARD_BYTES, SEGMENTS_A_SHARD = 1 << 20, 2_000
BASE = 0x9E3779B97F4A7C15 | 1
POSITION_BITS = 24


@lru_cache(maxsize=3)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, i below n."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def segments(tokens: np.ndarray, last: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Segments of documents laid end to end: first window, number of windows, hash of the anchor, of the segment.

    tokens: a random 64-bit number for each token; last: for each place, the end of its document.
    """
    n, w = len(tokens), length - core + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    up, down = (x[: n + 1] for x in powers(TOKENS_AT_ONCE + length + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * up[:n], out=sums[1:])
    grams = mix((sums[core:] - sums[:-core]) * down[: n - core + 1])
    low = (np.uint64(1) << np.uint64(POSITION_BITS)) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first place
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    owner = (least & low).astype(np.int64)
    valid = np.arange(n - length + 1) + length <= last[: n - length + 1]
    first = valid.copy()
    first[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= first[1:] | ~valid[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(ends)
    whole = mix((sums[hi + length] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return lo, hi - lo + 1, grams[owner[lo]].view(np.int64), whole.view(np.int64)


@dataclass(frozen=True)
class Kind:
    """What a token is, and how windows that repeat are found among segments.

    hashes: text -> a random 64-bit number for each token. cut: text -> function(first, number) -> bytes of tokens.
    classes: (segments' bytes, windows in each) -> for all windows in turn the number of the class of equal ones, and
    a function giving the bytes of a window.
    """

    length: int
    core: int
    hashes: Callable[[bytes], np.ndarray]
    cut: Callable[[bytes], Callable[[int, int], bytes]]
    classes: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, Callable[[int, int], bytes]]]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and an identity of 88 bits: rows that agree in id and text are alike in every result."""
    doc_id = docs["doc_id"].cast("long")
    more = F.xxhash64(F.lit("more"), doc_id, docs["text"]).bitwiseAND(F.lit((1 << 24) - 1))
    return docs.select(doc_id.alias("doc_id"), docs["text"], F.xxhash64(doc_id, docs["text"]).alias("rid"), more.alias("more"))


def anchored(docs: DataFrame, kind: Kind) -> DataFrame:
    """A row for each segment: anchor, segment (hashes), rid, and at: first window, number of windows, more."""
    schema = "anchor long, segment long, rid long, at long"

    def of(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        tokens = np.concatenate([x[3] for x in parts])
        sizes = np.array([len(x[3]) for x in parts])
        ends = np.cumsum(sizes)
        lo, n, anchor, segment = segments(tokens, np.repeat(ends, sizes), kind.length, kind.core)
        doc = np.searchsorted(ends, lo, side="right")
        rid, more, base = (np.array([x[i] for x in parts], np.int64)[doc] for i in range(3))
        at = ((lo - (ends - sizes)[doc] + base) << 32) | (n << 24) | more
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, segment, rid, at)], ["anchor", "segment", "rid", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches):
            for text, rid, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = kind.hashes((text or "").encode("utf-8", "surrogatepass"))
                for i in range(0, max(1, len(tokens) - kind.length + 1), TOKENS_AT_ONCE):
                    part = tokens[i : i + TOKENS_AT_ONCE + kind.length - 1]
                    if len(part) < kind.length:
                        continue
                    if held and total + len(part) > TOKENS_AT_ONCE:
                        yield of(held)
                        held, total = [], 0
                    held.append((rid, more, i, part))
                    total += len(part)
        if held:
            yield of(held)

    return docs.select("text", "rid", "more").mapInArrow(run, schema)


def zipped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept and the text as compressed bytes, for a join that moves every text."""
    fields = [docs.schema[c] for c in keep]
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = [press.compress((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], [*keep, "z"])

    return docs.select(*keep, "text").mapInArrow(run, T.StructType([*fields, T.StructField("z", T.BinaryType())]))


def cut_out(joined: DataFrame, kind: Kind) -> DataFrame:
    """The bytes of the segments listed (anchor, segment, n, salt, hot, first, windows) for each compressed text."""
    schema = "anchor long, salt int, segment long, n long, windows int, hot boolean, body binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def of(held: list[pa.StructArray], cuts: list[bytes]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([x.field(c) for x in held]) for c in names[:-1]]
        return pa.RecordBatch.from_arrays([*(c.cast(k) for c, k in zip(columns, kinds, strict=False)), pa.array(cuts, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, held, cuts = zstandard.ZstdDecompressor(), [], []
        for batch in slices(batches):
            for z, wanted in zip(batch.column(0), batch.column(1), strict=True):
                cut = kind.cut(unpress.decompress(z.as_py()))
                for i in range(0, len(wanted.values), SEGMENTS_AT_ONCE):
                    part = wanted.values.slice(i, SEGMENTS_AT_ONCE)
                    held.append(part)
                    cuts += [cut(first, windows + kind.length - 1) for first, windows in zip(*(part.field(c).to_pylist() for c in ("first", "windows")), strict=True)]
                    if len(cuts) >= SEGMENTS_AT_ONCE:
                        yield of(held, cuts)
                        held, cuts = [], []
            if cuts:
                yield of(held, cuts)
                held, cuts = [], []

    return joined.select("z", "wanted").mapInArrow(run, schema)


def runs_of(repeated: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of true in segments laid end to end: segment, first window in it, number of windows."""
    offsets = np.cumsum(sizes) - sizes
    begins = np.zeros(len(repeated), bool)
    begins[offsets] = True
    first = repeated & (begins | ~np.r_[False, repeated[:-1]])
    ends = repeated & np.r_[begins[1:] | ~repeated[1:], True]
    lo, hi = np.flatnonzero(first), np.flatnonzero(ends)
    at = np.searchsorted(offsets, lo, side="right") - 1
    return at, lo - offsets[at], hi - lo + 1


def in_shards(bodies: DataFrame, kind: Kind, shard_bytes: int) -> DataFrame:
    """Rows of repeated stretches (f1 null); of anchors over several shards also one for each distinct window."""
    schema = "anchor long, segment long, first int, windows int, f1 long, f2 long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def of(rows: list[dict]) -> pa.RecordBatch:
        sizes, n = (np.array([x[c] for x in rows]) for c in ("windows", "n"))
        found, window = kind.classes([x["body"] for x in rows], sizes)
        total = np.bincount(found, weights=np.repeat(n, sizes))
        repeated = total[found] >= 2
        out = [(rows[s]["anchor"], rows[s]["segment"], at, size, None, None) for s, at, size in zip(*runs_of(repeated, sizes), strict=True)]
        hot = np.repeat(np.array([x["hot"] for x in rows], bool), sizes)
        if hot.any():
            offsets = np.cumsum(sizes) - sizes
            _, firsts = np.unique(np.where(hot, found, -1), return_index=True)
            for at in firsts[hot[firsts]]:
                s = int(np.searchsorted(offsets, at, side="right")) - 1
                digest = hashlib.blake2b(window(s, int(at - offsets[s])), digest_size=16).digest()
                f1, f2 = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
                out.append((rows[s]["anchor"], rows[s]["segment"], int(at - offsets[s]), 0 if repeated[at] else 1, f1, f2))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in slices(batches, 1024):
            for row in batch.to_pylist():
                if size >= shard_bytes and (row["anchor"], row["salt"]) != last:
                    yield of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
                last = (row["anchor"], row["salt"])
        if held:
            yield of(held)

    return bodies.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(run, schema)


def across_shards(distinct: DataFrame) -> DataFrame:
    """Windows not repeated in their own shard that another shard has too.

    Each shard gives each distinct window once, so a window has as many rows as shards at most. Ranges of
    fingerprints are sorted, and each window looks for a neighbour of its own by binary search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            f1 = t.column("f1").to_numpy()
            end = int(np.searchsorted(f1, f1[-1], side="left"))  # rows of the last fingerprint wait for the next batch
            yield from settled(t.slice(0, end))
            rest = t.slice(end)
        if rest is not None:
            yield from settled(rest)

    def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        f1, f2 = (t.column(c).to_numpy() for c in ("f1", "f2"))
        key = np.rec.fromarrays([f1, f2])
        left, right = np.searchsorted(key, key, side="left"), np.searchsorted(key, key, side="right")
        new = (right - left >= 2) & (t.column("windows").to_numpy() == 1)
        yield from t.select(["anchor", "segment", "first", "windows"]).filter(pa.array(new)).combine_chunks().to_batches()

    return distinct.repartitionByRange("f1").sortWithinPartitions("f1", "f2").mapInArrow(run, "anchor long, segment long, first int, windows int")


def repeated_spans(spark: SparkSession, docs: DataFrame, kind: Kind, shard_bytes: int = SHARD_BYTES, segments_a_shard: int = SEGMENTS_A_SHARD) -> DataFrame:
    """rid, more and spans (tokens, end exclusive, not merged) of the identified documents that have repeated windows."""
    every = materialize(spark, anchored(docs, kind), "repeat-windows")
    # counts are written before each join: with two shuffles of its own Spark can split the rows of a hot anchor
    again = materialize(spark, every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "repeat-anchors")
    places = materialize(spark, every.join(again, "anchor"), "repeat-places")
    distinct = places.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    distinct = materialize(spark, distinct, "repeat-segments")
    many = materialize(spark, distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")), "repeat-anchors")
    windows = F.shiftright(F.col("one.at"), 24).bitwiseAND(F.lit(255)).cast("int")
    distinct = distinct.join(many, "anchor").select("anchor", "segment", "n", "m", F.col("one.rid").alias("rid"), F.col("one.at").bitwiseAND(F.lit((1 << 24) - 1)).alias("more"), F.shiftright(F.col("one.at"), 32).cast("int").alias("first"), windows.alias("windows"))
    distinct = materialize(spark, distinct, "repeat-segments")

    hot = F.col("m") > segments_a_shard
    salt = F.when(hot, F.pmod(F.col("segment"), F.ceil(F.col("m") / segments_a_shard))).otherwise(0).cast("int")
    wanted = distinct.filter("m > 1").groupBy("rid", "more").agg(F.collect_list(F.struct("anchor", "segment", "n", salt.alias("salt"), hot.alias("hot"), "first", "windows")).alias("wanted"))
    texts = zipped(docs, ["rid", "more"]).withColumnsRenamed({"rid": "_rid", "more": "_more"})
    bodies = cut_out(wanted.join(texts, (F.col("rid") == F.col("_rid")) & (F.col("more") == F.col("_more"))), kind)
    found = materialize(spark, in_shards(bodies, kind, shard_bytes), "repeat-found")
    known = found.filter("f1 IS NULL").select("anchor", "segment", "first", "windows")
    if found.filter("f1 IS NOT NULL").limit(1).count():
        known = known.unionByName(across_shards(found.filter("f1 IS NOT NULL")))
    known = known.unionByName(distinct.filter("m = 1").select("anchor", "segment", F.lit(0).alias("first"), "windows"))

    start = F.shiftright("at", 32) + F.col("first")
    spans = places.join(known, ["anchor", "segment"]).select("rid", F.col("at").bitwiseAND(F.lit((1 << 24) - 1)).alias("more"), F.struct(start.alias("lo"), (start + F.col("windows") + (kind.length - 1)).alias("hi")).alias("span"))
    return spans.groupBy("rid", "more").agg(F.collect_list("span").alias("spans"))


def merged(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """The stretches that spans (null: none) cover together, in order."""
    if not spans.is_valid or not len(spans.values):
        return []
    lo, hi = (spans.values.field(i).to_numpy() for i in range(2))
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return list(zip(lo[new].tolist(), hi[np.r_[new[1:], True]].tolist(), strict=True))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, z (compressed text) and spans, null where nothing repeats, for every document."""
    spans = spans.withColumnsRenamed({"rid": "_rid", "more": "_more"})
    texts = zipped(docs, ["doc_id", "rid", "more"])
    return texts.join(spans, (F.col("rid") == F.col("_rid")) & (F.col("more") == F.col("_more")), "left").select("doc_id", "z", "spans")
