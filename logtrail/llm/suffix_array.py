"""Suffix-array dedup of byte strings: per-shard suffix arrays, common prefixes, merging across shards.

A shard's suffixes are sorted by Larsson-Sadakane refinement in numpy, Kasai's common prefixes are found by many
walkers side by side, and neighbours that share `length` bytes are one class of equal windows. Shards are dealt out by
content (see repeats), so equal strings meet in a shard; only a string with very many different surroundings spans
several, and those are merged by binary search. Every byte that a repeated window covers is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from logtrail.llm.common import slices, table
from logtrail.llm.repeats import Kind, identified, merged, mix, repeated_spans, with_spans

LENGTH, CORE = 200, 48
WALKERS_EVERY = 64
#: A random number for each byte.
OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of data in order. Sorted to the end: Kasai's bound does not hold where ties are left."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for i in range(7):  # the first seven bytes at once, nine bits each
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group is numbered by its first place
    rank = np.empty(n, np.int64)
    rank[order] = group
    done, h = np.r_[new[1:], True] & new, 7
    open_ = np.flatnonzero(~done)
    while len(open_):
        here = order[open_]
        ahead = here + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[here] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        here, key = here[by], key[by]
        order[open_] = here
        new = np.r_[True, key[1:] != key[:-1]]
        rank[here] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        open_ = open_[~(np.r_[new[1:], True] & new)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place in order, the bytes its suffix shares with the one before it, `cap` at most.

    Kasai: the length shared drops by one at most from one suffix of the text to the next. Each walker goes through a
    stretch of the text of its own, all in step.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    end_mark = np.zeros(n + cap + 9, np.int16)
    end_mark[:n] = data
    end_mark[n:] = -1 - np.arange(cap + 9, dtype=np.int16)  # the end of the data equals nothing
    eight = end_mark[: n + cap + 1].astype(np.uint64)
    for i in range(1, 8):
        eight = (eight * np.uint64(0x100000001B3)) ^ end_mark[i : i + n + cap + 1].astype(np.uint64)
    shared = np.zeros(n, np.int32)
    at = np.arange(0, n, WALKERS_EVERY)
    stop, h = np.minimum(at + WALKERS_EVERY, n), np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        left, right = at + h, np.where(other < 0, n, other) + h
        far = (h + 8 <= cap) & (eight[left] == eight[np.minimum(right, n + cap)]) & (other >= 0)
        one = ~far & (h < cap) & (other >= 0) & (end_mark[left] == end_mark[right])
        h = h + np.where(far, 8, one)
        ended = ~(far | one)
        shared[at[ended]] = h[ended]
        h = np.where(ended, np.maximum(h - 1, 0), h)
        at = at + ended
        if (over := at >= stop).any():
            at, stop, h = at[~over], stop[~over], h[~over]
    return shared[order]


def classes(bodies: list[bytes], windows: np.ndarray, length: int = LENGTH):
    """The class of equal windows of each window of each body."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    order = suffix_array(data)
    new = common_prefixes(data, order, length) < length
    found = np.empty(len(data), np.int64)
    found[order] = np.cumsum(new) - 1
    sizes = np.array([len(x) for x in bodies])
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return found[starts], lambda s, at: bodies[s][at : at + length]


def _hashes(text: bytes) -> np.ndarray:
    return OF_BYTE[np.frombuffer(text, np.uint8)]


def _cut(text: bytes):
    return lambda first, number: text[first : first + number]


BYTES = Kind(LENGTH, CORE, _hashes, _cut, classes)


def without_repeats(spark: SparkSession, docs: DataFrame, kept: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `kept` the bytes left.

    Texts are taken as UTF-8; null and empty ones have no bytes, and texts shorter than a window lose none. What is
    left may begin or end within a character, hence bytes. Of a repeated passage every occurrence goes. Repeated rows
    are repeats of each other. An empty table gives no rows. Nothing is chosen
    among ties, since every occurrence goes. Columns other than doc_id and text are not looked at.
    """
    docs = identified(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 1 + kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for doc_id, z, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text, gone, at, parts = unpress.decompress(z), merged(spans), 0, []
                for lo, hi in gone:
                    parts.append(text[at:lo])
                    at = hi
                left = b"".join([*parts, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left)[: 5 + kept])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return with_spans(docs, repeated_spans(spark, docs, BYTES)).mapInArrow(run, schema)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without bytes that repeated windows cover; see without_repeats."""
    return without_repeats(spark, table(spark, sf_dir, "documents"))
