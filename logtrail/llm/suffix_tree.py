"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes that begin a window are split into groups by prefixes of words; a group too large for memory is split by
a longer prefix, so prefixes vary in length. Each group's subtree is built from its sorted suffixes: an internal node
is a stretch of neighbours that share at least its depth, and nodes as deep as a window give the maximal repeats.
Groups come from shards that hold all windows of an anchor (see repeats). Every word that a repeated window covers is
removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from logtrail.llm.common import slices, table
from logtrail.llm.repeats import BASE, Kind, identified, merged, mix, powers, repeated_spans, with_spans
from logtrail.llm.suffix_array import OF_BYTE

LENGTH, CORE = 35, 12
#: Suffixes in a subtree at most, unless they share a whole window.
GROUP = 4096


def groups(suffixes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, words of their common prefix): split by the next word until a group fits or a window is shared."""
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= most or depth == suffixes.shape[1]:
            yield rows, depth
            continue
        column = suffixes[rows, depth]
        rows = rows[by := np.argsort(column, kind="stable")]
        cuts = np.flatnonzero(np.diff(column[by])) + 1
        small: list[np.ndarray] = []
        for part in np.split(rows, cuts):
            if len(part) > most:
                todo.append((part, depth + 1))
                continue
            if small and sum(map(len, small)) + len(part) > most:  # neighbouring prefixes share a group
                yield np.concatenate(small), depth
                small = []
            small.append(part)
        if small:
            yield np.concatenate(small), depth


def subtree(suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in order, and for each the words it shares with the one before: the tree's internal nodes by depth."""
    rest = np.ascontiguousarray(suffixes[:, depth:].astype(">u4"))
    if not rest.shape[1]:
        return np.arange(len(suffixes)), np.r_[0, np.full(len(suffixes) - 1, depth)]
    order = np.argsort(rest.view(f"S{4 * rest.shape[1]}").ravel(), kind="stable")
    rest = rest[order]
    differs = rest[1:] != rest[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), rest.shape[1])
    return order, np.r_[0, shared + depth]


def deep_nodes(suffixes: np.ndarray, length: int, most: int = GROUP) -> np.ndarray:
    """For each suffix the number of the node of depth `length` that it hangs from; one of its own if none."""
    found, nodes = np.empty(len(suffixes), np.int64), 0
    for rows, depth in groups(suffixes, most):
        order, shared = subtree(suffixes[rows], min(depth, length))
        new = shared < length
        new[0] = True
        found[rows[order]] = nodes + np.cumsum(new) - 1
        nodes += int(new.sum())
    return found


def classes(bodies: list[bytes], windows: np.ndarray, length: int = LENGTH):
    numbers: dict[bytes, int] = {}
    split = [x.split(b" ") for x in bodies]
    words = np.array([numbers.setdefault(w, len(numbers)) for x in split for w in x], np.uint32)
    sizes = np.array([len(x) for x in split])
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    suffixes = np.lib.stride_tricks.sliding_window_view(words, length)[starts]
    return deep_nodes(suffixes, length), lambda s, at: b" ".join(split[s][at : at + length])


#: Bytes of a text hashed at once, words joined at once: what a task holds beside a text does not grow with its length
#: but for the places of its words.
BLOCK, WORDS_AT_ONCE = 1 << 17, 4096
#: Not the six characters between words, which bytes.split() takes for blanks too.
INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end, in bytes."""
    edges, within = [np.zeros(0, np.int64)], False
    for at in range(0, len(text), BLOCK):
        inside = INSIDE[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)]
        if inside[0] != within:
            edges.append(np.array([at]))
        edges.append(np.flatnonzero(inside[1:] != inside[:-1]) + (at + 1))
        within = inside[-1]
    if within:
        edges.append(np.array([len(text)]))
    found = np.concatenate(edges)
    return found[::2], found[1::2]


def _hashes(text: bytes) -> np.ndarray:
    """A hash of each word: differences of the sums of weighted bytes at its ends, for a block of bytes at once.

    Of a word that goes on in the next block the sum and the number of bytes so far are carried there.
    """
    out, carried, size = [np.zeros(0, np.uint64)], 0, 0
    up, down = powers(BLOCK)
    for at in range(0, len(text), BLOCK):
        data = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = INSIDE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(OF_BYTE[data] * up[: len(data)], out=sums[1:])
        value, length = (sums[end] - sums[start]) * down[start], (end - start).astype(np.uint64)
        if size and inside[1]:
            value[0] = (carried + pow(BASE, size, 1 << 64) * int(value[0])) % (1 << 64)
            length[0] += np.uint64(size)
        elif size:
            value, length = np.r_[np.uint64(carried), value], np.r_[np.uint64(size), length]
        size = 0
        if inside[-2]:
            carried, size = int(value[-1]), int(length[-1])
            value, length = value[:-1], length[:-1]
        out.append(mix(value + length))
    if size:
        out.append(mix(np.array([carried], np.uint64) + np.uint64(size)))
    return np.concatenate(out)


def _cut(text: bytes):
    starts, ends = bounds(text)
    return lambda first, number: b" ".join(text[starts[first] : ends[first + number - 1]].split())


def left_over(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: list[tuple[int, int]]) -> Iterator[bytes]:
    """The words left, joined by one blank, in pieces."""
    at, mark = 0, b""
    for lo, hi in [*gone, (len(starts), len(starts))]:
        for first in range(at, lo, WORDS_AT_ONCE):
            yield mark + b" ".join(text[starts[first] : ends[min(lo, first + WORDS_AT_ONCE) - 1]].split())
            mark = b" "
        at = hi


WORDS = Kind(LENGTH, CORE, _hashes, _cut, classes)


def without_repeats(spark: SparkSession, docs: DataFrame, kept: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256, and with `kept` the words left as a text.

    Words are unchanged and joined by one blank. Null and empty texts have no words, texts of fewer words than a
    window lose none. Of a repeated passage every occurrence goes. Repeated rows are repeats of each other. An empty
    table gives no rows. Nothing is chosen among ties. Columns other than doc_id and text are not looked at.
    """
    docs = identified(docs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if kept else "")
    kinds = [pa.int64()] * 3 + [pa.string(), pa.string()][: 1 + kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for doc_id, z, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text, gone, digest, parts = unpress.decompress(z), merged(spans), hashlib.sha256(), []
                starts, ends = bounds(text)
                for part in left_over(text, starts, ends, gone):
                    digest.update(part)
                    if kept:
                        parts.append(part)
                rows.append((doc_id, len(starts), sum(hi - lo for lo, hi in gone), digest.hexdigest(), b"".join(parts).decode("utf-8", "surrogatepass"))[: 4 + kept])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return with_spans(docs, repeated_spans(spark, docs, WORDS)).mapInArrow(run, schema)


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words that repeated windows cover; see without_repeats."""
    return without_repeats(spark, table(spark, sf_dir, "documents"))
