"""Best-fit packing by minimum bin slack over counts of lengths.

Documents become token ids (an end id after each), longer ones are cut into pieces of the sequence length.
Only the number of pieces of each length, at most one count for each length up to the capacity, goes to the
driver. There a bitset dynamic programme over the lengths still available finds the combination that leaves the
least slack beside the largest remaining piece; it is taken as often as the counts allow and then removed. The
plan says which ranks among the pieces of a length go to which sequences, and tasks place their pieces by it.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtrail.llm.common import map_batches, materialize, slices, table

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps; beyond it the store starts anew.
WORDS_KEPT = 1_000_000
#: Pieces of one length that one task numbers, about.
PIECES_A_BUCKET = 50_000
#: Characters for which blanks separate words and lower-casing changes neither length nor composition.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: How the vocabulary splits a lower-cased plain word.
RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def encoder(path: str):
    """A function from texts to ids as bytes, unsigned 32-bit little-endian.

    The vocabulary lower-cases, drops white space, never joins across it and splits words into runs of letters, single
    digits and runs of other signs, each encoded by itself and closed by a token of its own kind. So a plain text's ids
    are those of its words in turn, and a word's those of its runs. Words and runs seen before come from a store; new
    runs are encoded together, and cut apart after their closing tokens. Any other text is encoded whole.
    """
    from tokenizers import Tokenizer

    tokenizer, store = Tokenizer.from_file(path), {}
    closing = np.zeros(tokenizer.get_vocab_size(), bool)
    closing[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    ids_of = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(words: list[str]) -> None:
        runs = {word: RUN.findall(word) for word in words}
        new = list({x for found in runs.values() for x in found}.difference(store))
        for i in range(0, len(new), 1000):
            ids, some = ids_of(" ".join(new[i : i + 1000])), new[i : i + 1000]
            ends = np.flatnonzero(closing[ids]) + 1
            if len(ends) != len(some):  # not so in this vocabulary
                store.update((x, ids_of(x).tobytes()) for x in some)
                continue
            whole, ends = ids.tobytes(), (4 * ends).tolist()
            store.update((x, whole[lo:hi]) for x, lo, hi in zip(some, [0, *ends], ends, strict=False))
        store.update((word, b"".join(map(store.__getitem__, found))) for word, found in runs.items())

    def encode(texts: list[str]) -> list[bytes]:
        split = [text.lower().split() if "<|" not in text and PLAIN.fullmatch(text) else None for text in texts]
        words = set().union(*(x for x in split if x))
        if new := words.difference(store):
            if len(store) + len(new) > WORDS_KEPT:
                store.clear()
                new = words
            gc.disable()  # many small lists and no cycles
            learn(list(new))
            gc.enable()
        return [ids_of(text).tobytes() if x is None else b"".join(map(store.__getitem__, x)) for text, x in zip(texts, split, strict=True)]

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document. Null and empty texts are the end id alone."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, end, rows = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), []
        for doc_id, found in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
            ids = memoryview(found + end)
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), of, PIECES)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """{length: copies} whose sum is the largest that is at most `room`. Bit s of `sums`: a sum of s can be had."""
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:  # copies in groups of 1, 2, 4 ...
            size = min(size, left)
            steps.append((length, size, sums))
            sums |= (sums << (length * size)) & mask
            left, size = left - size, size * 2
        if sums >> room:
            break
    best, out = sums.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> best & 1:
            out[length] = out.get(length, 0) + size
            best -= length * size
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset), and the number of sequences."""
    left, used, runs, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    for length in sorted(counts, reverse=True):
        while left[length]:
            left[length] -= 1
            taken = fullest(capacity - length, left)
            left[length] += 1
            taken[length] = taken.get(length, 0) + 1
            times, offset = min(left[x] // n for x, n in taken.items()), 0
            for x, n in sorted(taken.items(), reverse=True):
                for _ in range(n):
                    runs.append((x, used[x], times, sequences, offset))
                    used[x] += times
                    offset += x
                left[x] -= n * times
            sequences += times
    return runs, sequences


def place(numbered: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Looks up each piece's sequence and offset by its length and its rank among pieces of that length."""
    table_ = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table_[:, 0] << 48) + table_[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            sequence = table_[at, 3] + rank - table_[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table_[at, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(spark: SparkSession, found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; found is written once and read for counting, numbering and placing.

    Pieces of a length are numbered within buckets of a hash, offsets added, so that no length, however frequent,
    meets in one task. Repeated rows are pieces of their own. An empty table gives no rows.
    """
    found = materialize(spark, found, "pieces")
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    if not counts:
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    buckets = max(8, -(-sum(counts.values()) // PIECES_A_BUCKET))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    each = dealt.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    numbered = dealt.withColumn("own", own).join(each, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    return place(numbered, plan(counts, capacity)[0])


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there; see pieces and pack."""
    return pack(spark, pieces(table(spark, sf_dir, "documents"), tokenizer_file()))
