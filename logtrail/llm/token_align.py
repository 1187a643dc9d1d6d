"""Alignment of two tokenizers' tokens by the bytes at which they end.

A worker encodes texts with both tokenizers and merges the cumulative ends of their tokens, two rising runs, by two
pointers: where both sides end, a group closes and a link is emitted. Spark counts id pairs over the corpus, takes the
highest count of each side's ids and joins both back to the links.

Neither tokenizer joins anything across a blank that follows another character, so texts are cut there into stretches,
mostly a word each. A worker encodes and merges new ones together, a text made of them, and keeps what each came to: the
result is that of whole texts (tested).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import ROWS_AT_ONCE, materialize, table
from logtrail.llm.packing import tokenizer_file

#: A blank with white space and other characters after it, up to a blank that follows another character.
STRETCH = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: Stretches, and characters of them, that a worker keeps; beyond either the store starts anew.
STRETCHES_KEPT, CHARS_KEPT = 500_000, 10_000_000
#: Characters that are encoded at once, about.
AT_ONCE = 100_000
#: Fixed value: how byte-level vocabularies of this kind split texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of ids up to which counts are broadcast (32 bytes each); more are joined by a shuffle.
PAIRS_BROADCAST = 2_000_000
#: A pair of ids as one number.
B_BITS = 20
ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have; both rise strictly.

    A stable sort of two runs, each in order, walks them by two pointers; an end of both stands there twice in a row.
    """
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    twice = np.flatnonzero(ends[1:] == ends[:-1])
    return order[twice], order[twice + 1] - len(a)


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(prints)]
    return {chr(x): x for x in prints} | {chr(256 + i): x for i, x in enumerate(others)}


class ByteLevel:
    """Ids of a byte-level vocabulary of the `tokenizers` format.

    If it is of the common kind (blanks kept, merges in the order of their ids) its table serves the quicker encoder of
    tiktoken, which gives the same ids (tested); other vocabularies take their own library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        decode = byte_of()
        self.bytes = [bytes(decode[c] for c in self.own.id_to_token(i)) for i in range(self.own.get_vocab_size())]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.quick = self._quick(told) if self._common(told) else None

    @staticmethod
    def _common(told: dict) -> bool:
        kind, vocab = told["pre_tokenizer"] or {}, told["model"]["vocab"]
        merges = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        plain = told["normalizer"] is None and not told["model"].get("dropout") and not told["model"].get("ignore_merges")
        return plain and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and merges == sorted(merges)

    def _quick(self, told: dict):
        import tiktoken

        special = {x["id"] for x in told["added_tokens"]}
        ranks = {self.bytes[i]: i for i in told["model"]["vocab"].values() if i not in special}
        return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.quick.encode_ordinary(text) if self.quick else self.own.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a piece vocabulary, which sets a blank before a text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(self.own.id_to_piece(i)) for i in range(self.own.get_piece_size())]
        self.blank = self.own.piece_to_id("▁")

    @staticmethod
    def _bytes(piece: str) -> bytes:
        found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a blank: the one that is set by itself, but not before nothing."""
        return self.own.encode(text[1:]) if text != " " else [self.blank]


class Side:
    """A tokenizer with the length of each id in bytes, and each id as text, before `,` and before what ends a group."""

    def __init__(self, own: ByteLevel | Pieces, end: str) -> None:
        self.encode, self.bytes = own.encode, own.bytes
        self.sizes = np.array([len(x) for x in own.bytes], np.int64)
        if not self.sizes.all():
            raise ValueError("a vocabulary with empty tokens cannot be aligned")
        self.told = np.array([*(f"{i}," for i in range(len(own.bytes))), *(f"{i}{end}" for i in range(len(own.bytes)))], object)

    def ids(self, text: str, whole: bytes) -> np.ndarray | None:
        """Null where the bytes of the ids are not the text's own."""
        found = self.encode(text)
        return np.array(found, np.int64) if b"".join([self.bytes[i] for i in found]) == whole else None


def rows_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Rising:
    """Rows of integers to which more are added; space doubles."""

    def __init__(self, width: int) -> None:
        self.n, self.held = 0, np.zeros((1024, width), np.int64)

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """Merges stretches of text and keeps of each: how many tokens, groups and links, its groups as text, its links."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Side(ByteLevel(a_path), "|"), Side(Pieces(b_path), ";")
        self.clear()

    def clear(self) -> None:
        self.store: dict[str, int] = {}
        self.chars, self.told = 0, []
        #: n_a, n_b, n_groups, n_links, whether it has no tokens, where its links begin; all links
        self.sizes, self.links = Rising(6), Rising(1)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs and how often each is linked, for each text."""
        cut = [STRETCH.findall(" " + t) if t else [] for t in texts]
        if new := set().union(*cut).difference(self.store):
            if len(self.store) + len(new) > STRETCHES_KEPT or self.chars > CHARS_KEPT:
                self.clear()
                new = set().union(*cut)
            self.learn(list(new))
        return [self._align(stretches) for stretches in cut]

    def _align(self, stretches: list[str]) -> tuple:
        at = np.fromiter(map(self.store.__getitem__, stretches), np.int64, len(stretches))
        sizes = self.sizes.held[at]
        n_a, n_b, n_groups, n_links, bad, _ = sizes.sum(axis=0).tolist()
        if bad or not n_a:
            return 0, 0, 0, 0, "", [], []
        pairs, times = np.unique(self.links.held[rows_of(sizes[:, 5], sizes[:, 3]), 0], return_counts=True)
        told = "".join(map(self.told.__getitem__, at.tolist()))[:-1]
        return n_a, n_b, n_groups, n_links, hashlib.sha256(told.encode()).hexdigest(), pairs, times

    def learn(self, stretches: list[str]) -> None:
        """All together; one with white space at its end, which the next could join, by itself."""
        lot, size = [], 0
        for s in stretches:
            if s[-1].isspace():
                self._learn([s])
                continue
            lot.append(s)
            size += len(s)
            if size > AT_ONCE:
                self._learn(lot)
                lot, size = [], 0
        if lot:
            self._learn(lot)

    def _learn(self, lot: list[str]) -> None:
        text = "".join(lot)
        whole = text.encode("utf-8", "surrogatepass")
        ends = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in lot])
        a, b = self.a.ids(text, whole), self.b.ids(text, whole)
        if a is None or b is None:
            if len(lot) > 1:  # some have bytes that are not given back
                self._learn(lot[: len(lot) // 2])
                self._learn(lot[len(lot) // 2 :])
            else:
                self._keep(lot, np.array([[0, 0, 0, 0, 1]]), [""], np.zeros(0, np.int64))
            return
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        at_a, at_b = merge_ends(ends_a, ends_b)
        upto = [np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, ends_a[at_a])]
        sizes = np.stack([np.diff(x, prepend=0) for x in upto], axis=1)
        told, cuts = self.groups(a, b, at_a, at_b), (upto[0] + upto[1]).tolist()
        self._keep(lot, np.column_stack([sizes, sizes[:, 2], np.zeros(len(lot), np.int64)]), ["".join(told[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)], (a[at_a] << B_BITS) | b[at_b])

    def _keep(self, lot: list[str], sizes: np.ndarray, told: list[str], links: np.ndarray) -> None:
        self.store.update(zip(lot, range(len(self.told), len(self.told) + len(lot)), strict=True))
        self.chars += sum(map(len, lot))
        self.told += told
        self.sizes.add(np.column_stack([sizes, self.links.n + np.cumsum(sizes[:, 3]) - sizes[:, 3]]))
        self.links.add(links[:, None])

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
        """a1,a2|b1;a3|b2,b3; by ids: within a group those of a, then those of b."""
        out = np.empty(len(a) + len(b), object)
        group_a = np.searchsorted(at_a, np.arange(len(a)), "left")  # how many groups are closed before each token
        group_b = np.searchsorted(at_b, np.arange(len(b)), "left")
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = len(self.a.sizes), len(self.b.sizes)
        out[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = self.a.told[a + last_a]
        out[np.arange(len(b)) + at_a[group_b] + 1] = self.b.told[b + last_b]
        return out.tolist()


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each of docs (doc_id, text): sizes, digest, and its distinct id pairs with how often each is linked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a_path, b_path)
        for whole in frames:
            for i in range(0, len(whole), ROWS_AT_ONCE):
                frame = whole.iloc[i : i + ROWS_AT_ONCE]
                found = both.align([t if isinstance(t, str) else None for t in frame["text"]])
                names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pd.concat([frame[["doc_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInPandas(run, ENCODED)


def counted(links: DataFrame) -> DataFrame:
    """pair, count, best_a, best_b of links (pair, times): corpus-wide count, and whether it is the highest of each side's id.

    Summed before the shuffle, so a pair in every text costs a row for each task. An end of both sides makes one side's
    token a suffix of the other's, so there are no more pairs than suffixes of the tokens in the vocabularies, about
    600,000 for the two used here, however large the corpus.
    """
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"))
    counts = counts.select("pair", "count", F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"))
    out = counts
    for side in "ab":
        most = counts.groupBy(side).agg(F.max("count").alias(f"_{side}"))
        out = out.join(most, side)
    return out.select("pair", "count", (F.col("count") == F.col("_a")).alias("best_a"), (F.col("count") == F.col("_b")).alias("best_b"))


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with sizes, digest and how their links stand in the corpus; and the table of pairs.

    Texts are encoded once and written. Rows are told apart by numbers of their own, so null or repeated ids do not
    matter; repeated rows count each. Null and empty texts, and those that a tokenizer does not give back byte for byte,
    have zeros and an empty digest. Other columns are left aside. An empty table gives two empty ones.
    """
    rows = materialize(spark, encoded(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", "l.pairs", "l.times").withColumnRenamed("pairs", "pair")
    pairs = materialize(spark, counted(links), "pairs")
    known = F.broadcast(pairs) if pairs.count() <= PAIRS_BROADCAST else pairs
    best = lambda side: F.sum(F.when(F.col(f"best_{side}"), F.col("times")).otherwise(F.lit(0))).alias("n_best" if side == "b" else "n_best_a")
    # the links of a row lie together, so they are summed to one row before the shuffle
    sums = links.join(known, "pair").groupBy("_row").agg(best("b"), F.sum(F.col("times") * F.col("count")).alias("count_sum"), best("a"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.drop("pairs", "times").join(sums, "_row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256", none("n_best_a")), pairs


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, byte-level tokens against pieces; see align."""
    return align(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))[0]
