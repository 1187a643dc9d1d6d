"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles; documents of one set are one class. Sets are embedded in `COORDS` minimal
hashes, two of which agree as often as the sets are similar. A run starts with all classes in one bucket and splits
buckets recursively: every class goes to the children of a few of its own tokens (coordinate and value), sampled by a
hash of path and token, so that similar sets follow common paths. Buckets that are small are compared by brute force
on the sketches; larger ones are split on, to a depth. `runs` repeats bring the chance that a pair of the least
similarity meets to `RECALL`. What meets and looks similar is a candidate group; within each, all pairs are compared on
their whole sets, in blocks, so that the result is exact for every pair of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize, slices, table
from logtrail.llm.components import components
from logtrail.llm.decontaminate import normal
from logtrail.llm.repeats import mix, zipped

WORDS, SIMILAR, RECALL = 5, 0.8, 0.9995
COORDS, DEPTH = 128, 2
#: Children that a class goes to at each split, about, for one that it shares with a class of the least similarity.
BRANCHING = 1.5
#: Classes in a bucket that is compared, at most; in a block of a candidate group.
LEAF, BLOCK = 256, 512
#: Members of candidate groups that are broadcast to the texts at most: rows of 40 bytes.
MEMBERS = 200_000
#: Coordinates that agree in a candidate pair: five deviations below the least similarity.
AGREE = math.floor(COORDS * (SIMILAR - 5 * math.sqrt(SIMILAR * (1 - SIMILAR) / COORDS)))
MULTIPLY = (mix(np.arange(1, COORDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
FLIP = (mix(np.arange(1001, COORDS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
COORD = np.arange(COORDS, dtype=np.uint64) << np.uint64(40)
#: A token is chosen where its hash is below this.
CHOSEN = np.uint64(int(BRANCHING / SIMILAR / COORDS * 2**64))


def runs(depth: int = DEPTH, recall: float = RECALL) -> int:
    """Repeats after which a pair of the least similarity has met with this chance, at the greatest depth."""
    meets = 1.0
    for _ in range(depth):  # the shared tokens chosen are Poisson, BRANCHING on average
        meets = 1 - math.exp(-BRANCHING * meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


RUNS = runs()


@lru_cache(maxsize=200_000)
def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of n consecutive words; of fewer words all together, of none nothing."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - n + 1 + i]
    return np.unique(mix(out))


def sketch(found: np.ndarray) -> np.ndarray:
    """The minimum of each of COORDS hash functions over the set."""
    x, least = (found >> np.uint64(32)).astype(np.uint32), np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, ((x[i : i + 2048, None] ^ FLIP) * MULTIPLY).min(axis=0))
    return least


def children(paths: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The paths that continue each path by the tokens that its class chooses there. values: row of the sketch."""
    tokens = mix(COORD + values.astype(np.uint64) + np.uint64(1))
    hashes = mix(paths[:, None] * np.uint64(0xD6E8FEB86659FD93) + tokens)
    taken = hashes < CHOSEN
    return [mix(hashes[i, taken[i]] + np.uint64(1)) for i in range(len(paths))]


STARTS = mix(np.arange(7, RUNS + 7, dtype=np.uint64))


def set_hash(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets(docs: DataFrame) -> DataFrame:
    """For each document its rid, node (hash of its set, null without words), first paths of each run, and 8-bit sketch."""
    schema = "doc_id long, rid long, node long, paths array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, paths, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(normal(text))
                if not len(found):
                    nodes.append(None), paths.append([]), sketches.append(b"")
                    continue
                nodes.append(set_hash(found))
                least = sketch(found)
                paths.append(np.concatenate(children(STARTS, least)).view(np.int64))
                sketches.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "node", "paths", "sketch"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, schema)


def split(rows: DataFrame) -> DataFrame:
    """The children of each (path, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            nodes, paths = [], []
            for path, node, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = children(np.array([path], np.int64).view(np.uint64), np.frombuffer(values, np.uint8))[0].view(np.int64)
                paths.append(more)
                nodes += [node] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths) if paths else [], pa.int64()), pa.array(nodes, pa.int64())], ["path", "node"])

    return rows.select("path", "node", "sketch").mapInArrow(run, "path long, node long")


def buckets(spark: SparkSession, classes: DataFrame, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """path, node and size of the buckets of two classes or more that are small, or as deep as they go."""
    rows = classes.select(F.explode("paths").alias("path"), "node")
    small = None
    for level in range(1, depth + 1):
        rows = materialize(spark, rows, "paths")
        size = materialize(spark, rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        rows = materialize(spark, rows.join(size, "path"), "buckets")
        here = rows if level == depth else rows.filter(F.col("size") <= leaf)
        small = here if small is None else small.unionByName(here)
        if level == depth or not rows.filter(F.col("size") > leaf).limit(1).count():
            return small
        rows = split(rows.filter(F.col("size") > leaf).join(classes.select("node", "sketch"), "node"))
    return small


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about so many rows, from batches sorted by the keys."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < rows:
            continue
        same = np.ones(held.num_rows, bool)
        for k in keys:
            column = held.column(k).to_numpy()
            same &= column == column[-1]
        end = held.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if end:
            yield held.slice(0, end)
            held = held.slice(end)
    if held is not None and held.num_rows:
        yield held


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        column = t.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each one's component, for edges between places."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, np.maximum(x, y), low)
        root = root[root]
        moved = root[a] != root[b]
        a, b = a[moved], b[moved]
    while (root != root[root]).any():
        root = root[root]
    return root


def alike(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (u, v) that span what looks similar in each bucket of (keys, node, sketch, side, root).

    Within a bucket of one side (side 0 everywhere) all pairs are compared, else those of side 0 with side 1; in either
    case only where their roots differ, as others are known to be of one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches, keys, 8192):
            starts = _starts(t, keys)
            nodes, side, group = (t.column(c).to_numpy() for c in ("node", "side", "root"))
            values = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
            pairs = []
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if (group[lo:hi] == group[lo]).all():
                    continue
                two = side[lo:hi].any()
                for i in range(lo, hi - 1):
                    apart = group[i + 1 : hi] != group[i]
                    others = i + 1 + np.flatnonzero(apart & (side[i + 1 : hi] != side[i]) if two else apart)
                    if len(others) > 16:  # many at once here, few in one go below
                        others = others[(values[others] == values[i]).sum(axis=1) >= AGREE]
                    pairs.append((np.full(len(others), i), others))
            if not pairs:
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            near = np.concatenate([(values[a[i : i + 65536]] == values[b[i : i + 65536]]).sum(axis=1) >= AGREE for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            root = _roots(len(nodes), a[near], b[near])
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["u", "v"])

    return bucketed.select(*keys, "node", "side", "root", "sketch").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "u long, v long")


def candidates(spark: SparkSession, classes: DataFrame, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """node and root of the candidate groups.

    A bucket that stays large at the greatest depth, mostly copies of one text, is first compared in parts of bounded
    size, dealt anew for each path. If its members do not all come to one group by this, those outside its
    largest group are then compared with all other parts too.
    """
    found = materialize(spark, buckets(spark, classes, leaf, depth), "leaves")
    parts = F.ceil(F.col("size") / leaf)
    part = F.pmod(F.xxhash64("path", "node"), parts).cast("int")
    first = found.withColumn("part", part).join(classes.select("node", "sketch"), "node").withColumn("side", F.lit(0)).withColumn("root", F.col("node"))
    edges = materialize(spark, alike(first, ["path", "part"]).distinct(), "edges")
    groups = materialize(spark, components(spark, edges), "groups")
    large = found.filter(F.col("size") > leaf)
    if not large.limit(1).count():
        return groups
    large = large.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = large.groupBy("path").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("path")
    open_ = materialize(spark, large.join(mixed, "path").withColumn("part", part).withColumn("parts", parts), "mixed")
    if not open_.limit(1).count():
        return groups
    # links between groups concern a class outside its bucket's largest group: those alone go to all other parts
    biggest = open_.groupBy("path", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.max_by("root", F.struct("n", "root")).alias("biggest"))
    outside = open_.join(materialize(spark, biggest, "biggest"), "path").filter("root <> biggest")
    copies = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).filter("other <> part")
    blocks = open_.select("path", "part", "node", "root", F.lit(0).alias("side")).unionByName(copies.select("path", F.col("other").alias("part"), "node", "root", F.lit(1).alias("side")))
    more = alike(blocks.join(classes.select("node", "sketch"), "node"), ["path", "part"])
    return materialize(spark, components(spark, groups.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "groups")


def in_blocks(rows: DataFrame, key: str, parts: str) -> DataFrame:
    """rows dealt into `parts` parts of their key, and each part beside each other: lo, hi, and side, 1 for part hi."""
    part = F.pmod(F.xxhash64("node", key), F.col(parts)).cast("int")
    out = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    return out.withColumns({"lo": lo, "hi": hi, "side": (F.col("part") > F.col("other")).cast("int")}).drop("part", "other")


def common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each of a has in common with each of b (of a, where b is None)."""
    every = a if b is None else [*a, *b]
    sizes = np.array([len(x) for x in every])
    tokens, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)[1:]
    shared = count[tokens] > 1  # others are in one set only
    column = np.cumsum(count > 1) - 1
    rows, columns = np.repeat(np.arange(len(every)), sizes)[shared], column[tokens[shared]]
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    out = np.zeros((len(a), len(a if b is None else b)), np.float32)
    width = max(256, (1 << 21) // len(every))
    for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        i, j = np.searchsorted(columns, [lo, lo + width])
        has = np.zeros((len(every), width), np.float32)
        has[rows[i:j], columns[i:j] - lo] = 1
        out += has[: len(a)] @ (has if b is None else has[len(a) :]).T
    return out


def _told(node: np.ndarray, n: np.ndarray, both: np.ndarray, sizes: np.ndarray, a: list[int], b: list[int] | None, similar: float, whole: bool) -> pa.RecordBatch:
    """node, links, docs, other, whole of those linked. both: shingles in common of a with b (with a, if b is None)."""
    union = sizes[a][:, None] + sizes[b or a][None, :] - both
    linked = 100 * both >= round(100 * similar) * union
    if b is None:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    root = _roots(len(a) + len(b or ()), i, j + (len(a) if b else 0))
    order = np.array(a + (b or []), np.int64)
    links = np.r_[linked.sum(1), linked.sum(0) if b else []].astype(np.int64)
    docs = np.r_[linked @ n[b or a], n[a] @ linked if b else []].astype(np.int64)
    some = links > 0
    columns = [pa.array(x[some]) for x in (node[order], links, docs, node[order][root])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(some.sum(), whole), pa.bool_())], ["node", "links", "docs", "other", "whole"])


LINKS = "node long, links long, docs long, other long, whole boolean"


def compared(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Of whole groups (root, node, n, z): node, its other classes and their documents, and the node it hangs from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for t in _stretches(batches, ["root"], BLOCK):
            starts = _starts(t, ["root"])
            node, n, z = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "z"))
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                found = {}
                for i in range(lo, hi):  # equal rows come once each; the set that has the hash is the class's
                    if int(node[i]) not in found:
                        x = shingles(normal(unpress.decompress(z[i]).decode("utf-8", "surrogatepass")))
                        if len(x) and set_hash(x) == node[i]:
                            found[int(node[i])] = (i, x)
                at, of = [i for i, _ in found.values()], [x for _, x in found.values()]
                if len(at) < 2:
                    continue
                sizes = np.zeros(t.num_rows, np.int64)
                sizes[at] = [len(x) for x in of]
                yield _told(node, n, common(of, None).astype(np.int64), sizes, at, None, similar, True)

    return rows.select("root", "node", "n", "z").repartition("root").sortWithinPartitions("root").mapInArrow(run, LINKS)


def differences(rows: DataFrame) -> DataFrame:
    """root, node, n, number of shingles of root and node, and those that root alone (gone) or node alone (new) has.

    Members of a large group are alike, so this is far less than their texts.
    """
    schema = "root long, node long, n long, root_size long, node_size long, gone binary, new binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, last = zstandard.ZstdDecompressor(), (None, None)
        of = lambda z: shingles(normal(unpress.decompress(z).decode("utf-8", "surrogatepass")))
        for batch in slices(batches):
            out = []
            for root, node, n, z, root_z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != (root, len(root_z)):
                    last = ((root, len(root_z)), of(root_z))
                x, base = of(z), last[1]
                if len(x) and set_hash(x) == node and set_hash(base) == root:
                    gone, new = np.setdiff1d(base, x, assume_unique=True), np.setdiff1d(x, base, assume_unique=True)
                    out.append((root, node, n, len(base), len(x), gone.tobytes(), new.tobytes()))
            if out:
                kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select("root", "node", "n", "z", "root_z").mapInArrow(run, schema)


def compared_in_blocks(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """As compared, of blocks (root, lo, hi, side) of differences; other is the node it hangs from within the block."""
    keys = ["root", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches, keys, 2 * BLOCK):
            starts, same = _starts(t, keys), (t.column("lo").to_numpy() == t.column("hi").to_numpy())
            node, n, side, sizes, root_size = (t.column(c).to_numpy() for c in ("node", "n", "side", "node_size", "root_size"))
            gone, new = ([np.frombuffer(x, np.uint64) for x in t.column(c).to_pylist()] for c in ("gone", "new"))
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                a = [i for i in range(lo, hi) if not side[i]]
                b = [i for i in range(lo, hi) if side[i]] or None
                if not a or (b is None and not same[lo]):
                    continue
                of = lambda x, at: None if at is None else [x[i] for i in at]
                missing = np.array([len(x) for x in gone])
                # a set is the root's without what is gone, and with what is new
                both = root_size[lo] - missing[a][:, None] - missing[b or a][None, :]
                both = both + common(of(gone, a), of(gone, b)).astype(np.int64) + common(of(new, a), of(new, b)).astype(np.int64)
                yield _told(node, n, both, sizes, a, b, similar, False)

    some = rows.select(*keys, "side", "node", "n", "node_size", "root_size", "gone", "new")
    return some.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, LINKS)


def links(spark: SparkSession, members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The links of candidate groups: members (root, size, node, n, rid), texts (rid, z).

    Groups of up to `block` classes meet in one place. Those of larger groups are each told by their differences from
    one member, made once, and only differences go to the blocks: as many copies of each as there are blocks.
    """
    def wide(some: DataFrame) -> DataFrame:
        few = some.limit(MEMBERS + 1).count() <= MEMBERS
        some = F.broadcast(some) if few else some
        return texts.withColumnRenamed("rid", "_rid").join(some, F.col("rid") == F.col("_rid")).drop("_rid", "rid")

    out = materialize(spark, compared(wide(members.filter(F.col("size") <= block))), "links")
    large = members.filter(F.col("size") > block)
    if not large.limit(1).count():
        return out
    many = materialize(spark, wide(large), "large-groups")
    roots = materialize(spark, many.filter("node = root").groupBy("root").agg(F.min("z").alias("root_z")), "large-roots")
    told = materialize(spark, differences(many.join(roots, "root")), "differences")
    told = told.dropDuplicates(["root", "node"])  # equal rows
    size = materialize(spark, told.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")), "parts")
    blocks = in_blocks(told.join(size, "root"), "root", "parts")
    return out.unionByName(materialize(spark, compared_in_blocks(blocks), "links"))


def join(spark: SparkSession, docs: DataFrame, leaf: int = LEAF, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """A row for each document: doc_id, copy_id, class_id, n_links, n_class_links.

    copy_id: the smallest doc_id with the same set; class_id: the smallest of all that links of the least similarity
    connect; n_links: other documents linked to it, copies counted; n_class_links: other sets. Null, empty and
    wordless texts are linked to nothing. Repeated rows are copies of each other. Rows with a null doc_id count as
    documents, and have a null class_id if all of theirs are null. A similarity of the least one exactly is a link.
    Texts are taken whole: a long one is one set, of 8 bytes a word. Other columns of docs, whatever their names, are
    not looked at. An empty table gives no rows.
    """
    doc_id = docs["doc_id"].cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, docs["text"]).alias("rid"), docs["text"])
    every = materialize(spark, sets(docs), "sets")
    classes = every.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("copy_id"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")
    )
    classes = materialize(spark, classes, "classes")
    groups = candidates(spark, classes, leaf, depth)
    size = materialize(spark, groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = materialize(spark, groups.join(size, "root").join(classes.select("node", "n", "rid"), "node"), "members")
    found = links(spark, members, zipped(docs, ["rid"]), block)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = found.filter("whole").select("node", F.col("other").alias("root"))
    spread = found.filter("NOT whole")
    if spread.limit(1).count():
        roots = roots.unionByName(components(spark, spread.select(F.col("node").alias("u"), F.col("other").alias("v"))))
    roots = materialize(spark, roots.join(classes.select("node", "copy_id"), "node"), "roots")
    least = materialize(spark, roots.groupBy("root").agg(F.min("copy_id").alias("class_id")), "least")
    linked = counts.join(roots.join(least, "root").select("node", "class_id"), "node")
    told = classes.select("node", "copy_id", "n").join(linked, "node", "left").filter("n > 1 OR links IS NOT NULL")
    told = materialize(spark, told.withColumnRenamed("node", "_node"), "told")
    out = every.select("doc_id", "node").join(told, F.col("node") == F.col("_node"), "left")
    alone, n_links = F.coalesce("copy_id", "doc_id"), F.coalesce(F.col("docs"), F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))
    return out.select(
        "doc_id", alone.alias("copy_id"), F.coalesce("class_id", alone).alias("class_id"),
        n_links.cast("long").alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_class_links"),
    )


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and number of links; see join."""
    return join(spark, table(spark, sf_dir, "documents"))
