"""Batches of questions against passages by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.schema import DEFAULT, Config, catalogue

REFUSAL = "The knowledge base does not cover this."
CITATION = r"\[([^\[\]]{3,120}?\.md)\]"
#: Questions taken at once: bytes of their vectors.
BLOCK_BYTES = 64 << 20
#: Similarities that a task holds at once.
SCORES_AT_ONCE = 4 << 20


def cosine(a: Column, b: Column) -> Column:
    """For pairs already joined; 0 where a vector is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, F.lit(1e-9)).otherwise(norm)


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.min_max(pc.list_value_length(vectors))
    if lengths["min"] != lengths["max"]:
        raise ValueError("vectors must all have one length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), lengths["max"].as_py() or 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k greatest scores, then their ids; equal scores by the smaller id. ids: in the shape of scores."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(
    questions: DataFrame, passages: DataFrame, k: int = DEFAULT.top_k, floor: float | None = DEFAULT.least_similarity,
    block_bytes: int = BLOCK_BYTES, scores_at_once: int = SCORES_AT_ONCE,
) -> DataFrame:
    """qid, rank, id, similarity: the k nearest passages, then those of at least `floor`.

    The questions, in blocks of a checked size, go to where the passages are as one matrix. A task compares them with a
    few passages at a time, so that no more than `scores_at_once` similarities are held, and keeps k a question: the
    shuffle carries those of each task. Rows without an id or a vector are near nothing.
    """
    spark = questions.sparkSession
    questions = questions.filter(F.col("qid").isNotNull() & F.col("embedding").isNotNull())
    size = questions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-size.n * size.d * 8 // block_bytes))
    near = None
    for block in range(blocks):
        some = questions if blocks == 1 else questions.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        rows = some.select(F.col("qid").cast("long"), "embedding").toArrow()
        shared = spark.sparkContext.broadcast((rows["qid"].to_numpy(), matrix(rows["embedding"])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            if not len(qids):
                return
            norms = np.linalg.norm(q, axis=1)
            held = np.empty((len(qids), 0)), np.empty((len(qids), 0), np.int64)
            step = max(1, scores_at_once // len(qids))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    p = matrix(piece.column(1))
                    by = norms[:, None] * np.linalg.norm(p, axis=1)[None, :]
                    score = (q @ p.T) / np.where(by == 0, 1e-9, by)
                    ids = np.broadcast_to(piece.column(0).to_numpy(), score.shape)
                    found = best(score, ids, k)
                    held = best(*(np.concatenate(x, axis=1) for x in zip(held, found, strict=True)), k)
            if most := held[0].shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, most)), pa.array(held[1].ravel()), pa.array(held[0].ravel())], ["qid", "id", "score"])

        some = passages.select(F.col("id").cast("long").alias("id"), "embedding").filter(F.col("id").isNotNull() & F.col("embedding").isNotNull())
        found = some.mapInArrow(run, "qid long, id long, score double")
        near = found if near is None else near.unionByName(found)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    ranked = ranked if floor is None else ranked.filter(F.col("score") >= floor)
    return ranked.select("qid", "rank", "id", F.round("score", 3).alias("similarity"))


def answered(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, answered, answer: the fixed refusal where nothing was found, else null for the writer to fill."""
    some = hits.select(F.col("qid").alias("_qid")).distinct()
    out = questions.join(some, F.col("qid") == F.col("_qid"), "left")
    return out.select("qid", F.col("_qid").isNotNull().alias("answered"), F.when(F.col("_qid").isNull(), F.lit(REFUSAL)).alias("answer"))


def runbook_queries(incidents: DataFrame) -> DataFrame:
    """scope, inc_idx, query: technique ids with names; incidents without techniques have none."""
    known = F.broadcast(catalogue(incidents.sparkSession).select("technique", "name"))
    named = incidents.select("scope", "inc_idx", F.posexplode("techniques").alias("at", "technique")).join(known, "technique", "left")
    text = F.concat_ws(" ", "technique", "name")
    names = named.groupBy("scope", "inc_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]).alias("names"))
    return names.select("scope", "inc_idx", F.concat(F.lit("incident response for "), F.array_join("names", ", ")).alias("query"))


def clipped(content: Column, most: int = DEFAULT.passage_chars) -> Column:
    """At most `most` characters, back to the last blank, with an ellipsis."""
    cut = F.substring(content, 1, most)
    last = F.when(cut.contains(" "), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(content) > most, F.concat(last, F.lit(" …"))).otherwise(content)


def formatted(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """qid, block: the hits' passages in order of rank, each under its label. hits: qid, rank, source, heading, content."""
    label = F.concat(F.lit("["), "source", F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" — "), "heading")).otherwise(F.lit("")), F.lit("]\n"), clipped(F.col("content"), config.passage_chars))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))


def invented_citations(answer: Column, sources: Column) -> Column:
    """Cited file names, sorted, that are not among the sources."""
    allowed = F.transform(sources, lambda s: F.lower(s))
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda c: ~F.array_contains(allowed, F.lower(c)))))
