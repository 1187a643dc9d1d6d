"""A corpus cleaned and packed for training, stage by stage.

Each stage takes all rows that the one before kept, written as Parquet and read again, and returns the columns of
documents; the last returns the placed pieces. Learned and tokenised results have no SQL form: see tests/llm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from logtrail.llm.common import materialize, numbered, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's score does not call toxic; fitted on labelled rows that are not held out.

    Null and empty texts stay, as does everything where there are no labels; an empty table stays empty.
    """
    return toxicity.reject(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of repeated windows; a document of which no word is left goes. n_chars, if there, follows the text.

    Null, empty and short texts stay as they are; repeated rows are later occurrences. Other columns, whatever their
    names, are carried along as one. An empty table stays empty.
    """
    rest = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns if c != "text")).alias("_rest")
    out = line_dedup.dedup(spark, docs.select("doc_id", "text", rest))
    changed = F.col("n_removed") > 0
    out = out.filter(~(changed & (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) == "")))

    def column(name: str, kind: str) -> Column:
        own = F.col("_rest")[name] if name != "text" else F.col("text")
        return (F.when(changed, F.length("text").cast(kind)).otherwise(own) if name == "n_chars" else own).alias(name)

    return out.select(*(column(*c) for c in docs.dtypes))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, one row: that of the smallest doc_id, of one without an id only if none has.

    Rows are joined and dropped by numbers of their own, so those that share an id, or have none, are judged each by
    its own text.
    """
    rows = numbered(spark, docs, "near-rows")
    linked = jaccard.join(spark, rows.select(F.col("_row").alias("doc_id"), F.col("doc")["text"].alias("text"))).filter("n_links > 0")
    linked = materialize(spark, linked.select(F.col("doc_id").alias("_row"), F.col("class_id").alias("_class")), "near-links")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = linked.join(rows.select("_row", F.col("doc")["doc_id"].alias("doc_id")), "_row").groupBy("_class").agg(F.min(order)["_row"].alias("_row"))
    copies = linked.join(first.select("_row"), "_row", "left_anti").select("_row")
    return rows.join(copies, "_row", "left_anti").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a window of a benchmark item.

    Null and empty texts stay, as does everything where there are no items; rows that share an id are judged each by its
    own text, other columns stay as they are, an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there; null and empty texts are the end id alone.

    Only doc_id and text count, whatever other columns there are; an empty table gives no rows.
    """
    return packing.pack(spark, packing.pieces(docs, packing.tokenizer_file()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
