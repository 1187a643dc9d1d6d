"""A folder that driver and executors share, for what is written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if the master is local, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/logtrail/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of the shared folder: computed once for all that reads it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a narrow table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """A narrow table, written before, with a hint to broadcast it if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def in_sequence(df: DataFrame, order: list, number: str) -> DataFrame:
    """df, sorted, with a column of numbers 0, 1, 2 ... in that order.

    One sort by ranges, written; rows are numbered within their range, and ranges by the counts before them, of which
    there is one for each task: no row is moved to a single one.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = written(df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_own": own}), "sequence")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(counts), "_range").withColumn(number, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
