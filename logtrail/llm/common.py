"""What the operators of this subpackage share: reading tables, shared scratch space and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed at once to Python code that works on whole texts; keeps a worker's memory small.
ROWS_AT_ONCE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/logtrail/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors, computes once."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """_row, a number of each row's own, and doc, the row as a struct, whatever its columns are named.

    Written, so that every reader sees the same numbers.
    """
    row = F.struct(*(df[f"`{c}`"].alias(c) for c in df.columns)).alias("doc")
    return materialize(spark, df.select(F.monotonically_increasing_id().alias("_row"), row), name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_batches(df: DataFrame, of: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """mapInArrow over small slices of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, rows):
            yield of(piece)

    return df.mapInArrow(run, schema)
