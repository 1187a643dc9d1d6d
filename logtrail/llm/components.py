"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.llm.common import materialize


#: Edges that a task takes, about: small tables need no more tasks than this, whatever the shuffle partitions.
EDGES_A_TASK = 100_000


def _large(spark: SparkSession, edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join has two shuffles of its own and Spark can split a node of very many neighbours
    least = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).unionByName(least.select("u", F.col("m").alias("v")).coalesce(tasks))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for edges (u, v) of longs; nodes without an edge have no row.

    Each round is two grouped minima with a join, written to the shared folder; it ends when the edges, a star for
    each component by then, stay the same. Self loops and repeated edges do not matter.
    """
    edges = materialize(spark, edges.filter("u <> v").distinct(), "edges")
    last = None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(told) == last or not told[0]:
            break
        last, tasks = tuple(told), 1 + told[0] // EDGES_A_TASK
        edges = materialize(spark, _small(_large(spark, edges, tasks).filter("u <> v"), tasks).filter("u <> v").distinct().coalesce(tasks), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
