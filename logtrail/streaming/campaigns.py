"""Campaigns of incidents that a stream closes: linked batch by batch, with the components kept in tables.

Each batch adds its incidents and the edges they bring, and merges the labels of the components that these connect. What
a batch writes goes to a folder of its own number, over what an attempt before may have left there, and is made from the
folders of the batches before it: a batch that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.operators import campaigns
from logtrail.schema import DEFAULT, Config
from logtrail.sources.scratch import in_sequence, written

INCIDENT = "scope string, host string, start timestamp, end timestamp, ips array<string>, accounts array<string>"
NUMBERED = f"{INCIDENT}, inc_idx int"
EDGE = "scope string, kind string, entity string, a int, b int"
LABEL = "scope string, inc_idx int, root int"


class StreamCampaigns:
    """Use `merge` as the function of foreachBatch; `campaigns` gives the state after the last batch.

    An address that becomes infrastructure, being in more than half of all incidents, takes its edges with it, and one
    that no longer is brings them back: whenever the addresses so judged change, all labels are found anew from the
    edges kept. Otherwise only labels that a batch's edges connect are looked at.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def _table(self, name: str, schema: str, below: int | None = None) -> DataFrame:
        """All batches of a table, or those before one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        numbers = sorted(int(x.partition("=")[2]) for x in found if x.startswith("batch="))
        if name in ("labels", "infrastructure"):  # the last one stands for all
            numbers = [n for n in numbers if below is None or n < below][-1:]
        folders = [f"{self.path}/{name}/batch={n}" for n in numbers if below is None or n < below]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _store(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        folder = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def merge(self, closed: DataFrame, batch: int) -> None:
        """closed: scope, host, start, end, ips, accounts of incidents; any order, each in one batch."""
        within = self.config.campaign_window
        before = self._table("incidents", NUMBERED, batch)
        known = before.count()
        columns = [c.split()[0] for c in INCIDENT.split(", ")]
        fresh = in_sequence(closed.select(*columns), ["scope", "host", "start"], "_n")
        fresh = self._store(fresh.select(*columns, (F.col("_n") + known).cast("int").alias("inc_idx")), "incidents", batch)
        first = fresh.agg(F.min("start").alias("start")).first().start
        # all that an incident of this batch can be near to: those that end no earlier than the window before the first
        near = before.filter(F.col("end") >= F.lit(first).cast("timestamp") - within) if first else before.limit(0)
        around = written(near.unionByName(fresh), "around")
        self._store(campaigns.entity_edges(campaigns.entities(around), around, within), "edges", batch)

        every, last = self._table("incidents", NUMBERED, batch + 1), self._table("infrastructure", "scope string, entity string", batch)
        infra = self._store(campaigns.infrastructure(campaigns.entities(every), every, self.config.infra_least).select("scope", "entity"), "infrastructure", batch)
        same = infra.exceptAll(last).isEmpty() and last.exceptAll(infra).isEmpty()
        labels = self._table("labels", LABEL, batch) if same else self.spark.createDataFrame([], LABEL)
        edges = self._table("edges", EDGE, batch + 1)
        if same:
            edges = self.spark.read.schema(EDGE).parquet(f"{self.path}/edges/batch={batch}")
        edges = edges.join(infra.withColumn("kind", F.lit("ip")), ["scope", "kind", "entity"], "left_anti").select("scope", "a", "b").distinct()
        self._store(self._merged(labels, edges), "labels", batch)

    def _merged(self, labels: DataFrame, edges: DataFrame) -> DataFrame:
        """Labels after more edges: edges between incidents become edges between the roots of their components."""
        root = lambda side: labels.select("scope", F.col("inc_idx").alias(side), F.col("root").alias(f"_{side}"))
        at = lambda side: F.coalesce(f"_{side}", side)
        roots = edges.join(root("a"), ["scope", "a"], "left").join(root("b"), ["scope", "b"], "left")
        lifted = roots.select("scope", F.least(at("a"), at("b")).alias("a"), F.greatest(at("a"), at("b")).alias("b"))
        moved = campaigns.components(lifted.filter("a <> b").distinct()).select("scope", F.col("inc_idx").alias("root"), F.col("root").alias("_new"))
        moved = written(moved, "moved")
        old = labels.join(moved, ["scope", "root"], "left").select("scope", "inc_idx", F.coalesce("_new", "root").alias("root"))
        new = moved.select("scope", F.col("root").alias("inc_idx"), F.col("_new").alias("root")).join(labels.select("scope", "inc_idx"), ["scope", "inc_idx"], "left_anti")
        return old.unionByName(new)

    def campaigns(self) -> DataFrame:
        """All incidents so far, with root: the smallest number of an incident of the same campaign, null for none."""
        return self._table("incidents", NUMBERED).join(self._table("labels", LABEL), ["scope", "inc_idx"], "left")
