"""Logs to incidents to campaigns, and what is made of them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.functions.columns import iso
from logtrail.operators import campaigns, incidents, rules
from logtrail.schema import DEFAULT, Config
from logtrail.sources.scratch import written

#: The test tables are denser in time than a day of logs: campaigns are linked within ten minutes there.
TEST_CONFIG = Config(campaign_window=timedelta(minutes=10))


def find_incidents(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return incidents.incidents(rules.signals(events, config), config)


def find_campaigns(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The flagship: events to incidents with their campaigns."""
    return campaigns.link(written(find_incidents(events, config), "incidents"), config)


def flat(found: DataFrame) -> DataFrame:
    """Scalars only, for printing and comparing."""
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    out = found.select("inc_idx", "host", iso(F.col("start")).alias("start_time"), iso(F.col("end")).alias("end_time"), "severity", F.array_join("techniques", ",").alias("techniques"), ids("event_ids").alias("event_ids"), *([F.col("campaign_id"), F.array_join("related_hosts", ",").alias("related_hosts")] if "campaign_id" in found.columns else []))
    return out


def run(spark: SparkSession, raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Raw records to campaigns."""
    from logtrail.operators.normalize import ingest

    return find_campaigns(written(ingest(spark, raw), "events"), config)
