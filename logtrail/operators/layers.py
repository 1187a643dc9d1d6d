"""Technique layers, evaluation against labels, and small views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.schema import catalogue, keys

RAW_VIEW = ("id", "time", "host", "event_id", "user", "src_ip", "category", "tool", "url", "message", "cmdline")


def technique_layer(signals: DataFrame) -> DataFrame:
    """technique, name, score, hosts, comment; counts and host sets are summed before the shuffle."""
    found = signals.groupBy("technique").agg(F.count(F.lit(1)).alias("score"), F.array_join(F.array_sort(F.collect_set("host")), ", ").alias("hosts"))
    named = found.join(F.broadcast(catalogue(signals.sparkSession).select("technique", "name")), "technique", "left")
    return named.select("technique", F.coalesce("name", F.lit("")).alias("name"), "score", "hosts", F.concat(F.col("score").cast("string"), F.lit(" signal(s) on: "), "hosts").alias("comment"))


def coverage_layer(spark: SparkSession) -> DataFrame:
    return catalogue(spark).select("technique", "name", "covered", F.when(F.col("covered"), "#2e7d32").otherwise("#c62828").alias("color"), F.when(F.col("covered"), "Rule implemented").otherwise("KNOWN GAP — no rule yet").alias("comment"))


def layer_json(layer: DataFrame, name: str) -> DataFrame:
    """One row: the layer as JSON; a row for each technique of the catalogue at most."""
    color = [F.col("color")] if "color" in layer.columns else [F.col("score")]
    item = F.struct(F.col("technique").alias("techniqueID"), *color, F.lit(True).alias("enabled"), "comment", F.array(F.struct(F.lit("technique").alias("name"), F.col("name").alias("value"))).alias("metadata"))
    versions = F.struct(F.lit("14").alias("attack"), F.lit("4.9.1").alias("navigator"), F.lit("4.5").alias("layer"))
    return layer.agg(F.to_json(F.struct(F.lit(name).alias("name"), versions.alias("versions"), F.lit("enterprise-attack").alias("domain"), F.array_sort(F.collect_list(item)).alias("techniques"))).alias("layer"))


def confusion(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """scope, tp, fp, fn of techniques found against expected; labels: scope, expected_techniques, is_malicious."""
    found = signals.groupBy("scope").agg(F.collect_set("technique").alias("predicted"))
    none = F.array().cast("array<string>")
    rows = labels.join(found, "scope", "left").withColumn("predicted", F.coalesce("predicted", none)).withColumn("expected", F.coalesce("expected_techniques", none))
    return rows.select("scope", "is_malicious", F.size(F.array_intersect("predicted", "expected")).alias("tp"), F.size(F.array_except("predicted", "expected")).alias("fp"), F.size(F.array_except("expected", "predicted")).alias("fn"), (F.size("predicted") > 0).alias("alarm"))


def metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and the share of scopes whose alarm agrees with the label; 0 for empty denominators."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg((F.col("alarm") == F.col("is_malicious")).cast("int")).alias("accuracy"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def recall_by_file(counts: DataFrame) -> DataFrame:
    """Expected techniques found, by scope and over all (scope null)."""
    out = counts.rollup("scope").agg(F.sum("tp").alias("found"), F.sum(F.col("tp") + F.col("fn")).alias("expected"))
    return out.withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0))


def gate(measured: DataFrame, least_precision: float, least_recall: float) -> DataFrame:
    """The row of metrics with `passed`."""
    return measured.withColumn("passed", (F.col("precision") >= least_precision) & (F.col("recall") >= least_recall))


def raw_events(events: DataFrame) -> DataFrame:
    """The raw view's columns by time, without those that are null throughout: one pass of counts decides."""
    some = events.select(*RAW_VIEW)
    counts = some.agg(*(F.count(c).alias(c) for c in RAW_VIEW)).first()
    return some.select(*(c for c in RAW_VIEW if counts[c])).orderBy("time", "id")


def event_mix(events: DataFrame) -> DataFrame:
    return events.groupBy(*keys("source", "event_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "event_id")
