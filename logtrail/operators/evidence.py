"""The evidence text of an incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail.functions.columns import clip, iso, or_none, truthy
from logtrail.schema import DEFAULT, Config, catalogue

OPTIONAL = (("EID", "event_id"), ("user", "user"), ("src_ip", "src_ip"), ("process", "process"), ("cmdline", "cmdline"), ("category", "category"), ("tool", "tool"), ("url", "url"), ("message", "message"))


def event_line(most: int = DEFAULT.field_chars) -> Column:
    """One event as one line; fields that are null, empty or 0 are left out."""
    value = lambda c: F.nullif(truthy(F.col(c).cast("string")), F.lit("0") if c == "event_id" else F.lit(""))
    parts = [F.when(value(c).isNotNull(), F.concat(F.lit(f"{label}="), clip(value(c), most))) for label, c in OPTIONAL]
    target = F.when(truthy(F.col("dst_ip")).isNotNull(), F.concat(F.lit("dst_ip="), clip(F.col("dst_ip"), most), F.lit(":"), or_none(F.col("dst_port"))))
    return F.concat(F.lit("  - "), F.concat_ws(" | ", F.concat(F.lit("id="), F.col("id").cast("string")), iso(F.col("time")), target, *parts))


def top_events(incidents: DataFrame, events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """scope, inc_idx, rn, line, n: the first events of each incident by time, and how many there are.

    Lines are made beside the event table and only those are moved; each incident keeps a bounded number before
    anything is collected.
    """
    wanted = incidents.select("scope", "inc_idx", F.size("event_ids").alias("n"), F.explode("event_ids").alias("id"))
    lines = events.select("scope", "id", "time", event_line(config.field_chars).alias("line"))
    first = F.row_number().over(Window.partitionBy("scope", "inc_idx").orderBy("time", "id"))
    return wanted.join(lines, ["scope", "id"]).withColumn("rn", first).filter(F.col("rn") <= config.context_events).select("scope", "inc_idx", "rn", "line", "n")


def described(techniques: DataFrame) -> DataFrame:
    """scope, inc_idx, lines: each technique with name and tactic, in order; unknown ones say so."""
    known = catalogue(techniques.sparkSession)
    out = techniques.select("scope", "inc_idx", F.posexplode("techniques").alias("at", "technique")).join(F.broadcast(known), "technique", "left")
    text = F.when(F.col("name").isNull(), F.concat("technique", F.lit(": (unknown technique)"))).otherwise(F.concat("technique", F.lit(": "), "name", F.lit(" ["), "tactic", F.lit("]")))
    return out.groupBy("scope", "inc_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("  - "), text).alias("line")))), lambda x: x["line"]).alias("reference"))


def package(incidents: DataFrame, events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """scope, inc_idx, evidence."""
    top = top_events(incidents, events, config).groupBy("scope", "inc_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]).alias("lines"))
    rows = incidents.join(top, ["scope", "inc_idx"], "left").join(described(incidents), ["scope", "inc_idx"], "left")
    cut, most = lambda c: clip(c, config.field_chars), config.context_events
    array = lambda *x: F.array(*(F.lit(y) if isinstance(y, str) else y for y in x))
    omitted = F.size("event_ids") - most
    signal = F.transform("signals", lambda s: F.concat(F.lit("  - "), s["technique"], F.lit(" "), s["technique_name"], F.lit(": "), cut(s["description"]), F.lit(" (event ids: ["), F.array_join(s["event_ids"].cast("array<string>"), ", "), F.lit("])")))
    peers = F.transform("campaign_peers", lambda p: F.concat(F.lit("  - "), cut(p["host"]), F.lit(" at "), iso(p["start"]), F.lit(": "), F.array_join(p["techniques"], ", ")))
    campaign = F.when(F.size("campaign_peers") > 0, F.concat(array("", "SAME CAMPAIGN — RELATED ACTIVITY ON OTHER HOSTS:"), peers, array("  These hosts share a pivot address or account: treat them as one campaign."))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(
        array(F.concat(F.lit("HOST: "), cut(or_none(F.col("host")))), F.concat(F.lit("TIME RANGE: "), iso(F.col("start")), F.lit(" - "), iso(F.col("end"))), "", "<evidence>", "EVENTS (raw logs — each has an id):"),
        F.coalesce("lines", F.array().cast("array<string>")),
        F.when(omitted > 0, array(F.concat(F.lit("  (… "), omitted.cast("string"), F.lit(" further event(s) omitted to stay within budget)")))).otherwise(F.array().cast("array<string>")),
        array("", "TRIGGERED DETECTION RULES (signals):"), signal, array("</evidence>", "", "RELEVANT TECHNIQUES (trusted reference):"), F.coalesce("reference", F.array().cast("array<string>")), campaign,
        array("", F.concat(F.lit("REQUIRED: one attack_chain entry for each of: "), F.array_join("techniques", ", "), F.lit("."))),
    )
    return rows.select("scope", "inc_idx", F.array_join(whole, "\n").alias("evidence"))
