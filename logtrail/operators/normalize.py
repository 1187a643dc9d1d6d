"""Raw records with differing keys to one event schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logtrail.functions.columns import to_integer, truthy, utc_time
from logtrail.schema import ALIASES, EVENT_COLUMNS
from logtrail.sources.scratch import in_sequence, written
from logtrail.sources.tables import Table


def field(keys: Column, values: Column, aliases: list[str]) -> Column:
    """The first alias with a value that is not null. keys: in lower case, the last first; the first found counts."""
    named = lambda alias: F.try_element_at(values, F.nullif(F.array_position(keys, alias), F.lit(0)).cast("int"))
    return F.coalesce(*(named(alias) for alias in aliases))


def is_record(raw: Column) -> Column:
    """Whether the text is a JSON object."""
    return F.coalesce(raw.rlike(r"^\s*\{") & F.from_json(raw, "map<string,string>").isNotNull(), F.lit(False))


def valid_records(raw: DataFrame) -> DataFrame:
    """Raises on records that are no JSON object, naming the first three places; nothing is written before this."""
    return _checked(raw, raw.filter(~is_record(F.col("raw"))))


def _checked(out: DataFrame, bad: DataFrame) -> DataFrame:
    order = [c for c in ("file", "block", "ordinal") if c in bad.columns]
    if places := bad.orderBy(*order).select("ordinal").limit(3).collect():
        raise ValueError(f"records that are no objects, at {', '.join(str(r.ordinal) for r in places)}")
    return out


def normalize(raw: DataFrame, told: bool = False) -> DataFrame:
    """Unified columns for records (raw, ordinal; scope, file and block if there are such); narrow, one parse of each.

    With told also _record: whether the text is a JSON object.
    """
    scope = F.col("scope") if "scope" in raw.columns else F.lit("all")
    place = [c for c in ("file", "block") if c in raw.columns]
    parsed = raw.select(scope.alias("scope"), *place, "ordinal", "raw", F.reverse(F.map_entries(F.from_json("raw", "map<string,string>"))).alias("e"), F.get_json_object("raw", "$.http_request").alias("http"))
    parsed = parsed.withColumns({"k": F.transform("e", lambda e: F.lower(e["key"])), "v": F.transform("e", lambda e: e["value"])})
    of = lambda names: field(F.col("k"), F.col("v"), names)
    http = lambda k: truthy(F.get_json_object("http", f"$.{k}"))
    status = lambda c: F.nullif(to_integer(c), F.lit(0))
    out = parsed.select(
        "scope", *place, "ordinal", "raw", *(of(names).alias(k) for k, names in ALIASES.items()), "http", (F.col("e").isNotNull() & F.col("raw").rlike(r"^\s*\{")).alias("_record"),
        *(of([k]).alias(f"_{k}") for k in ("url", "method", "status")), of(["task_name"]).alias("_task1"), of(["taskname"]).alias("_task2"),
    )
    task = F.coalesce(truthy(F.col("_task1")), truthy(F.col("_task2")))
    empty = F.coalesce(F.col("cmdline"), F.lit("")) == ""
    return out.select(
        "scope", *place, "ordinal", utc_time(F.col("time")).alias("time"), "host", "source", to_integer(F.col("event_id")).alias("event_id"), "user", "src_ip", "dst_ip",
        to_integer(F.col("dst_port")).alias("dst_port"), "process", F.when(empty & task.isNotNull(), F.concat(F.lit("TaskName="), task)).otherwise(F.col("cmdline")).alias("cmdline"),
        "parent", "category", "message", "tool", F.coalesce(http("url"), F.col("_url")).alias("url"), F.coalesce(http("method"), F.col("_method")).alias("http_method"),
        F.coalesce(status(F.get_json_object("http", "$.status")), to_integer(F.col("_status"))).alias("http_status"), "raw", *(["_record"] if told else []),
    )


def untimed() -> tuple[Observation, list[Column]]:
    """What to observe of events where they are written or read anyway: how many there are, and how many have a usable time."""
    return Observation(), [F.count(F.lit(1)).alias("events"), F.count("time").alias("timed")]


def dropped(seen: dict) -> int:
    """How many events had no usable time; an error if that is all of a table that is not empty."""
    if seen["events"] and not seen["timed"]:
        raise ValueError(f"none of {seen['events']} events has a usable time")
    return seen["events"] - seen["timed"]


def drop_untimed(events: DataFrame) -> DataFrame:
    """Without rows that have no usable time; an error if that is all, which takes a count. ingest counts as it writes."""
    dropped(events.agg(*untimed()[1]).first().asDict())
    return events.filter(F.col("time").isNotNull())


def with_ids(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Ids 1, 2, 3 ... in the order given, else by file, block of the file and place in it, as far as there are such."""
    order = order or [c for c in ("file", "block", "ordinal") if c in events.columns]
    return in_sequence(events, order, "id").withColumn("id", F.col("id") + 1)


@dataclass(frozen=True)
class Ingested:
    """Events with ids, and how many records were read, had no usable time, and were no objects (with a quarantine)."""

    events: DataFrame
    read: int
    untimed: int
    quarantined: int


def ingest_counted(spark: SparkSession, raw: DataFrame, quarantine: str | None = None) -> Ingested:
    """Records to events. They are parsed once and written, and counted by that write: no other job looks at them all.

    Records that are no JSON objects are an error, before anything is stored, unless there is a place for them: then they
    are added to that table as they came, with the reason, and the others go on.
    """
    seen, counts = untimed()
    record = F.coalesce("_record", F.lit(False))
    parsed = normalize(raw, told=True).observe(seen, *counts, F.count_if(~record).alias("bad"))
    parsed = written(parsed, "normalized")
    told = seen.get
    if told["bad"] and not quarantine:
        _checked(parsed, parsed.filter(~record))
    if told["bad"]:
        place = [c for c in ("scope", "file", "block", "ordinal") if c in parsed.columns]
        parsed.filter(~record).select(*place, "raw", F.lit("no JSON object").alias("reason")).write.mode("append").parquet(quarantine)
        parsed = parsed.filter(record)
    lost = dropped(told | {"events": told["events"] - told["bad"]})
    events = with_ids(parsed.filter(F.col("time").isNotNull()).drop("_record")).select(*EVENT_COLUMNS)
    return Ingested(events, told["events"], lost, told["bad"])


def ingest(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Events with ids; see ingest_counted."""
    return ingest_counted(spark, raw).events


def write_events(events: DataFrame, path: str) -> int:
    """Replaces the table at path, by date, when all is written: read it by Table(spark, path).read(). The number of events."""
    return Table(events.sparkSession, path).replace(events.withColumn("date", F.to_date("time")), ("date",))
