"""Readers: raw logs, rendered Windows records, labelled scenarios, documents, and events made for scale tests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.sources.files import json_arrays, whole_files

WIN_SCHEMA = """Event struct<System: struct<EventID: string, Provider: struct<`#attributes`: struct<Name: string>>, Channel: string,
Computer: string, TimeCreated: struct<`#attributes`: struct<SystemTime: string>>>, EventData: string>"""


def json_array_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, raw: the elements of JSON arrays, one array for each file; large files are several tasks' work.

    The raw text of an object is without blanks between tokens; what is none, or no JSON, is as it stands.
    """
    compact = F.get(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), F.lit(0))
    return json_arrays(spark, path).withColumn("raw", F.coalesce(F.when(F.col("raw").startswith("{"), compact), "raw"))


def json_lines_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, ordinal, raw: a record for each line; splits of a file are read side by side.

    Within a block of a file ordinals rise with the lines, so (file, block, ordinal) is the order of the input; Spark
    may deal blocks to tasks in any order, which the ordinals alone would follow.
    """
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ordinal")]
    return spark.read.text(path).select(*at, F.col("value").alias("raw")).filter("raw <> ''")


def win_records(records: DataFrame, column: str = "raw") -> DataFrame:
    """Raw logs from rendered Windows records: flattened, in the keys that normalising knows; others dropped."""
    r = records.withColumn("_r", F.from_json(column, WIN_SCHEMA))
    system, data = F.col("_r.Event.System"), F.from_json(F.col("_r.Event.EventData"), "map<string,string>")
    event_id = F.coalesce(F.get_json_object(system["EventID"], "$.#text"), system["EventID"]).try_cast("bigint")
    named = lambda k: F.nullif(data[k], F.lit(""))
    user = F.coalesce(named("TargetUserName"), named("SubjectUserName"), named("User"))
    user = F.nullif(F.substring_index(user, "\\", -1), F.lit(""))
    about = F.lower(F.concat_ws("", system["Provider"]["#attributes"]["Name"], system["Channel"]))
    source = F.when(about.contains("sysmon"), "Sysmon").otherwise(F.coalesce(F.nullif(system["Channel"], F.lit("")), F.lit("Security")))
    out = r.filter(F.col("_r.Event").isNotNull()).select(
        *records.columns, system["TimeCreated"]["#attributes"]["SystemTime"].alias("time"), system["Computer"].alias("host"), source.alias("source"), event_id.alias("event_id"),
        user.alias("user"), named("IpAddress").alias("ip"), named("DestinationIp").alias("dest_ip"), named("DestinationPort").try_cast("bigint").alias("dest_port"),
        named("Image").alias("image"), named("CommandLine").alias("cmdline"), named("ParentImage").alias("parent"), named("TaskName").alias("task_name"),
    )
    return out.filter(F.col("event_id").isNotNull())


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """name, is_malicious, expected_techniques, ordinal, raw: the logs of labelled scenarios, scope = name."""
    kind = "struct<name:string,description:string,is_malicious:boolean,expected_techniques:array<string>,logs:array<string>>"
    found = json_arrays(spark, path).select(F.from_json("raw", kind).alias("s"))
    return found.select("s.name", "s.is_malicious", "s.expected_techniques", F.posexplode_outer("s.logs").alias("ordinal", "raw")).withColumn("scope", F.col("name"))


def labeled_captures(spark: SparkSession, paths: list[str], labels: DataFrame) -> DataFrame:
    """scope (file name), block, ordinal, raw of several capture files, with what labels (file, expected) say of each."""
    return json_lines_logs(spark, paths).join(labels, "file").withColumnRenamed("file", "scope")


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """source, text of every *.md, empty ones too, with line ends as newlines; an error if there is none."""
    return whole_files(spark, folder, ".md").orderBy("source")


def write_markdown(docs: DataFrame, folder: str) -> None:
    """A file for each document (source, text), named by its source, in a folder that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inside = pafs.FileSystem.from_uri(folder)
        files.create_dir(inside, recursive=True)
        for batch in batches:
            for source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_output_stream(f"{inside}/{source}") as out:
                    out.write((text or "").encode())
            yield batch.select(["source"])

    docs.select("source", "text").mapInArrow(run, "source string").write.format("noop").mode("overwrite").save()


def synth_events(spark: SparkSession, n: int, hot_share: float | None = None, start: str = "2026-07-03 10:00:00") -> DataFrame:
    """Five kinds of events by id % 5, of which the first are failed logons of one host, user and address; a second apart.

    With hot_share that part of all events, in runs, are those logons, and the other kinds go by id % 4.
    """
    i = F.col("id")
    hot = i % 5 == 0 if hot_share is None else (i % 1000) < int(1000 * hot_share)
    kind = i % 5 if hot_share is None else F.when(hot, 0).otherwise(1 + i % 4)
    host, user = F.format_string("HOST%02d", i % 50), F.concat(F.lit("user"), (i % 200).cast("string"))
    when = lambda k, v: F.when(kind == k, v)
    return spark.range(n).select(
        F.lit("all").alias("scope"), i.alias("id"), F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + i).alias("time"),
        F.when(hot, "SRV-TARGET").otherwise(host).alias("host"), F.when(kind <= 1, "Security").otherwise("Sysmon").alias("source"),
        when(0, 4625).when(kind == 1, 4624).when(kind == 3, 3).otherwise(1).cast("bigint").alias("event_id"),
        F.when(hot, "svc").otherwise(user).alias("user"), when(0, "185.220.101.7").when(kind == 1, "10.0.0.5").alias("src_ip"),
        when(3, "142.250.187.4").alias("dst_ip"), when(3, 443).cast("bigint").alias("dst_port"), when(2, "git.exe").when(kind == 4, "chrome.exe").alias("process"),
        when(2, "git status").when(kind == 4, "chrome.exe --type=renderer").alias("cmdline"),
        *(F.lit(None).cast("string").alias(c) for c in ("parent", "category", "message", "tool", "url", "http_method")), F.lit(None).cast("bigint").alias("http_status"), F.lit(None).cast("string").alias("raw"),
    )
