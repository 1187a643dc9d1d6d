"""Streams against batches: rows out of order, restarts, what is late, and many keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logtrail.operators import incidents, rules
from logtrail.streaming import rules as streams

BASE = datetime(2026, 1, 1)


def run(spark, tmp_path, name, made, *parts):
    """Parts appended and read one run after another, each run from the checkpoint of the one before."""
    late, out = 0, f"{tmp_path}/{name}-out"
    with streams.LateRows(spark) as counted:
        for k, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
            stream = made(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/{name}-in"))
            query = stream.writeStream.queryName(f"{name}{k}").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
            query.awaitTermination()
            late += counted.count(query)
    return spark.read.schema(stream.schema).parquet(out).collect(), late


def logons(spark, rows):
    df = spark.createDataFrame(rows, "id long, host string, time timestamp")
    return df.withColumns({"scope": F.lit("all"), "user": F.lit("u"), "src_ip": F.lit(None).cast("string"), "event_id": F.lit(4625).cast("long")})


def test_bursts_out_of_order_and_restarted(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted([(i, rng.choice(["a", "b", "c", "d", None]), BASE + timedelta(seconds=rng.randrange(7200), microseconds=rng.randrange(3))) for i in range(150)], key=lambda r: r[2])
    parts = [rows[i : i + 30] for i in range(0, 150, 30)]
    for part in parts:
        rng.shuffle(part)
    for a, b in zip(parts, parts[1:], strict=False):  # neighbours swap rows that are less than the allowed delay apart
        newest, oldest = max(r[2] for r in a), min(r[2] for r in b)
        if newest - oldest < timedelta(minutes=9):
            a[0], b[0] = b[0], a[0]
    end = [(999, "end", BASE + timedelta(days=9))]
    got, late = run(spark, tmp_path, "burst", lambda s: streams.stream_brute_force(s, "2 hours"), *(logons(spark, p) for p in [*parts, end]))
    want = rules.brute_force(logons(spark, rows)).collect()
    assert late == 0 and len(want) == 5
    assert sorted((r.host or "", r.event_ids) for r in got) == sorted((r.host or "", r.event_ids) for r in want)


def test_late_rows_are_counted(spark, tmp_path):
    first = logons(spark, [(i, f"h{i % 3}", BASE + timedelta(minutes=i)) for i in range(60)])
    again = logons(spark, [(100 + i, "late", BASE + timedelta(minutes=i)) for i in range(60)])
    got, late = run(spark, tmp_path, "late", streams.stream_brute_force, first, again)
    assert late == 50  # the mark is minute 49, which is late itself


def test_incidents_restarted(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted([("all", rng.choice(["a", "b", "c"]), BASE + timedelta(seconds=10 * rng.randrange(2000)), rng.randint(1, 16), [i], rng.choice(["T1", "T2", "T3"])) for i in range(200)], key=lambda r: r[2])
    df = lambda some: spark.createDataFrame(some, "scope string, host string, time timestamp, rule_ord int, event_ids array<long>, technique string")
    end = [("all", "end", BASE + timedelta(days=9), 1, [999], "T1")]
    got, late = run(spark, tmp_path, "incidents", streams.stream_incidents, *(df(rows[i : i + 50]) for i in range(0, 200, 50)), df(end))
    whole = df(rows).select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("rule", "string"), ("technique_name", "string"), ("severity", "string"), ("user", "string"), ("description", "string"), ("ips", "array<string>"), ("accounts", "array<string>"))))
    want = incidents.build(incidents.assign(whole)).collect()
    assert late == 0
    assert sorted((r.host, r.start, r.end, r.n, r.techniques) for r in got) == sorted((r.host, r.start, r.end, len(r.signals), r.techniques) for r in want)
