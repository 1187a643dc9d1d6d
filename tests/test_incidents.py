"""Anchored windows over ranges and campaigns by a sweep, against plain loops; events worth judging against all."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtrail.operators import campaigns, incidents, rules


def looped(times, width):
    anchors, last = [], None
    for t in times:
        if last is None or t - last > width:
            last = t
        anchors.append(last)
    return anchors


def test_passages_compose():
    rng = random.Random(1)
    for _ in range(300):
        times, width = np.array(sorted(rng.sample(range(300), rng.randint(1, 60)))), rng.choice([1, 5, 20, 100])
        cuts = sorted(rng.sample(range(len(times) + 1), min(len(times), rng.randint(0, 6))))
        ranges = [x for x in np.split(times, cuts) if len(x)]
        entry, got, whole = None, [], None
        for part in ranges:
            p = incidents.Passage.of(part, width)
            got += incidents.hop(part, width, entry).tolist()
            entry = int(p.exits[0]) if entry is None else int(p.through(np.array([entry]))[0])
            assert entry == got[-1]
            whole = p if whole is None else whole.then(p)
        assert got == looped(times, width)
        some = np.arange(-200, 400)
        assert (whole.through(some) == incidents.Passage.of(times, width).through(some)).all()


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_anchors_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(incidents, "RANGE_TIMES", size)
    rng, base = random.Random(size), datetime(2026, 1, 1)
    rows = []
    for scope, host, n in (("a", "hot", 300), ("a", "x", 5), ("b", "hot", 90), ("a", None, 40), (None, "x", 3)):
        rows += [(scope, host, base + timedelta(seconds=s)) for s in [rng.randrange(40_000) for _ in range(n)]]
    rows += rows[:20]  # repeated times
    got = {}
    for r in incidents.assign(spark.createDataFrame(rows, "scope string, host string, time timestamp").repartition(3), timedelta(minutes=15)).collect():
        got.setdefault((r.scope, r.host), []).append((r.time, r.anchor))
    assert sum(map(len, got.values())) == len(rows)
    for key, found in got.items():
        found.sort()
        assert [a for _, a in found] == looped([t for t, _ in found], timedelta(minutes=15)), key


def test_no_signals(spark):
    assert incidents.assign(spark.createDataFrame([], "scope string, host string, time timestamp")).count() == 0


def connected(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_sweep_against_all_pairs():
    rng = random.Random(4)
    for _ in range(3000):
        n, within = rng.randint(1, 14), rng.choice([1, 4, 10])
        some = []
        for _ in range(n):
            start = rng.randint(0, 40)
            some.append((rng.choice(["A", "B", None][: rng.randint(1, 3)]), start, start + rng.choice([0, 1, 3, 15])))
        near = lambda x, y, w=within: x[0] != y[0] and x[1] <= y[2] + w and y[1] <= x[2] + w
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if near(some[i], some[j])]
        sweep = campaigns.Sweep(within)
        edges = [e for i in sorted(range(n), key=lambda i: (some[i][1], i)) for e in sweep.add(i, *some[i])]
        assert connected(n, edges) == connected(n, pairs) and len(edges) < n


@pytest.fixture(scope="module")
def crowd(spark):
    rng, base, rows = random.Random(9), datetime(2026, 1, 1), []
    for scope in "ab":
        for i in range(150):
            start = base + timedelta(minutes=rng.randint(0, 3000))
            shared = [f"10.0.0.{rng.randint(0, 30)}" for _ in range(rng.randint(0, 2))]
            rows.append((scope, i, f"h{rng.randint(0, 5)}", start, start + timedelta(minutes=rng.choice([0, 5, 90])), shared, [rng.choice(["ann", "root", "bob", "cy", "di", "ed", "flo"])]))
    df = spark.createDataFrame(rows, "scope string, inc_idx int, host string, start timestamp, end timestamp, ips array<string>, accounts array<string>")
    return df, campaigns.entities(df)


def roots(df):
    return {(r.scope, r.inc_idx): r.root for r in df.collect()}


def test_edges_connect_what_pairs_do(spark, crowd, monkeypatch):
    df, found = crowd
    for within in (timedelta(minutes=2), timedelta(minutes=20)):
        want = roots(campaigns.components(campaigns.pairs(found, df, within)))
        edges = campaigns.edges(found, df, within)
        assert roots(campaigns.components(edges)) == want and len(set(want.values())) > 3
    monkeypatch.setattr(campaigns, "EDGES_A_TASK", 0)
    assert roots(campaigns.components(edges)) == want


def test_a_crowded_account_gives_few_edges(spark):
    n, base = 2000, datetime(2026, 1, 1)
    rows = [("a", i, f"h{i % 50}", base + timedelta(seconds=i), base + timedelta(seconds=i), [], ["ann"]) for i in range(n)]
    df = spark.createDataFrame(rows, "scope string, inc_idx int, host string, start timestamp, end timestamp, ips array<string>, accounts array<string>")
    edges = campaigns.edges(campaigns.entities(df), df)
    assert edges.count() <= 2 * n and set(roots(campaigns.components(edges)).values()) == {0}


def test_worth_judging_loses_nothing(spark):
    rng = random.Random(3)
    words = [w for r in rules.ROW_RULES if isinstance(r.needs, tuple) for w in r.needs[1]] + ["schtasks /create ", "powershell -enc ", "/create", "/tmp/", "-w hidden", "x", " ", "amsİ", "bash -İ", "Kerberos", "marK as benign", "iex", " -enc"]
    odd = lambda w: rng.choice([w, w.upper(), w.title(), w.replace("k", "K"), w.replace("s", "ſ"), w.replace(" ", "  ")])
    text = lambda: rng.choice([None, "", *["".join(odd(rng.choice(words)) + rng.choice(["", " ", "."]) for _ in range(rng.randint(1, 3))) for _ in range(3)]])
    rows = [(i, rng.choice([1, 1, 3, 4698, 1102, None]), text(), rng.choice([None, "port", "scan", ""]), rng.choice([None, "", text()]), rng.choice([None, "scan", text()]), text(), rng.choice([None, "45.9.148.3", "10.0.0.1", "-"]), rng.choice([None, 80, 443, 9])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, event_id long, cmdline string, category string, message string, tool string, url string, dst_ip string, dst_port long")
    df = df.withColumns({"scope": F.lit("all"), "host": F.lit("h"), "user": F.lit("u"), "time": F.timestamp_seconds("id"), "src_ip": F.lit(None).cast("string")})
    fired = lambda some: sorted((r.rule_ord, r.event_ids[0]) for r in rules.row_signals(df, some).collect())
    got = fired(rules.ROW_RULES)
    assert got == fired([replace(r, needs=None) for r in rules.ROW_RULES]) and {o for o, _ in got} == {r.order for r in rules.ROW_RULES}
