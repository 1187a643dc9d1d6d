"""Campaigns merged batch by batch against all incidents at once, with batches repeated and infrastructure that comes and goes."""

import random
from datetime import datetime, timedelta

from logtrail.operators import campaigns
from logtrail.streaming.campaigns import INCIDENT, StreamCampaigns

BASE = datetime(2026, 1, 1)


def some_incidents(n=160):
    rng, out = random.Random(12), []
    for i in range(n):
        start = BASE + timedelta(minutes=10 * i + rng.randint(0, 9))
        ips = ["9.9.9.9"] if rng.random() < (0.9 if i < 30 else 0.2) else []  # infrastructure at first, then no more
        ips += [f"10.0.0.{rng.randint(0, 25)}" for _ in range(rng.randint(0, 2))]
        out.append((rng.choice(["a", "b"]), f"h{i % 7}", start, start + timedelta(minutes=rng.choice([0, 5, 80])), ips, [rng.choice(["ann", "root", f"u{rng.randint(0, 40)}"])]))
    return out


def groups(rows):
    out = {}
    for r in rows:
        if r.root is not None:
            out.setdefault((r.scope, r.root), set()).add((r.host, r.start))
    return {(scope, frozenset(x)) for (scope, _), x in out.items()}


def at_once(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{INCIDENT}, inc_idx int")
    found = campaigns.without_infrastructure(campaigns.entities(df), df)
    return groups(df.join(campaigns.components(campaigns.pairs(found, df)), ["scope", "inc_idx"], "left").collect())


def test_batches_and_repeats(spark, tmp_path):
    rows, state = some_incidents(), StreamCampaigns(spark, f"file://{tmp_path}/state")
    df = lambda x: spark.createDataFrame(x, INCIDENT)
    cuts = [0, 25, 60, 110, 160]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        state.merge(df(rows[i:j]), k)
        if k == 1:
            state.merge(df(rows[i:j]), k)  # as after a failure between the work and the commit
        assert groups(state.campaigns().collect()) == at_once(spark, rows[:j]), k
    state.merge(df([]), 4)
    got = state.campaigns().collect()
    assert len(got) == len(rows) and groups(got) == at_once(spark, rows) and len(groups(got)) > 3


def test_as_a_stream(spark, tmp_path):
    rows, state = some_incidents(60), StreamCampaigns(spark, f"file://{tmp_path}/state")
    for k in range(2):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], INCIDENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(INCIDENT).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert groups(state.campaigns().collect()) == at_once(spark, rows)
