"""Signals to incidents: windows per host anchored at the first signal."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.functions.columns import severity_rank
from logtrail.schema import DEFAULT, Config, keys
from logtrail.sources.scratch import bounded, in_sequence, written

#: Distinct signal times that a task takes at once; a host with more is worked on in several ranges.
RANGE_TIMES = 250_000


def hop(micros: np.ndarray, width: int, entry: int | None = None) -> np.ndarray:
    """For sorted times the anchor of each: that of the open incident if it reaches them, else the first time later than `width` after the last anchor."""
    anchors, at = np.empty_like(micros), 0
    if entry is not None:
        at = int(np.searchsorted(micros, entry + width, side="right"))
        anchors[:at] = entry
    while at < len(micros):
        end = int(np.searchsorted(micros, micros[at] + width, side="right"))
        anchors[at:end] = micros[at]
        at = end
    return anchors


class Passage:
    """What a range of a host's times does to the anchor that is open before it.

    An anchor below cuts[j], and not below cuts[j - 1], leaves exits[j] open after the range; one that is below none
    reaches over the whole range and stays. Neighbours with equal exits are one, so a passage has no more steps than
    there are times in the last window of its range.
    """

    def __init__(self, cuts: np.ndarray, exits: np.ndarray) -> None:
        last = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, bool)
        self.cuts, self.exits = cuts[last], exits[last]

    @classmethod
    def of(cls, micros: np.ndarray, width: int) -> Passage:
        """For sorted times."""
        after, exits = np.searchsorted(micros, micros + width, side="right").tolist(), micros.tolist()
        for i in range(len(exits) - 1, -1, -1):
            if after[i] < len(exits):
                exits[i] = exits[after[i]]
        return cls(micros - width, np.array(exits, np.int64))

    def through(self, anchors: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, anchors, side="right")
        return np.where(at < len(self.cuts), np.append(self.exits, 0)[at], anchors)

    def then(self, later: Passage) -> Passage:
        """This range, then a later one: as a single passage."""
        return Passage(np.append(self.cuts, later.cuts), np.append(later.through(self.exits), later.exits))


def _entries(ranged: DataFrame, width: int) -> DataFrame:
    """_scope, _host, _r, entry: the anchor open before each range of hosts that lie in several.

    Ranges become passages, and passages of neighbours are composed by doubling: after n rounds each stands for 2^n
    ranges, until the longest host is covered. There are no more passages than twice the ranges.
    """
    host = ["scope", "host"]
    same = lambda a, b: [a[c].eqNullSafe(b[f"_{c}"]) for c in host]
    named = lambda df: df.withColumnsRenamed({c: f"_{c}" for c in host})
    wide = written(ranged.groupBy(*host).agg(F.min("_range").alias("low"), F.max("_range").alias("high")).filter("low < high"), "hosts")
    longest = wide.agg(F.max(F.col("high") - F.col("low")).alias("n")).first().n or 0

    def summary(table: pa.Table) -> pa.Table:
        p = Passage.of(np.sort(table.column("t").to_numpy()), width)
        first = table.slice(0, 1)
        return pa.table({**{c: first.column(c) for c in (*host, "_range")}, "cuts": pa.array([p.cuts], pa.list_(pa.int64())), "exits": pa.array([p.exits], pa.list_(pa.int64()))})

    schema = "scope string, host string, _range int, cuts array<long>, exits array<long>"
    some = bounded(named(wide.select(*host)))
    rows = ranged.join(some, same(ranged, some), "left_semi")
    passages = written(rows.groupBy("_range", *host).applyInArrow(summary, schema), "passages")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, column = [], {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for i in range(batch.num_rows):
                at = lambda c, i=i: column[c][i].values.to_numpy()
                p = Passage(at("cuts"), at("exits"))
                out.append(Passage(at("_cuts"), at("_exits")).then(p) if column["_cuts"][i].is_valid else p)
            lists = [pa.array([getattr(p, c) for p in out], pa.list_(pa.int64())) for c in ("cuts", "exits")]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in (*host, "_range")), *lists], [*host, "_range", "cuts", "exits"])

    step = 1
    while step <= longest:
        before = named(passages).select("_scope", "_host", (F.col("_range") + step).alias("_r"), F.col("cuts").alias("_cuts"), F.col("exits").alias("_exits"))
        both = passages.join(before, [*same(passages, before), passages["_range"] == before["_r"]], "left")
        passages = written(both.select(*host, "_range", "cuts", "exits", "_cuts", "_exits").mapInArrow(compose, schema), "passages")
        step *= 2
    return named(passages).select("_scope", "_host", (F.col("_range") + 1).alias("_r"), F.get("exits", F.lit(0)).alias("entry"))


def assign(signals: DataFrame, window: timedelta = DEFAULT.incident_window) -> DataFrame:
    """Adds `anchor`, the time of the first signal of each one's incident.

    Neither a session window (its gaps are between neighbours) nor a tumbling one (the anchor is in the data). The
    distinct times of all hosts are sorted into ranges of like size; a host may lie in many. What each range does to an
    open anchor is summed up and composed (_entries), so every range knows the anchor open before it and all are worked
    on side by side. Signals are written, as they are read twice, and are expected to be far fewer than events.
    """
    signals = written(signals, "signals")
    width, schema = int(window.total_seconds() * 1_000_000), "scope string, host string, t long, a long"
    times = signals.select(*keys("host"), F.unix_micros("time").alias("t")).distinct()
    ranges = -(-signals.count() // RANGE_TIMES)

    def anchored(table: pa.Table) -> pa.Table:
        table = table.sort_by([("scope", "ascending"), ("host", "ascending"), ("t", "ascending")])
        t, entry = table.column("t").to_numpy(), table.column("entry").to_pylist()
        codes = [c.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for c in (table.column("scope"), table.column("host"))]
        starts = np.flatnonzero(np.any([np.diff(c, prepend=-2) != 0 for c in codes], axis=0)) if len(t) else []
        ends = [*starts[1:], len(t)]
        anchors = [hop(t[i:j], width, entry[i]) for i, j in zip(starts, ends, strict=False)]
        return pa.table({"scope": table.column("scope"), "host": table.column("host"), "t": t, "a": np.concatenate(anchors) if anchors else t})

    if ranges > 1:
        ranged = written(times.repartitionByRange(ranges, "scope", "host", "t").withColumn("_range", F.spark_partition_id()), "ranges")
        before = _entries(ranged, width)
        ranged = ranged.join(before, [ranged[c].eqNullSafe(before[f"_{c}"]) for c in keys("host")] + [F.col("_range") == F.col("_r")], "left")
    else:
        ranged = times.withColumns({"_range": F.lit(0), "entry": F.lit(None).cast("long")})
    found = ranged.select(*keys("host"), "t", "_range", "entry").groupBy("_range").applyInArrow(anchored, schema)
    found = found.select(*(F.col(c).alias(f"_{c}") for c in keys("host")), F.col("t").alias("_t"), F.timestamp_micros("a").alias("anchor"))
    on = [signals[c].eqNullSafe(F.col(f"_{c}")) for c in keys("host")]
    out = signals.join(found, [*on, F.unix_micros(signals["time"]) == F.col("_t")], "left").drop("_scope", "_host", "_t")
    if dict(signals.dtypes)["time"] == "timestamp_ntz":
        out = out.withColumn("anchor", F.to_timestamp_ntz(F.date_format("anchor", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return out


def build(assigned: DataFrame) -> DataFrame:
    """One row for each incident: start, end, techniques in order, severity, signals, event_ids, ips and accounts."""
    first = F.get("event_ids", F.lit(0)).alias("first_id")
    packed = F.struct("time", "rule_ord", first, "rule", "technique", "technique_name", "severity", "user", "event_ids", "description")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    rows = assigned.groupBy(*keys("host"), "anchor").agg(
        F.array_sort(F.collect_list(packed)).alias("signals"), F.max(F.coalesce(severity_rank(F.col("severity")), F.lit(0))).alias("rank"),
        flat("event_ids").alias("event_ids"), flat("ips").alias("ips"), flat("accounts").alias("accounts"),
    )
    severity = F.element_at(F.array(*(F.lit(s) for s in ("low", "medium", "high", "critical"))), F.col("rank") + 1)
    return rows.select(
        *keys("host"), F.col("signals")[0]["time"].alias("start"), F.element_at("signals", -1)["time"].alias("end"),
        F.array_distinct(F.transform("signals", lambda s: s["technique"])).alias("techniques"), severity.alias("severity"), "rank", "signals", "event_ids", "ips", "accounts",
    )


def rank(incidents: DataFrame) -> DataFrame:
    """Adds inc_idx, from 0 within a scope: by severity, then the host whose first signal is earliest, then time.

    Incidents are written, as they are read again. Only their keys are sorted, by ranges over all scopes at once, and
    numbered, a scope's numbers less its first: no scope is one task.
    """
    rows = written(incidents, "built")
    place = F.struct(F.col("start"), F.get("signals", F.lit(0))["rule_ord"], F.get("signals", F.lit(0))["first_id"])
    narrow = rows.select(*keys("host"), "start", "rank", place.alias("_place"))
    first = narrow.groupBy(*(F.col(c).alias(f"_{c}") for c in keys("host"))).agg(F.min("_place").alias("_first"))
    narrow = narrow.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys("host")]).select(*keys("host"), "start", "rank", "_first")
    placed = in_sequence(narrow, ["scope", F.desc("rank"), "_first", "host", "start"], "_n")
    placed = within_scope(placed, "_n", "inc_idx", 0).select(*(F.col(c).alias(f"_{c}") for c in keys("host", "start")), "inc_idx")
    return rows.join(placed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys("host", "start")]).drop("_scope", "_host", "_start")


def within_scope(rows: DataFrame, sequence: str, number: str, start: int) -> DataFrame:
    """rows with numbers from `start` in each scope, from one sequence over all scopes in turn."""
    least = rows.groupBy("scope").agg(F.min(sequence).alias("_least"))
    return rows.join(least, "scope").withColumn(number, (F.col(sequence) - F.col("_least") + start).cast("int")).drop(sequence, "_least")


def incidents(signals: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return rank(build(assign(signals, config.incident_window)))
