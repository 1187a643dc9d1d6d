"""The rules over a stream of raw records or events."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from logtrail.operators.normalize import normalize
from logtrail.operators.rules import row_signals
from logtrail.schema import DEFAULT, Config


def stream_signals(raw: DataFrame) -> DataFrame:
    """Raw records to the signals of rules on single events: append mode, no state."""
    return row_signals(normalize(raw).filter(F.col("time").isNotNull()).withColumn("id", F.col("ordinal").cast("long")))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """State with lists, values and timers needs the store on disk; set before a query that keeps it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Rows of a key in order of time, however they came: each waits until the watermark is past it.

    Nothing that is still to come and not late is older then, so what `step` and `settle` make of the rows is what a
    batch makes of them. rows: columns of a row that wait with its time (microseconds), in their order among equal times.
    """

    rows: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", f"t long, {self.rows}")

    def step(self, row: tuple) -> list[tuple]:
        """What a row, the next in time, brings to an end."""
        raise NotImplementedError

    def settle(self, mark: int) -> tuple[list[tuple], int | None]:
        """What ends as no row before mark (microseconds) can come any more, and until when something stays open."""
        raise NotImplementedError

    def done(self) -> bool:
        return False

    def _advance(self, key: tuple, fresh: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        held = sorted([*(tuple(x) for x in self.waiting.get()), *fresh]) if self.waiting.exists() else sorted(fresh)
        ready = [x for x in held if x[0] < mark]
        out = [x for row in ready for x in self.step(row)]
        more, until = self.settle(mark)
        left = [] if self.done() else held[len(ready) :]
        if left:
            self.waiting.put(left)
        elif self.waiting.exists():
            self.waiting.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if wake := [x for x in (left[0][0] if left else None, until) if x is not None]:
            self.handle.registerTimer(max(min(wake), mark) // 1000 + 1)
        if rows := [(*key, *x) for x in (*out, *more)]:
            yield pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names = ["t", *(c.split()[0] for c in self.rows.split(", "))]
        fresh = [tuple(x.item() if hasattr(x, "item") else x for x in r) for f in rows for r in f[names].itertuples(index=False, name=None)]
        yield from self._advance(key, [] if self.done() else fresh, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], 1000 * timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class FirstBurst(InOrder):
    """State of a key: rows that wait, the last few times, the open burst, and whether it was reported."""

    rows = "id long"
    columns = ["scope", "host", "user", "src_ip", "n", "event_ids", "time"]

    def __init__(self, count: int, width: int) -> None:
        self.count, self.width = count, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent, self.burst = handle.getListState("recent", "t long, id long"), handle.getListState("burst", "t long, id long")
        self.told = handle.getValueState("told", "told boolean")

    def done(self) -> bool:
        return self.told.exists()

    def step(self, row: tuple) -> list[tuple]:
        if self.done():
            return []
        if self.burst.exists():
            first = next(iter(self.burst.get()))[0]
            if row[0] - first <= self.width:
                self.burst.appendValue(row)
                return []
            return self._report()
        last = [*(tuple(x) for x in self.recent.get()), row] if self.recent.exists() else [row]
        if len(last) >= self.count and row[0] - last[-self.count][0] <= self.width:
            self.burst.put(last[-self.count :])
            self.recent.clear()
        else:
            self.recent.put(last[1 - self.count :] if self.count > 1 else [row])
        return []

    def settle(self, mark: int) -> tuple[list[tuple], int | None]:
        if self.done() or not self.burst.exists():
            return [], None
        end = next(iter(self.burst.get()))[0] + self.width
        return (self._report(), None) if end < mark else ([], end)

    def _report(self) -> list[tuple]:
        events = sorted(tuple(x) for x in self.burst.get())
        self.burst.clear()
        self.told.update((True,))
        return [(len(events), [i for _, i in events], pd.Timestamp(events[0][0], unit="us"))]


class OpenIncident(InOrder):
    """State of a host: rows that wait, and the open incident."""

    rows = "rule_ord int, id long, technique string"
    columns = ["scope", "host", "start", "end", "n", "techniques"]

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "start long, end long, n long, techniques array<string>")

    def step(self, row: tuple) -> list[tuple]:
        t, technique, ended = row[0], row[3], []
        if self.open.exists():
            start, _, n, techniques = self.open.get()
            if t - start <= self.width:
                self.open.update((start, t, n + 1, [*techniques, *([] if technique in techniques else [technique])]))
                return []
            ended = self._close()
        self.open.update((t, t, 1, [technique]))
        return ended

    def settle(self, mark: int) -> tuple[list[tuple], int | None]:
        if not self.open.exists():
            return [], None
        end = self.open.get()[0] + self.width
        return (self._close(), None) if end < mark else ([], end)

    def _close(self) -> list[tuple]:
        start, end, n, techniques = self.open.get()
        self.open.clear()
        return [(pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n, list(techniques))]


def stream_brute_force(events: DataFrame, late: str = "10 minutes", config: Config = DEFAULT) -> DataFrame:
    """The first burst of failed logons of each key: `brute_count` within `brute_window`; emitted once it is over.

    Equal to the batch rule on all rows that are not later than the watermark; those are dropped and counted (LateRows).
    A key that was reported stays known, as the batch rule reports a key once.
    """
    state_store(events.sparkSession)
    failed = events.withWatermark("time", late).filter("event_id = 4625")
    keyed = failed.select("scope", "host", "user", "src_ip", "id", F.unix_micros("time").alias("t"), "time")
    processor = FirstBurst(config.brute_count, int(config.brute_window.total_seconds() * 1_000_000))
    out = "scope string, host string, user string, src_ip string, n long, event_ids array<long>, time timestamp"
    return keyed.groupBy("scope", "host", "user", "src_ip").transformWithStateInPandas(processor, out, "Append", "EventTime")


def stream_spray(events: DataFrame, config: Config = DEFAULT, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Hosts with `spray_count` failed pre-authentications: update mode. Without a window the state never ends, as the
    batch rule has none; with one, counts are by window and the watermark closes them."""
    some = events.filter("event_id = 4771")
    if window:
        grouped = some.withWatermark("time", late).groupBy("scope", "host", F.window("time", window))
    else:
        grouped = some.groupBy("scope", "host")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("time")).filter(F.col("n") >= config.spray_count)


def stream_incidents(signals: DataFrame, late: str = "10 minutes", window: timedelta = DEFAULT.incident_window) -> DataFrame:
    """Incidents per host, anchored at their first signal, emitted when the watermark passes anchor + window.

    signals: scope, host, time, technique and, for the order among equal times, rule_ord and event_ids if there are such.
    """
    state_store(signals.sparkSession)
    order = F.col("rule_ord").cast("int") if "rule_ord" in signals.columns else F.lit(0)
    first = F.get("event_ids", F.lit(0)) if "event_ids" in signals.columns else F.lit(0).cast("long")
    keyed = signals.withWatermark("time", late).select("scope", "host", F.unix_micros("time").alias("t"), order.alias("rule_ord"), first.alias("id"), "technique", "time")
    processor = OpenIncident(int(window.total_seconds() * 1_000_000))
    return keyed.groupBy("scope", "host").transformWithStateInPandas(processor, "scope string, host string, start timestamp, end timestamp, n long, techniques array<string>", "Append", "EventTime")


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, by query name: `with LateRows(spark) as late:` around the queries."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dropped = spark, {}

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def count(self, query: StreamingQuery) -> int:
        """Of a query that has ended: its progress may be reported a little later than its end."""
        reported = lambda: sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
        for _ in range(100):
            if self.dropped.get(query.name, 0) >= reported():
                break
            time.sleep(0.1)
        return self.dropped.get(query.name, 0)
