"""Incidents on different hosts to campaigns: shared addresses or accounts, near in time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.operators.incidents import within_scope
from logtrail.schema import DEFAULT, GENERIC_ACCOUNTS, Config
from logtrail.sources.scratch import in_sequence, shared_dir, written


def entities(incidents: DataFrame) -> DataFrame:
    """scope, inc_idx, kind, entity: the addresses and named accounts of each incident, carried by its signals."""
    users = F.array_distinct(F.filter(F.transform("accounts", lambda u: F.lower(F.trim(u))), lambda u: (u != "") & ~u.isin(*GENERIC_ACCOUNTS)))
    kinds = F.concat(F.transform("ips", lambda x: F.struct(F.lit("ip").alias("kind"), x.alias("entity"))), F.transform(users, lambda x: F.struct(F.lit("user").alias("kind"), x.alias("entity"))))
    return incidents.select("scope", "inc_idx", F.explode(F.array_distinct(kinds)).alias("e")).select("scope", "inc_idx", "e.kind", "e.entity")


def infrastructure(found: DataFrame, incidents: DataFrame, least: int = DEFAULT.infra_least) -> DataFrame:
    """scope, kind, entity: addresses in at least `least` incidents and more than half of all incidents of the scope."""
    total = incidents.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    counts = found.filter("kind = 'ip'").groupBy("scope", "kind", "entity").agg(F.count_distinct("inc_idx").alias("n"))
    return counts.join(total, "scope").filter((F.col("n") >= least) & (2 * F.col("n") > F.col("total"))).select("scope", "kind", "entity")


def without_infrastructure(found: DataFrame, incidents: DataFrame, least: int = DEFAULT.infra_least) -> DataFrame:
    """Without addresses that are infrastructure."""
    return found.join(infrastructure(found, incidents, least), ["scope", "kind", "entity"], "left_anti")


def near(a_start: Column, a_end: Column, b_start: Column, b_end: Column, within: timedelta) -> Column:
    """Overlapping, or at most `within` apart."""
    return (a_start <= b_end + within) & (b_start <= a_end + within)


def _spans(incidents: DataFrame, within: timedelta) -> DataFrame:
    """Incidents by time slot: intervals stretched by `within` meet exactly where they share a slot of that width."""
    width = max(1, int(within.total_seconds()))
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000 / width)
    return incidents.select("scope", "inc_idx", "host", "start", "end", F.explode(F.sequence(seconds("start"), seconds("end") + 1)).alias("slot"))


def pairs(found: DataFrame, incidents: DataFrame, within: timedelta = DEFAULT.campaign_window) -> DataFrame:
    """scope, a, b (a < b): incidents on different hosts near in time that share an entity.

    An equality join on entity and time slot with a range condition, so an entity seen for years is many small groups
    rather than one. All pairs are for those who ask for them; campaigns are found from `edges`, of which there are few.
    """
    side = found.join(_spans(incidents, within), ["scope", "inc_idx"])
    a, b = (side.select("scope", "kind", "entity", "slot", *(F.col(c).alias(f"{x}_{c}") for c in ("inc_idx", "host", "start", "end"))) for x in "ab")
    linked = a.join(b, ["scope", "kind", "entity", "slot"]).filter((F.col("a_inc_idx") < F.col("b_inc_idx")) & ~F.col("a_host").eqNullSafe(F.col("b_host")))
    linked = linked.filter(near(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"), within))
    return linked.select("scope", F.col("a_inc_idx").alias("a"), F.col("b_inc_idx").alias("b")).distinct()


class Sweep:
    """Incidents of one entity in order of start, merged into groups as they come near one of another host.

    A group keeps one member and the two latest ends of distinct hosts: that is all that decides whether a later incident
    is near one of its members on another host. Groups that nothing later can reach are dropped; those left apart are of
    one and the same host, so there are never many.
    """

    NEVER = -(1 << 62)

    def __init__(self, within: int) -> None:
        self.within, self.groups = within, []

    def add(self, incident: int, host: str | None, start: int, end: int) -> list[tuple[int, int]]:
        """Edges that join this incident to the groups it is near to: one for each."""
        edges, left, own = [], [], [incident, end, host, self.NEVER, None]
        for group in self.groups:
            member, first, first_host, second, second_host = group
            if (second if first_host == host else first) + self.within >= start:
                edges.append((min(member, incident), max(member, incident)))
                own[0] = min(own[0], member)
                self._merge(own, first, first_host)
                self._merge(own, second, second_host)
            elif first + self.within >= start:
                left.append(group)
        self.groups = [*left, own]
        return edges

    @staticmethod
    def _merge(group: list, end: int, host: str | None) -> None:
        if host == group[2]:
            group[1] = max(group[1], end)
        elif end > group[1]:
            group[1:] = [end, host, group[1], group[2]]
        elif end > group[3]:
            group[3:] = [end, host]


def edges(found: DataFrame, incidents: DataFrame, within: timedelta = DEFAULT.campaign_window) -> DataFrame:
    """scope, a, b (a < b) of entity_edges."""
    return entity_edges(found, incidents, within).select("scope", "a", "b").distinct()


def entity_edges(found: DataFrame, incidents: DataFrame, within: timedelta = DEFAULT.campaign_window) -> DataFrame:
    """scope, kind, entity, a, b (a < b): edges that, for each entity, connect the same incidents as all `pairs` do.

    There are at most a few for each row of found. Rows are dealt by entity and time slot and sorted there by start, and a sweep over them holds a few groups only,
    however many incidents share an entity. Incidents that are near meet in a slot, as for pairs.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    key = ["scope", "kind", "entity", "slot"]
    side = found.join(_spans(incidents, within), ["scope", "inc_idx"]).select(*key, "inc_idx", "host", us("start").alias("start"), us("end").alias("end"))
    width = int(within.total_seconds() * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sweep = None, Sweep(width)
        for batch in batches:
            out = []
            for scope, kind, entity, slot, incident, host, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (scope, kind, entity, slot) != last:
                    last, sweep = (scope, kind, entity, slot), Sweep(width)
                out += [(scope, kind, entity, a, b) for a, b in sweep.add(incident, host, start, end)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["scope", "kind", "entity", "a", "b"])

    return side.repartition(*key).sortWithinPartitions(*key, "start", "inc_idx").mapInArrow(run, "scope string, kind string, entity string, a int, b int").distinct()


#: Edges up to which one task finds the components, in memory; more are labelled in rounds of joins.
EDGES_A_TASK = 200_000


def _in_a_task(linked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for scope, *ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = sorted((root(above.setdefault((scope, i), (scope, i))) for i in ends), key=lambda n: n[1])
                above[high] = low
        rows = [(scope, i, root((scope, i))[1]) for scope, i in above]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["scope", "inc_idx", "root"])

    return linked.coalesce(1).mapInArrow(run, "scope string, inc_idx int, root int")


def components(linked: DataFrame) -> DataFrame:
    """scope, inc_idx, root (the smallest of its component) of edges (scope, a, b).

    Few edges are one task's work. Of more, the smallest label spreads until nothing changes: a round joins labels with
    edges and follows labels of labels, so long chains shorten by half; checkpoints cut the lineage and outlive executors.
    """
    linked = written(linked.select("scope", "a", "b"), "edges")
    if linked.count() <= EDGES_A_TASK:
        return _in_a_task(linked)
    return _in_rounds(linked)


def _in_rounds(linked: DataFrame) -> DataFrame:
    context = linked.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(linked.sparkSession))
    both = linked.unionByName(linked.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.groupBy("scope", "a").agg(F.least(F.col("a"), F.min("b")).alias("root")).checkpoint()
    while True:
        around = both.join(labels.select("scope", F.col("a").alias("b"), "root"), ["scope", "b"]).groupBy("scope", "a").agg(F.min("root").alias("near"))
        new = labels.join(around, ["scope", "a"]).select("scope", "a", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = new.select("scope", F.col("a").alias("root"), F.col("root").alias("further"))
        new = new.join(jump, ["scope", "root"]).select("scope", "a", F.least("root", "further").alias("root"), "old").checkpoint()
        changed = new.filter("root <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels.withColumnRenamed("a", "inc_idx")


def number(roots: DataFrame) -> DataFrame:
    """scope, inc_idx, campaign_id: 1, 2 ... by the smallest incident of each component of two or more."""
    ids = within_scope(in_sequence(roots.select("scope", "root").distinct(), ["scope", "root"], "_n"), "_n", "campaign_id", 1)
    return roots.join(ids, ["scope", "root"]).select("scope", "inc_idx", "campaign_id")


def tag(incidents: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """incidents with campaign_id, null for those in no campaign."""
    found = without_infrastructure(entities(incidents), incidents, config.infra_least)
    numbered = number(components(edges(found, incidents, config.campaign_window)))
    return incidents.join(numbered, ["scope", "inc_idx"], "left")


def members(tagged: DataFrame) -> DataFrame:
    """scope, campaign_id, members (start, inc_idx, host, techniques) in order: a row for each campaign, nothing copied."""
    member = F.struct("start", "inc_idx", "host", "techniques")
    return tagged.filter("campaign_id IS NOT NULL").groupBy("scope", "campaign_id").agg(F.array_sort(F.collect_list(member)).alias("members"))


def related(tagged: DataFrame) -> DataFrame:
    """tagged with related_hosts and campaign_peers, empty for those in no campaign.

    Each incident gets all other members of its campaign, as the reports on single incidents want it: the square of a
    campaign's size. Work on campaigns as such uses tag and members.
    """
    out = tagged.join(members(tagged), ["scope", "campaign_id"], "left")
    others = F.transform(F.filter("members", lambda m: m["inc_idx"] != F.col("inc_idx")), lambda m: F.struct(m["host"].alias("host"), m["start"].alias("start"), m["techniques"].alias("techniques")))
    hosts = F.transform(F.filter("members", lambda m: ~m["host"].eqNullSafe(F.col("host"))), lambda m: m["host"])
    return out.withColumn("related_hosts", F.coalesce(hosts, F.array().cast("array<string>"))).withColumn("campaign_peers", F.coalesce(others, F.filter(F.array(F.struct("host", "start", "techniques")), lambda x: F.lit(False)))).drop("members")


def link(incidents: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """incidents with campaign_id, related_hosts and campaign_peers; null and empty for those in no campaign."""
    return related(tag(incidents, config))
