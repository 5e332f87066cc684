"""Counts per hour of event time that late events correct, by checkpoint and replay.

The state of an hour is an ordered timeline: its events by minute, with a snapshot of the count before every
`every` minutes. A run begins at the states that the run before it wrote (Parquet in the shared folder), takes
the new events in order of their arrival round, and writes the states anew:

* what arrives before an hour is published is counted before anything moves (a row for each hour and minute,
  whatever the number of events), and published;
* a late event asks the hour's timeline for the snapshot that precedes it. If the timeline still has one, it is
  restored, the sorted suffix of minutes is replayed with the late events merged in, the snapshots behind are
  renewed and the hour's output is replaced: the event is a correction. Past the cut-off the timeline has let go
  of its snapshots, so nothing can be restored: the event is kept out and reported as too late.

Events keep their identity only if they are late. Late events of a hot hour are spread over shards by a hash of
the record, as many as the hour's late events need; timelines of shards count on their own and their revisions
add up, so runs need not agree on the number of shards.

An event without event time or arrival is not judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.storage import materialize

SECOND = 1_000_000_000
MINUTE, HOUR = 60 * SECOND, 3600 * SECOND
MINUTES = HOUR // MINUTE


@dataclass(frozen=True)
class Lateness:
    """grace: an hour is published so long after its end. cutoff: it is final so long after its end.
    every: a snapshot for so many minutes of event time. round_ns: late events are taken up in such steps.
    shard_rows: late events of one hour that one shard takes."""

    grace_ns: int = 10 * MINUTE
    cutoff_ns: int = 6 * HOUR
    every: int = 10
    round_ns: int = 10 * MINUTE
    shard_rows: int = 100_000


def arrivals(extractions: DataFrame, records: DataFrame) -> DataFrame:
    """id, event_ns, arrival_ns: event_ns of the highest generation and the earliest receipt, in one exchange.

    Of several event times in the highest generation the latest holds; a null generation is the lowest."""
    times = extractions.select(
        F.try_to_binary("record_id", F.lit("hex")).alias("id"),
        F.struct(F.coalesce("generation", F.lit(-(2**31))).alias("generation"), "event_ns").alias("told"),
        F.lit(None).cast("bigint").alias("received_ns"),
    )
    receipts = records.select("id", F.lit(None).cast(times.schema["told"].dataType).alias("told"), F.col("env.received_ns").alias("received_ns"))
    return (
        times.unionByName(receipts)
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("told").alias("told"), F.min("received_ns").alias("arrival_ns"))
        .select("id", F.col("told.event_ns").alias("event_ns"), "arrival_ns")
        .where("event_ns IS NOT NULL AND arrival_ns IS NOT NULL")
    )


# --- the ordered state of an hour -----------------------------------------------------------------

class Timeline:
    """Events of one hour (in one shard) by minute, with snapshots of the count before every `every` minutes."""

    def __init__(self, rule: Lateness, hour_ns: int, minutes=None, snapshots=None):
        self.rule, self.hour_ns, self.replayed = rule, hour_ns, 0
        self.minutes = np.zeros(MINUTES, np.int64) if minutes is None else np.array(minutes, np.int64)
        self.snapshots = np.zeros(-(-MINUTES // rule.every), np.int64) if snapshots is None else np.array(snapshots, np.int64)
        self.total = int(self.snapshots[-1] + self.minutes[(len(self.snapshots) - 1) * rule.every:].sum())

    @property
    def final_ns(self) -> int:
        """When the hour's snapshots are let go."""
        return self.hour_ns + HOUR + self.rule.cutoff_ns

    def restorable(self, arrivals: np.ndarray) -> np.ndarray:
        """Which arrivals still find a snapshot to restore."""
        return arrivals < self.final_ns

    def take(self, minutes: np.ndarray, counts: np.ndarray) -> int:
        """Restore the snapshot before the earliest of the events, replay the suffix with them merged in, and renew
        the snapshots behind it; the hour's new count, which replaces the one before."""
        every = self.rule.every
        np.add.at(self.minutes, minutes, counts)
        first = int(minutes.min()) // every
        count = int(self.snapshots[first])
        for k in range(first, len(self.snapshots)):
            self.snapshots[k] = count
            count += int(self.minutes[k * every:(k + 1) * every].sum())
        self.replayed += MINUTES - first * every
        self.total = count
        return count


# --- events, states and revisions as tables -------------------------------------------------------

REVISIONS = (
    "kind string, hour_ns bigint, shard int, round bigint, id binary, before bigint, after bigint, replayed int, "
    "minutes array<bigint>, snapshots array<bigint>"
)


def collapsed(events: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """hour_ns, minute, round, arrival_ns, id, n of (id, event_ns, arrival_ns). What arrives before its hour is published
    falls together by minute (round -1, no id) before the exchange; late events stay apart."""
    start = F.col("event_ns") - F.pmod(F.col("event_ns"), F.lit(HOUR))
    timed = events.withColumn("hour_ns", start).withColumn("minute", F.expr(f"(event_ns - hour_ns) DIV {MINUTE}").cast("int"))
    since = F.col("arrival_ns") - F.col("hour_ns") - (HOUR + rule.grace_ns)
    late = since >= 0
    return timed.select(
        "hour_ns", "minute", F.when(late, F.expr(f"(arrival_ns - hour_ns - {HOUR + rule.grace_ns}L) DIV {rule.round_ns}L")).otherwise(F.lit(-1)).cast("bigint").alias("round"),
        F.when(late, F.col("arrival_ns")).alias("arrival_ns"), F.when(late, F.col("id")).alias("id"),
    ).groupBy("hour_ns", "minute", "round", "arrival_ns", "id").agg(F.count("*").alias("n"))


def published(counted: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """The first states of hours, from what was collapsed in time: a row an hour, built of at most 60 rows of it."""
    by_minute = F.map_from_entries(F.collect_list(F.struct("minute", "n")))
    minutes = F.transform(F.sequence(F.lit(0), F.lit(MINUTES - 1)), lambda m: F.coalesce(F.try_element_at("m", m), F.lit(0)).cast("bigint"))
    count = -(-MINUTES // rule.every)
    before = lambda k: F.aggregate(F.slice("minutes", 1, k * rule.every), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (
        counted.where("round < 0").groupBy("hour_ns", "minute").agg(F.sum("n").alias("n"))
        .groupBy("hour_ns").agg(by_minute.alias("m"))
        .select("hour_ns", F.lit(0).alias("shard"), minutes.alias("minutes"))
        .withColumn("snapshots", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), before))
    )


def advance(states: DataFrame, counted: DataFrame, rule: Lateness = Lateness(), watermark_ns: int | None = None) -> DataFrame:
    """Take collapsed events into the states of the run before: revisions (see REVISIONS) of one kind each:

    `publish` (an hour's count from what came in time) and `correction` (a count replaced because of late events), with
    the shard's count before and after; `late` for each late event taken up and `too_late` for each kept out, with its
    id; `state` with the timeline as it is now, for the next run. Hours final at watermark_ns hand no state on.

    An hour's timeline is restored from its row in `states`; a shard without row begins empty."""
    sizes = counted.where("round >= 0").groupBy("hour_ns").agg((1 + F.floor(F.count("*") / rule.shard_rows)).cast("int").alias("shards"))
    none = F.lit(None)
    rows = counted.join(sizes, "hour_ns", "left").select(
        "hour_ns", F.when(F.col("round") >= 0, F.pmod(F.xxhash64("id", "arrival_ns"), F.coalesce("shards", F.lit(1)))).otherwise(0).cast("int").alias("shard"),
        "round", "minute", "arrival_ns", "id", "n", none.cast("array<bigint>").alias("minutes"), none.cast("array<bigint>").alias("snapshots"),
    )
    known = states.select(
        "hour_ns", "shard", F.lit(-2).cast("bigint").alias("round"), none.cast("int").alias("minute"), none.cast("bigint").alias("arrival_ns"),
        F.lit(None).cast("binary").alias("id"), none.cast("bigint").alias("n"), "minutes", "snapshots",
    )
    ordered = known.unionByName(rows).repartition("hour_ns", "shard").sortWithinPartitions("hour_ns", "shard", "round")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, at, out = None, None, Revisions()
        for b in batches:
            hours, shards, rounds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("hour_ns", "shard", "round"))
            minutes, arrived, counts = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("minute", "arrival_ns", "n"))
            ids = b.column("id")
            change = (np.diff(hours) != 0) | (np.diff(shards) != 0) | (np.diff(rounds) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(hours)] if len(hours) else []
            for a, z in zip(edges, edges[1:]):
                key = (int(hours[a]), int(shards[a]))
                if key != at:
                    out.keep(at, line, watermark_ns)
                    line, at = Timeline(rule, key[0]), key
                if rounds[a] == -2:
                    for i in range(a, z):  # one state a shard; states of several writers add up
                        more = Timeline(rule, key[0], b.column("minutes")[i].as_py(), b.column("snapshots")[i].as_py())
                        line.minutes += more.minutes
                        line.snapshots += more.snapshots
                        line.total += more.total
                    continue
                good = line.restorable(arrived[a:z])
                if not good.all():
                    gone = np.flatnonzero(~good)
                    out.events("too_late", key, int(rounds[a]), ids.slice(a, z - a).take(pa.array(gone)), counts[a:z][gone])
                if good.any():
                    before, work = line.total, line.replayed
                    after = line.take(minutes[a:z][good], counts[a:z][good])
                    out.revised("publish" if rounds[a] < 0 else "correction", key, int(rounds[a]), before, after, line.replayed - work)
                    if rounds[a] >= 0:
                        out.events("late", key, int(rounds[a]), ids.slice(a, z - a).filter(pa.array(good)), counts[a:z][good])
            if len(out):
                yield out.batch()
        out.keep(at, line, watermark_ns)
        if len(out):
            yield out.batch()

    names = ["hour_ns", "shard", "round", "minute", "arrival_ns", "id", "n", "minutes", "snapshots"]
    return ordered.select(names).mapInArrow(run, REVISIONS)


class Revisions:
    """Columns of what a run tells."""

    TYPES = (
        pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()),
    )
    NAMES = [c.split()[0] for c in REVISIONS.split(", ")]

    def __init__(self):
        self.columns: list[list] = [[] for _ in self.NAMES]

    def __len__(self) -> int:
        return len(self.columns[0])

    def _row(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def keep(self, key: tuple[int, int] | None, line: Timeline | None, watermark_ns: int | None) -> None:
        if line is not None and (watermark_ns is None or line.final_ns > watermark_ns):
            self._row("state", *key, None, None, None, line.total, None, line.minutes.tolist(), line.snapshots.tolist())

    def revised(self, kind: str, key: tuple[int, int], round_: int, before: int, after: int, replayed: int) -> None:
        self._row(kind, *key, round_, None, before, after, replayed, None, None)

    def events(self, kind: str, key: tuple[int, int], round_: int, ids: pa.Array, counts: np.ndarray) -> None:
        for id_, n in zip(ids.to_pylist(), counts.tolist()):
            self._row(kind, *key, round_, id_, None, n, None, None, None)

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(self.columns, self.TYPES)]
        self.columns = [[] for _ in self.NAMES]
        return pa.RecordBatch.from_arrays(arrays, self.NAMES)


def states_of(revisions: DataFrame) -> DataFrame:
    """The states that a run hands on to the next."""
    return revisions.where("kind = 'state'").select("hour_ns", "shard", "minutes", "snapshots")


def replay(events: DataFrame, rule: Lateness = Lateness(), states: DataFrame | None = None) -> DataFrame:
    """Revisions of (id, event_ns, arrival_ns) in two runs. The first publishes what came in time on top of the states
    given and writes the timelines to the shared folder; the second restores them and takes up the late events."""
    counted = materialize(collapsed(events, rule), "late-events")
    if states is None:
        first = materialize(published(counted, rule), "late-states")
        outputs = first.select(
            F.lit("publish").alias("kind"), "hour_ns", "shard", F.lit(-1).cast("bigint").alias("round"), F.lit(None).cast("binary").alias("id"),
            F.lit(0).cast("bigint").alias("before"), F.aggregate("minutes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("after"),
            F.lit(MINUTES).alias("replayed"), F.lit(None).cast("array<bigint>").alias("minutes"), F.lit(None).cast("array<bigint>").alias("snapshots"),
        )
    else:
        run = materialize(advance(states, counted.where("round < 0"), rule), "late-states")
        first, outputs = states_of(run), run.where("kind <> 'state'")
    return advance(first, counted.where("round >= 0"), rule).unionByName(outputs)


def fates(revisions: DataFrame) -> DataFrame:
    """record_id, fate: what happened to each late event."""
    return revisions.where(F.col("kind").isin("late", "too_late")).select(
        F.lower(F.hex("id")).alias("record_id"), F.when(F.col("kind") == "late", "correction").otherwise("too_late").alias("fate")
    )


def hours(revisions: DataFrame) -> DataFrame:
    """One row for each hour: its first count, its count as corrected, the rounds that corrected it, and what was kept out."""
    revised = F.col("kind").isin("publish", "correction")
    return revisions.where("kind <> 'state'").groupBy("hour_ns").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "publish", F.col("after") - F.col("before"))), F.lit(0)).alias("published"),
        F.coalesce(F.sum(F.when(revised, F.col("after") - F.col("before"))), F.lit(0)).alias("corrected"),
        F.count_distinct(F.when(F.col("kind") == "correction", F.col("round"))).alias("corrections"),
        F.coalesce(F.sum(F.when(F.col("kind") == "too_late", F.col("after"))), F.lit(0)).alias("too_late"),
    )


def revisions_of_hours(revisions: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """hour_ns, revised_ns, count: every output of an hour in order, each replacing the one before."""
    changes = (
        revisions.where(F.col("kind").isin("publish", "correction"))
        .groupBy("hour_ns", "round")
        .agg(F.sum(F.col("after") - F.col("before")).alias("change"))
    )
    # at most one row a round until the cut-off, so a window over an hour is small whatever the hour's events
    running = Window.partitionBy("hour_ns").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    published_ns = F.col("hour_ns") + HOUR + rule.grace_ns
    return changes.select(
        "hour_ns", F.when(F.col("round") < 0, published_ns).otherwise(published_ns + (F.col("round") + 1) * rule.round_ns).alias("revised_ns"),
        F.sum("change").over(running).alias("events"),
    )


def judged(extractions: DataFrame, records: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    return replay(arrivals(extractions, records), rule)
