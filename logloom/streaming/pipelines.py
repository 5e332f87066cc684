"""The engine on streams: the same plans, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators.archive import Ledger, identified
from logloom.operators.late import HOUR, MINUTE, Lateness, Timeline
from logloom.plans import derive as plans
from logloom.plans.grammar import Library
from logloom.sources.lines import Bucket
from logloom.storage import discard

Sink = Callable[[DataFrame, int], None]


class Failures(Exception):
    """What single sinks of a batch raised; the others were served."""


def serve(lines: DataFrame, library: Library, sinks: dict[str, Sink], checkpoint: str, archive: str | None = None, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Run deliveries (payload, env) through the engine: bytes are stored first, then read and handed to the sinks.

    With an archive (a folder, see Ledger) a batch is an append: known bytes add to `seen` and are not derived again, new
    ones are numbered and sealed. Without one every delivery is derived. Grammars that have changed are taken up at the next
    batch. A sink's failure does not keep the others from their batch; it is raised when all are done, so that the batch is
    tried again, for which its append stands."""
    def batch(df: DataFrame, number: int) -> None:
        library.refresh()
        if archive:
            order = F.struct(F.coalesce("env.received_ns", F.lit(0)), F.xxhash64("payload", "env.peer"))
            rows = Ledger(df.sparkSession, archive).append(df.withColumn("ord", order), number)
        else:
            rows = identified(df).withColumns({"stratum": F.lit(-1), "seq": F.lit(None).cast("bigint")})
        derived = plans.derive(rows, library)
        wrong = {}
        for name, sink in sinks.items():
            try:
                sink(derived, number)
            except Exception as e:  # any sink may fail in its own way
                wrong[name] = e
        discard(derived)
        if wrong:
            raise Failures("; ".join(f"{k}: {v}" for k, v in wrong.items()))

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Progress(StreamingQueryListener):
    """Rows and rate of each micro-batch, handed to a function as they are told."""

    def __init__(self, tell: Callable[[dict[str, Any]], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"event": "started", "query": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"event": "progress", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"event": "ended", "query": str(event.id), "error": event.exception})


def _timeout(expire: bool) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout


def rate_limited(deliveries: DataFrame, rate: float, burst: float, expire: bool = True) -> DataFrame:
    """seq, peer, admitted on a stream of (seq, peer, received_ns): a token bucket for each peer as its state.

    A peer's deliveries of one micro-batch are ordered by receipt, so two numbers a row are held while it lasts. A peer
    that is silent for as long as its bucket takes to fill has a full one again: its state goes. A run with the
    availableNow trigger does not end while states wait for their time, so it passes expire=False."""
    refill_ms = max(1, min(int(burst / rate * 1000), 2**53)) if expire and rate > 0 else None

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(rate, burst)
        if state.exists:
            bucket.tokens, bucket.at = state.get
        held = [(p.received_ns.to_numpy(), p.seq.to_numpy()) for p in parts]
        received, seq = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((seq, received))
        admitted = [bucket.take(t) for t in received[order].tolist()]
        state.update((bucket.tokens, bucket.at))
        if refill_ms:
            state.setTimeoutDuration(refill_ms)
        yield pd.DataFrame({"seq": seq[order], "peer": key[0], "admitted": admitted})

    return deliveries.groupBy("peer").applyInPandasWithState(
        take, "seq bigint, peer string, admitted boolean", "tokens double, at bigint", "append", _timeout(bool(refill_ms))
    )


def hourly(events: DataFrame, rule: Lateness = Lateness(), shards: int = 16, expire: bool = True) -> DataFrame:
    """hour_ns, shard, before, after, too_late on a stream of (event_ns, arrival_ns): each batch's late events
    restore the checkpoint before them, replay the suffix of minutes and replace the hour's count.

    The state of an hour and shard is its timeline by minute with its snapshots, a few hundred bytes; it goes when the
    hour has been still for as long as its cut-off. Rows tell changes, so those of an hour add up over shards, and over
    a state that has gone and begun again. A run with the availableNow trigger passes expire=False, as above."""
    placed = events.select(
        "event_ns", "arrival_ns", (F.col("event_ns") - F.pmod(F.col("event_ns"), F.lit(HOUR))).alias("hour_ns"),
        F.pmod(F.xxhash64("event_ns", "arrival_ns"), F.lit(shards)).cast("int").alias("shard"),
    )

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hour = int(key[0])
        line = Timeline(rule, hour, *(state.get if state.exists else ()))
        before, out = line.total, 0
        for rows in parts:
            good = line.restorable(rows.arrival_ns.to_numpy())
            out += int((~good).sum())
            if good.any():
                minutes, counts = np.unique((rows.event_ns.to_numpy()[good] - hour) // MINUTE, return_counts=True)
                line.take(minutes, counts)
        state.update((line.minutes.tolist(), line.snapshots.tolist()))
        if expire:
            state.setTimeoutDuration(max(1, rule.cutoff_ns // 1_000_000))
        yield pd.DataFrame({"hour_ns": [hour], "shard": [key[1]], "before": [before], "after": [line.total], "too_late": [out]})

    return placed.groupBy("hour_ns", "shard").applyInPandasWithState(
        take, "hour_ns bigint, shard int, before bigint, after bigint, too_late bigint", "minutes array<bigint>, snapshots array<bigint>",
        "append", _timeout(expire),
    )


def windowed_counts(events: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Counts of a key by tumbling or sliding windows of event time, kept until the watermark passes."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), key, "n"
    )
