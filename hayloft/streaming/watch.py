"""Watching for changes: debounced sessions of file events, synced micro-batch by micro-batch.

Events have path_key, action (upsert, delete), ts.  The watermark only bounds
the session state.  Each micro-batch is a change list; the batch id makes a
repeated batch harmless, as unchanged files are skipped by their hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

DEBOUNCE, LATE = "300 milliseconds", "1 minute"


def coalesced(events: DataFrame, gap: str = DEBOUNCE, late: str = LATE, ties: tuple[str, ...] = ()) -> DataFrame:
    """path_key, action, started, ts, n: the last action of each path in each burst, and when it began and ended.

    Works on streams and tables.  Of events at the same time the one with the
    largest ``ties`` columns is the last.
    """
    source = events.withWatermark("ts", late) if events.isStreaming else events
    burst = source.groupBy("path_key", F.session_window("ts", gap).alias("burst"))
    last = F.max_by("action", F.struct("ts", *ties) if ties else F.col("ts"))
    return burst.agg(last.alias("action"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).select("path_key", "action", F.col("burst.start").alias("started"), F.col("last_ts").alias("ts"), "n")


def change_list(batch: DataFrame) -> DataFrame:
    """One action per path: the latest of a micro-batch."""
    return batch.groupBy("path_key").agg(F.max_by("action", "ts").alias("action"))


def watch(events: DataFrame, on_changes: Callable[[DataFrame, int], None], checkpoint: str, gap: str = DEBOUNCE) -> StreamingQuery:
    """Runs ``on_changes`` on the change list of every micro-batch with what is available, then stops.

    A failing callback leaves the batch in the checkpoint; the next run repeats it.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            on_changes(change_list(batch), number)

    return coalesced(events, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


#: When a whole sync makes good what events missed: at the latest, and after quiet.
FULL_MS, IDLE_MS = 300_000, 120_000


class Reconcile(StatefulProcessor):
    """Says when a root is due for a whole sync, by one timer for each root.

    Events are ``change`` (work is pending), ``synced`` (the pending work is done)
    and anything else (a sign of life).  Due: ``FULL_MS`` after the last whole
    sync, or ``IDLE_MS`` after the last event if the last whole sync is as long ago; the
    first event starts both clocks.  While work is pending nothing is due; a timer that
    ran out meanwhile is taken up as soon as ``synced`` comes.
    """

    def __init__(self, processing_time: bool, full_ms: int = FULL_MS, idle_ms: int = IDLE_MS):
        self._processing, self._full, self._idle = processing_time, full_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("clock", "whole long, event long, pending boolean")

    def _now(self, timerValues) -> int:  # noqa: N803
        return timerValues.getCurrentProcessingTimeInMs() if self._processing else timerValues.getCurrentWatermarkInMs()

    def _due(self, whole: int, event: int) -> int:
        return min(whole + self._full, max(event, whole) + self._idle)

    def _set(self, at: int) -> None:
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        self._handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")
        # a watermark lags behind the events of its own batch
        now = self._now(timerValues) if self._processing else max(self._now(timerValues), int(arrived.ms.max()))
        seen = now
        whole, _, pending = self._state.get() if self._state.exists() else (seen, seen, False)
        for event in arrived.event:
            pending = True if event == "change" else False if event == "synced" else pending
        self._state.update((whole, seen, pending))
        # a time that has passed runs out with the next batch
        self._set(max(self._due(whole, seen), now + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole, event, pending = self._state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if pending:
            return  # the next event sets a timer again
        reason = "full" if at >= whole + self._full else "idle"
        self._state.update((at, event, False))
        self._set(self._due(at, event))
        yield pd.DataFrame({"root": [key[0]], "due_ms": [at], "reason": [reason]})

    def close(self) -> None:
        pass


def reconciles(events: DataFrame, full_ms: int = FULL_MS, idle_ms: int = IDLE_MS, processing_time: bool = True, late: str = "0 seconds") -> DataFrame:
    """root, due_ms, reason (full, idle): whole syncs that fall due, from a stream of root, event, ts.

    Timers run by the clock of the machine, or with ``processing_time`` off by the watermark of ``ts``.
    """
    rows = events.select("root", "event", "ts", F.unix_millis("ts").alias("ms"))
    rows = rows if processing_time else rows.withWatermark("ts", late)
    mode = "ProcessingTime" if processing_time else "EventTime"
    return rows.groupBy("root").transformWithStateInPandas(Reconcile(processing_time, full_ms, idle_ms), "root string, due_ms long, reason string", "Append", mode)


#: How many latest values the percentiles are of.
KEPT = 200


def nearest_rank(ordered: Column, p: float) -> Column:
    """The nearest-rank percentile of a sorted array; null of an empty one."""
    return F.get(ordered, F.floor((F.size(ordered) - 1) * F.lit(p) + 0.5).cast("int"))


def running_percentiles(events: DataFrame, by: str, order: list[str], keep: int = KEPT) -> DataFrame:
    """Each event with p50 and p95 of its own and the ``keep`` - 1 values before it, by key: the table form."""
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - keep, 0)
    latest = events.withColumn("_v", F.array_sort(F.collect_list("value").over(frame)))
    return latest.withColumn("p50", nearest_rank(F.col("_v"), 0.5)).withColumn("p95", nearest_rank(F.col("_v"), 0.95)).drop("_v")


class RollingPercentiles(StatefulProcessor):
    """Nearest-rank p50 and p95 of the last 200 values of a key, after each micro-batch."""

    KEEP = KEPT

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self._last.get()[0]) if self._last.exists() else []
        for part in rows:
            held += part.sort_values("ts").value.tolist()
            held = held[-self.KEEP :]
        self._last.update((held,))
        ordered = sorted(held)
        at = lambda p: ordered[int((len(ordered) - 1) * p + 0.5)]
        yield pd.DataFrame({"key": [key[0]], "n": [len(held)], "p50": [at(0.5)], "p95": [at(0.95)]})

    def close(self) -> None:
        pass


def rolling_percentiles(events: DataFrame) -> DataFrame:
    """key, n, p50, p95 per micro-batch from a stream of key (string), ts, value."""
    return events.groupBy("key").transformWithStateInPandas(RollingPercentiles(), "key string, n long, p50 double, p95 double", "Update", "None")
