"""Stages of running commands as a stream: a stack for each source, throttled counts, notices of silence by timers.

Events have the columns source, at (timestamp), seq, kind (start, count, end, fail, note), label, completed, total, unit and message.
The state of a source is kept by Spark's state store: the stack as a list, the time at which each count was last shown as a map, and the
time of the last output. One timer a source stands at the next notice; it moves when something is shown, and fires without a new event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "source string, at timestamp, seq long, kind string, label string, completed long, total long, unit string, message string"
SHOWN = "source string, at double, kind string, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STACK = "label string, completed long, total long, unit string, started double, measured double"


def described(label: str | None, completed: int | None, total: int | None, unit: str | None) -> str:
    """A stage as it is shown: its label and how far it is."""
    if total is not None:
        return f"{label}; {completed or 0}/{total} {unit or 'items'}"
    return f"{label}; {completed} {unit or 'items'}" if completed else str(label)


class StageNotices(StatefulProcessor):
    """Rows to show of one source. A count is shown at most once in ``gap`` seconds for each label; while a stage is open and nothing has been
    shown for ``wait`` seconds, a notice names the innermost stage, and so on every ``wait`` seconds."""

    def __init__(self, wait: float, gap: float, by_event_time: bool, forget: float):
        self.wait, self.gap, self.by_event_time, self.forget = wait, gap, by_event_time, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stack = handle.getListState("stack", _STACK)
        self.last = handle.getValueState("last", "at double")
        # only processing time lets state expire by itself; a label that was not counted for so long is shown at once anyway
        expiry = None if self.by_event_time else int(1000 * max(self.forget, self.gap))
        self.counts = handle.getMapState("counts", "label string", "at double", expiry)

    def _open(self) -> list[tuple]:
        return [tuple(s) for s in self.stack.get()] if self.stack.exists() else []

    def _keep(self, stack: list[tuple]) -> None:
        self.stack.put(stack) if stack else self.stack.clear()

    def _notice(self, stack: list[tuple], at: float) -> tuple:
        label, completed, total, unit, started, measured = stack[-1]
        since = "no measured progress yet" if measured is None else f"last measured progress {at - measured:.1f}s ago"
        return at, "waiting", f"waiting: {described(label, completed, total, unit)}; stage elapsed {at - started:.1f}s; {since}"

    def _apply(self, stack: list[tuple], event: tuple, now: float) -> Iterator[tuple]:
        kind, label, completed, total, unit, message = event
        places = [i for i, s in enumerate(stack) if s[0] == label]
        if kind == "start":
            stack.append((label, completed or 0, total, unit, now, None))
            yield now, kind, described(*stack[-1][:4])
        elif kind == "count" and places:
            i = places[-1]
            _, before, known, known_unit, started, measured = stack[i]
            stack[i] = (label, completed, known if total is None else total, unit or known_unit, started, measured if completed == before else now)
            if label not in self.known:  # the store is asked once for each label and batch
                self.known[label] = self.counts.getValue((label,))
            shown = self.known[label]
            if shown is None or now - shown[0] >= self.gap:
                self.known[label] = self.fresh[label] = (now,)
                yield now, kind, described(*stack[i][:4])
        elif kind in ("end", "fail") and places:  # the innermost of that label; a failure leaves the enclosing stage open, too
            done = stack.pop(places[-1])
            yield now, kind, f"{described(*done[:4])}; {'failed' if kind == 'fail' else 'finished'} in {now - done[4]:.1f}s"
        elif kind == "note":
            yield now, kind, message

    def _alarm(self, stack: list[tuple], last: float) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stack:
            self.handle.registerTimer(round(1000 * (last + self.wait)))

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["source", "at", "kind", "text"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ("seconds", "seq", "kind", "label", "completed", "total", "unit", "message")
        events = [e for frame in rows for e in zip(*[frame[c].tolist() for c in columns], strict=True)]
        events.sort(key=lambda e: e[:2])
        stack, out = self._open(), []
        self.known, self.fresh = {}, {}
        last = self.last.get()[0] if self.last.exists() else None
        for at, _, *event in events:
            now = float(at) if self.by_event_time else timerValues.getCurrentProcessingTimeInMs() / 1000
            event = [None if v is None or v != v else int(v) if i in (2, 3) else v for i, v in enumerate(event)]
            while self.by_event_time and stack and last + self.wait < now:  # what the timer would have said before this event
                last += self.wait
                out.append(self._notice(stack, last))
            shown = list(self._apply(stack, event, now))
            out += shown
            if shown or last is None:
                last = now
        self._keep(stack)
        for label, shown in self.fresh.items():
            self.counts.updateValue((label,), shown)
        self.last.update((last,))
        self._alarm(stack, last)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, stack = expiredTimerInfo.getExpiryTimeInMs() / 1000, self._open()
        out = [self._notice(stack, at)] if stack else []
        reached = timerValues.getCurrentWatermarkInMs() / 1000 if self.by_event_time else timerValues.getCurrentProcessingTimeInMs() / 1000
        while stack and self.by_event_time and at + self.wait <= reached:
            at += self.wait
            out.append(self._notice(stack, at))
        self.last.update((at,))
        if stack:
            self.handle.registerTimer(round(1000 * (max(at, reached if not self.by_event_time else at) + self.wait)))
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def stage_notices(events: DataFrame, wait: float = 10.0, gap: float = 1.0, clock: str = "processing", delay: str = "0 seconds", forget: float = 3600.0) -> DataFrame:
    """(source, at, kind, text) of a stream of EVENTS, to be written in append mode.

    ``clock`` is "processing", where times are those at which events are met, or "event", where they are the events'
    own, notices fall due as the watermark (``delay`` behind the latest event) passes, and the result does not depend on
    how events are dealt to batches that keep their order. Counts and ends of a label that is not open show nothing.
    The session must name RocksDB as its state store (PROVIDER).
    """
    by_event = clock == "event"
    if clock not in ("processing", "event"):
        raise ValueError(f"clock is processing or event, got {clock!r}")
    rows = events.withWatermark("at", delay) if by_event else events
    rows = rows.withColumn("seconds", F.unix_micros("at") / 1e6)
    processor = StageNotices(wait, gap, by_event, forget)
    return rows.groupBy("source").transformWithStateInPandas(processor, outputStructType=SHOWN, outputMode="append", timeMode="EventTime" if by_event else "ProcessingTime")


def replayed(spark: SparkSession, folder: str, to: str, checkpoint: str, **how) -> DataFrame:
    """stage_notices() of the Parquet files of EVENTS in ``folder``, run until all are read, by the events' own clock; the rows are in ``to``."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        out = stage_notices(spark.readStream.schema(EVENTS).parquet(folder), clock="event", **how)
        out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(SHOWN).parquet(to)
