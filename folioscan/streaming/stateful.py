"""Operators that keep state of their own per key: newest results, pending keystrokes, main answers of a page.

Keystrokes wait in session windows. Each of the others is a processor for ``transformWithState``; the state store has to be one that supports it (``runner.with_state``).
Spark deals out the keys, keeps the state and fires the timers; the processors see one key at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _micros(ts) -> int:
    """Microseconds of an event time."""
    return round(ts.timestamp() * 1_000_000)


class Newest(StatefulProcessor):
    """Hands on a row only if its sequence is above all that its key has seen; what it remembers lives for a time."""

    def __init__(self, seq: str, kind: T.DataType, names: list[str], ttl_ms: int):
        self.seq, self.schema, self.names, self.ttl_ms = seq, T.StructType([T.StructField("seq", kind)]), names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max((r for r in rows if r[self.seq] is not None), key=lambda r: r[self.seq], default=None)
        if best is None:
            return
        before = self.newest.get() if self.newest.exists() else None
        if before is None or best[self.seq] > before[0]:
            self.newest.update((best[self.seq],))
            yield Row(**{n: best[n] for n in self.names})

    def close(self) -> None:
        pass


def newest_results(df: DataFrame, key: str, seq: str, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Rows of a stream that are newer than all before them, in update mode: at most one per key and batch.

    A row with a lower sequence than the newest of its key is dropped, also if it comes batches later, until the key has been quiet for ``ttl_ms`` of
    processing time; then its state is gone, so the state holds the keys of that time and not all there ever were. Rows without a sequence are dropped,
    a null key is a key, equal sequences do not replace each other.
    """
    return df.groupBy(key).transformWithState(Newest(seq, df.schema[seq].dataType, df.columns, ttl_ms), df.schema, "Update", "processingTime")


def debounce_events(df: DataFrame, key: str, order: str, gap_us: int, immediate: Column, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """The stream form of ``debounce_batch``: events with no other event of their key within the gap behind them, and immediate ones.

    An immediate event is handed on as it comes. Any other waits: events of a key without a gap between them are one session window, and its last event
    is handed on once the watermark has passed it by the gap; an event that comes in between, also one that comes late or is immediate, takes its effect
    away. The state holds one row per open session, its last event, not the events. Windows that touch are merged, so theirs are one microsecond shorter than the
    gap; by that much an event may be handed on early.
    """
    names = df.columns
    marked = df.withColumn("__now", F.coalesce(immediate, F.lit(False))).withWatermark(ts, delay)
    last = F.max_by(F.struct(*names, "__now"), F.struct(ts, order)).alias("last")
    quiet = marked.groupBy(key, F.session_window(ts, f"{gap_us - 1} microseconds")).agg(last).select("last.*")
    return marked.filter("__now").unionByName(quiet.filter("NOT __now")).drop("__now")


class MainAnswer(StatefulProcessor):
    """Latest status and first error of a page's main document; forgotten one gap after the last answer."""

    STATE = "last_at long, status long, status_at long, error string, error_at long"

    def __init__(self, key: str, ts: str, gap_us: int):
        self.key, self.ts, self.gap_us = key, ts, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", self.STATE)

    def expiry(self, at: int) -> int:
        return -(-(at + self.gap_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = tuple(self.page.get()) if self.page.exists() else None
        last, status, status_at, error, error_at = was or (None,) * 5
        for r in rows:
            at = _micros(r[self.ts])
            last = at if last is None else max(last, at)
            if r["status"] is not None and (status_at is None or (at, r["status"]) > (status_at, status)):
                status, status_at = r["status"], at
            if r["error"] is not None and (error_at is None or (at, r["error"]) < (error_at, error)):
                error, error_at = r["error"], at
        if was is not None and was[0] != last:
            self.handle.deleteTimer(self.expiry(was[0]))
        if was is None or was[0] != last:
            self.handle.registerTimer(self.expiry(last))
        self.page.update((last, status, status_at, error, error_at))
        if was is None or (was[1], was[3]) != (status, error):
            yield Row(**{self.key: key[0], "main_status": status, "main_error": error})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.page.clear()
        return iter(())

    def close(self) -> None:
        pass


def main_answers(df: DataFrame, key: str, gap_us: int, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The stream form of ``main_responses``: ``key, main_status, main_error`` of a page, in update mode whenever they change.

    A page is forgotten when the watermark has passed its last answer by the gap; an answer after that begins anew.
    """
    main = df.filter(F.col("type") == "Document").select(key, ts, F.col("status").cast("long").alias("status"), "error").withWatermark(ts, delay)
    out = T.StructType([main.schema[key], T.StructField("main_status", T.LongType()), T.StructField("main_error", T.StringType())])
    return main.groupBy(key).transformWithState(MainAnswer(key, ts, gap_us), out, "Update", "eventTime")
