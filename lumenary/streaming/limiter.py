"""A rate limiter whose windows begin at a key's first event after the last one has ended, on a batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "key string, id long, at long, window_start long, allowed boolean"


class _Limiter:
    """Start and count of a key's window, in milliseconds."""

    def __init__(self, most: int, window: int, start: int | None = None, count: int = 0) -> None:
        self.most, self.window, self.start, self.count = most, window, start, count

    def take(self, at: int) -> bool:
        """Whether an event is let through; one at the very end of a window begins the next."""
        if self.start is None or self.start + self.window <= at:
            self.start, self.count = at, 0
        allowed = self.count < self.most
        self.count += allowed
        return allowed


def _keyed(events: DataFrame, key: str, number: str, at: str) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("key"), F.col(number).cast("long").alias("id"), F.unix_millis(F.col(at).cast("timestamp")).alias("at"))


def limited(events: DataFrame, key: str, number: str, at: str, most: int, seconds: int) -> DataFrame:
    """Every event as (key, id, at, window_start, allowed), times in milliseconds since 1970; events go by time, then id.

    After a pause of a window's length the next event begins a window, whatever came before. So a key's
    events fall into stretches without such a pause that do not depend on one another and go to
    different tasks. A task reads its stretches as a stream and keeps two numbers.
    """
    window = seconds * 1000
    order = Window.partitionBy("key").orderBy("at", "id")
    pause = F.coalesce(F.col("at") - F.lag("at").over(order) >= window, F.lit(True))
    stretches = _keyed(events, key, number, at).withColumn("stretch", F.sum(pause.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limiter = None, None
        for batch in batches:
            starts, allowed = [], []
            for k, s, t in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "at")), strict=True):
                if (k, s) != now:
                    now, limiter = (k, s), _Limiter(most, window)
                allowed.append(limiter.take(t))
                starts.append(limiter.start)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("at"), pa.array(starts, pa.int64()), pa.array(allowed, pa.bool_())], names=["key", "id", "at", "window_start", "allowed"])

    return stretches.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "id").select("key", "stretch", "id", "at").mapInArrow(run, _OUT)


class _LimitedStream(StatefulProcessor):
    def __init__(self, most: int, window: int) -> None:
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, count long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        limiter = _Limiter(self.most, self.window, *(self.state.get() if self.state.exists() else ()))
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            allowed = limiter.take(r["at"])
            yield Row(key=key[0], id=r["id"], at=r["at"], window_start=limiter.start, allowed=allowed)
        self.state.update((limiter.start, limiter.count))

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, number: str, at: str, most: int, seconds: int) -> DataFrame:
    """limited() as events arrive: a batch's events go by time and the window that the last batch left goes on. The session needs streaks.STATE_STORE."""
    return _keyed(events, key, number, at).groupBy("key").transformWithState(_LimitedStream(most, seconds * 1000), _OUT, "append", "None")


def window_counts(events: DataFrame) -> DataFrame:
    """Of limited(): events of each key, those let through, and windows."""
    allowed: Column = F.count_if("allowed")
    return events.groupBy("key").agg(F.count("*").alias("n_events"), allowed.alias("n_allowed"), F.count_distinct("window_start").alias("n_windows"))
