"""Failures in a row of each key of a stream, whatever the order in which rows arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What transformWithState keeps its state in.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Output of streaks().
COLUMNS = "key string, streak long, longest long"


def _fold(rows: list[tuple[datetime, int, bool]], streak: int, longest: int) -> tuple[int, int]:
    for _, _, failed in sorted(rows):
        streak = streak + 1 if failed else 0
        longest = max(longest, streak)
    return streak, longest


class Streaks(StatefulProcessor):
    """Two numbers a key for what the watermark has passed, and the rows that it has not passed yet.

    No row can come in before the watermark, so what lies before it is folded into the numbers, in
    order of event time; a timer does so for keys that get no more rows. Rows that wait are kept by
    time and id, so one that arrives again changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "streak long, longest long")
        self.waiting = handle.getMapState("waiting", "at timestamp, id long", "failed boolean")

    def _settle(self, watermark: int) -> tuple[int, int]:
        """Fold what the watermark has passed; then what all rows so far make."""
        streak, longest = self.folded.get() if self.folded.exists() else (0, 0)
        rows = [(key[0], key[1], value[0]) for key, value in self.waiting.iterator()] if self.waiting.exists() else []
        passed = [r for r in rows if r[0].timestamp() * 1000 < watermark]
        if passed:
            streak, longest = _fold(passed, streak, longest)
            self.folded.update((streak, longest))
            for at, number, _ in passed:
                self.waiting.removeKey((at, number))
        return _fold([r for r in rows if r not in passed], streak, longest)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last = None
        for r in rows:
            self.waiting.updateValue((r["at"], r["id"]), (r["failed"],))
            last = r["at"] if last is None else max(last, r["at"])
        streak, longest = self._settle(timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(int(last.timestamp() * 1000) + 1)
        yield Row(key=key[0], streak=streak, longest=longest)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self._settle(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def streaks(rows: DataFrame, late: str) -> DataFrame:
    """(key, streak, longest) of each key with new rows, after each batch, in update mode.

    ``rows`` has key (string), id (long), at (timestamp) and failed (boolean), in any order; rows up
    to ``late`` behind the newest count where they belong, later ones are dropped, as everywhere behind a watermark. The
    session needs STATE_STORE.
    """
    watched = rows.select("key", "id", "at", "failed").withWatermark("at", late)
    return watched.groupBy("key").transformWithState(Streaks(), COLUMNS, "update", "EventTime")
