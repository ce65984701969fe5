"""Overdue rotations and backups as a stream: a timer per lineage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Overdue(StatefulProcessor):
    """Each arrival moves the lineage's deadline; a deadline that passes is reported once."""

    def __init__(self, interval_s: int):
        self.interval_ms = interval_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = max(int(row.ts.timestamp() * 1000) for row in rows)
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.interval_ms)
            self.handle.registerTimer(newest + self.interval_ms)
            self.newest.update((newest,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(lineage=key[0], newest_ms=self.newest.get()[0])

    def close(self) -> None:
        pass


def cadence_overdue(arrivals: DataFrame, interval_s: int, declared: DataFrame | None = None, delay: str | None = None) -> DataFrame:
    """arrivals(lineage, ts) to (lineage, newest_ms) each time a lineage falls silent for ``interval_s``.

    Deadlines run on the machines' clock, so that lineages are reported also when all of them fall silent at once. A stream
    ``declared``, of the same columns, starts the deadlines of lineages that may never send anything. With ``delay`` the clock is
    the stream's watermark on ``ts`` instead, that far behind the newest arrival of any lineage: for replays of the past.
    """
    stream = arrivals.select("lineage", "ts")
    if declared is not None:
        stream = stream.unionByName(declared.select("lineage", "ts"))
    if delay is not None:
        stream = stream.withWatermark("ts", delay)
    return stream.groupBy("lineage").transformWithState(
        statefulProcessor=_Overdue(interval_s),
        outputStructType="lineage STRING, newest_ms BIGINT",
        outputMode="Append",
        timeMode="ProcessingTime" if delay is None else "EventTime",
    )
