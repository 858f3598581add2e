"""Limits for each client in event time: events wait until the watermark has passed them, and are judged in order.

An event that comes late, but within the delay that the watermark allows, is judged where it belongs: what its client
did later waits in state until then. So the result is that of a replay in order of time, however the events were divided
into micro-batches. Events behind the watermark are dropped by Spark, as in any aggregation by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .notes import LIMIT, SECONDS

OUT = "client string, ts timestamp, allowed boolean"


class InOrder(StatefulProcessor):
    """State of a client: how many events wait at each time, with a timer for each, and the times that still count."""

    def __init__(self, most: int, span_ms: int):
        self.most, self.span_ms = most, span_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "n long")
        self.let = handle.getValueState("let", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for x in rows:
            for at, n in x["ts"].value_counts().items():
                ms = int(at.value) // 1_000_000
                if self.waiting.containsKey((ms,)):
                    n += self.waiting.getValue((ms,))[0]
                else:
                    self.handle.registerTimer(ms)
                self.waiting.updateValue((ms,), (int(n),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        # whichever timer comes first judges all events up to its own time
        due = sorted(at for (at,) in self.waiting.keys() if at <= until)  # noqa: SIM118
        times = list(self.let.get()[0]) if self.let.exists() else []
        told = []
        for at in due:
            for _ in range(self.waiting.getValue((at,))[0]):
                times = [t for t in times if t > at - self.span_ms]
                told.append((at, len(times) < self.most))
                times += [at] * told[-1][1]
            self.waiting.removeKey((at,))
        if due:
            self.let.update((times,))
        if told:
            at, allowed = zip(*told, strict=True)
            yield pd.DataFrame({"client": key[0], "ts": pd.to_datetime(list(at), unit="ms"), "allowed": list(allowed)})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, most: int = LIMIT, seconds: int = SECONDS, late: str = "5 minutes") -> DataFrame:
    """client, ts (milliseconds), allowed of a stream of events (client, ts), once the watermark has passed them.

    The session must keep its state in RocksDB (see streaming.stories.STORE).
    """
    timed = events.select("client", "ts").withWatermark("ts", late)
    return timed.groupBy("client").transformWithStateInPandas(
        InOrder(most, seconds * 1000), outputStructType=OUT, outputMode="append", timeMode="eventtime"
    )
