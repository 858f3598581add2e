"""Clustering as a stream: items join stories as they arrive, and the groups of a pool are kept as state.

The state of a pool is what the batch fold holds in memory: for each term the groups that use it with their sums, for
each group its squared length, title terms and names. A micro-batch reads the terms of its own items and the groups that
share one with them, and writes what it changed; so its work grows with what arrives and not with the pool. Items of a
pool must arrive in their order; then any division into micro-batches gives the groups of the batch fold. A pool ends
some time after its last item, once the watermark has passed, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.clusters import Groups

OUT = "pool string, ord long, cluster_id int"
#: The state store that keeps maps; a session that runs the stream must name it in spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Kept(dict):
    """A mapping over a map of the state: keys are read when they are first asked for, and written by `save`."""

    def __init__(self, state, load, none=None):
        super().__init__()
        self.state, self.load, self.none = state, load, none

    def __missing__(self, key):
        value = self.load(self.state.getValue((key,))) if self.state.containsKey((key,)) else self.none()
        self[key] = value
        return value

    def save(self, row) -> None:
        for key, value in self.items():
            self.state.updateValue((key,), row(value))


class LeaderClusters(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.terms = handle.getMapState("terms", "term string", "groups array<int>, sums array<double>")
        self.groups = handle.getMapState("groups", "id int", "square double, titles array<string>, names array<string>")
        self.count = handle.getValueState("count", "n int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values("ord")  # of one pool in one micro-batch
        n, until = self.count.get() if self.count.exists() else (0, 0)
        groups = Groups()
        groups.count = n
        groups.sums = _Kept(self.terms, lambda r: dict(zip(r[0], r[1], strict=True)), dict)
        found = _Kept(self.groups, lambda r: {"square": r[0], "titles": set(r[1]), "names": set(r[2])}, dict)
        groups.squares, groups.titles, groups.named = (_Part(found, part) for part in ("square", "titles", "names"))
        of = [groups.join(*x) for x in zip(arrived.terms, arrived.weights, arrived.title_terms, arrived.names, strict=True)]
        groups.sums.save(lambda v: (list(v), list(v.values())))
        found.save(lambda g: (g["square"], sorted(g["titles"]), sorted(g["names"])))
        last = int(arrived["ts"].max().value) // 1_000_000 + self.keep_ms
        if last > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(last)
        self.count.update((groups.count, max(last, until)))
        yield pd.DataFrame({"pool": key[0], "ord": arrived["ord"], "cluster_id": of})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.terms, self.groups, self.count):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Part:
    """One of the properties of the groups, as a mapping by group."""

    def __init__(self, found: _Kept, part: str):
        self.found, self.part = found, part

    def __getitem__(self, g: int):
        return self.found[g][self.part]

    def __setitem__(self, g: int, value) -> None:
        self.found[g][self.part] = value


def clustered(vectors: DataFrame, keep_hours: int = 48, late: str = "1 hour") -> DataFrame:
    """pool, ord, cluster_id of a stream of vectors (see operators.clusters.vectors, and ts); append mode.

    The idf of the weights is that of whoever made the vectors: of a batch of the pool, or of an earlier edition.
    """
    timed = vectors.select("pool", "ord", "terms", "weights", "title_terms", "names", "ts").withWatermark("ts", late)
    return timed.groupBy("pool").transformWithStateInPandas(
        LeaderClusters(keep_hours * 3_600_000), outputStructType=OUT, outputMode="append", timeMode="eventtime"
    )
