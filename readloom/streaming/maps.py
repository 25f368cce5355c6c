"""Clusters as keyed state in maps: a batch writes the counts of its own reads, not the cluster's whole list again.

A cluster's reads are a map from a read to its count, beside one small value.  When the last read has come the cluster is
sent out and its map dropped, and the clusters that a task sends out are decoded together; a timer sends out what there is of clusters whose last read doesn't come.  A closed
cluster keeps that it is closed, so later reads are ignored.  The state store has to be one with column families; see
``state_store``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from readloom.functions.columns import canonical
from readloom.schema import Config
from readloom.streaming.reads import CLOSED, WHOLE, decode_whole  # noqa: F401 - CLOSED is what comes out

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that maps and timers need, while a stream starts; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Clusters(StatefulProcessor):
    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getMapState("reads", "seq string", "n long")
        self.about = handle.getValueState("about", "seen long, design int, wanted long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: Counter[str] = Counter()
        design = wanted = 0
        for chunk in rows:
            design, wanted = int(chunk["design_length"].iat[0]), int(chunk["total_reads"].iat[0])
            fresh.update(chunk["seq"].tolist())
        before = self.about.get()
        seen, _, _, closed = before or (0, 0, 0, False)
        if closed or not fresh:
            return
        first, seen = seen == 0, seen + sum(fresh.values())
        if seen >= wanted:  # what closes a cluster is not written first
            yield self.close_cluster(key[0], seen, design, wanted, Counter() if first else self.held(), fresh, True)
            return
        for s, n in fresh.items():
            own = None if first else self.reads.getValue((s,))
            self.reads.updateValue((s,), (n + own[0] if own else n,))
        self.about.update((seen, design, wanted, False))
        if first and self.patience is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        about = self.about.get()
        if about and not about[3]:
            yield self.close_cluster(key[0], *about[:3], self.held(), Counter(), False)

    def held(self) -> Counter[str]:
        return Counter({k[0]: v[0] for k, v in self.reads.iterator()})

    def close_cluster(self, name: str, seen: int, design: int, wanted: int, held: Counter[str], fresh: Counter[str], complete: bool) -> pd.DataFrame:
        if held:
            self.reads.clear()
        held.update(fresh)
        self.about.update((seen, design, wanted, True))
        return pd.DataFrame({"cluster_id": [name], "design_length": [design], "total_reads": [seen], "seqs": [list(held)], "counts": [list(held.values())], "complete": [complete]})

    def close(self) -> None:
        pass


def stream_clusters(reads: DataFrame, cfg: Config = Config(), patience_ms: int | None = None) -> DataFrame:
    """``reads(cluster_id, design_length, total_reads, read_sequence)``: one row a cluster, when it has all its reads, or ``patience_ms`` after its first one.

    With ``patience_ms`` Spark asks for batches as long as the stream runs, so ``availableNow`` wouldn't end: use a trigger by time.
    """
    rows = reads.select("cluster_id", "design_length", "total_reads", canonical("read_sequence").alias("seq"))
    whole = rows.groupBy("cluster_id").transformWithStateInPandas(Clusters(patience_ms), WHOLE, "Append", "None" if patience_ms is None else "ProcessingTime")
    return decode_whole(whole, cfg)
