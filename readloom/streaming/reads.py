"""Reads as a stream: native running counters, and clusters that are decoded once when their last read has come."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readloom.functions.columns import canonical
from readloom.operators.decode import decode_lists
from readloom.schema import Config


def stream_multiplicity(reads: DataFrame) -> DataFrame:
    """Running counts of equal reads, in update or complete mode: state is one counter for each different read."""
    return reads.select("cluster_id", canonical("read_sequence").alias("seq")).groupBy("cluster_id", "seq").agg(F.count(F.lit(1)).alias("n"))


#: A cluster that is sent out, with its different reads and their counts.
WHOLE = "cluster_id string, design_length int, total_reads long, seqs array<string>, counts array<long>, complete boolean"
CLOSED = "cluster_id string, total_reads long, sequence string, family int, complete boolean"
#: Different reads of clusters that are decoded together, unless one has more.
TOGETHER = 20_000


def decode_whole(clusters: DataFrame, cfg: Config) -> DataFrame:
    """``WHOLE`` -> ``CLOSED``: behind the state, which knows one cluster at a time, those of a batch are decoded together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reads = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("seqs")).to_numpy(zero_copy_only=False))])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(reads, reads[lo] + TOGETHER, side="right")) - 1)
                yield one(batch.slice(lo, hi - lo))
                lo = hi

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, design, _, seqs, counts, _ = (c.to_pylist() for c in batch.columns)
        found = decode_lists(ids, design, [[s.encode() for s in x] for x in seqs], counts, cfg)
        names = [c.split()[0] for c in CLOSED.split(", ")]
        return pa.RecordBatch.from_arrays([(found if c in ("sequence", "family") else batch).column(c) for c in names], names=names)

    return clusters.mapInArrow(run, CLOSED)


def stream_decode(reads: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``reads(cluster_id, design_length, total_reads, read_sequence)``: one row when a cluster has all its reads.

    State is the different reads of open clusters with their counts; it goes when a cluster closes.  Reads behind the last
    one are ignored, as a closed cluster's state keeps only that it is closed.
    """

    def close(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, counts, done = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], False)
        held = Counter(dict(zip(seqs, counts)))
        length = total = 0
        for chunk in chunks:
            length, total = int(chunk["design_length"].iat[0]), int(chunk["total_reads"].iat[0])
            held.update(chunk["seq"].tolist())
        if not done and sum(held.values()) >= total:
            state.update(([], [], True))
            yield pd.DataFrame({"cluster_id": [key[0]], "design_length": [length], "total_reads": [total], "seqs": [list(held)], "counts": [list(held.values())], "complete": [True]})
        elif not done:
            state.update((list(held), list(held.values()), False))

    rows = reads.select("cluster_id", "design_length", "total_reads", canonical("read_sequence").alias("seq"))
    whole = rows.groupBy("cluster_id").applyInPandasWithState(close, WHOLE, "seqs array<string>, counts array<long>, done boolean", "append", GroupStateTimeout.NoTimeout)
    return decode_whole(whole, cfg).drop("complete")
