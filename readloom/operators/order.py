"""Replay orders: a seeded permutation of each cluster's reads, and reads in that order."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Begins the text that is hashed to a cluster's seed.  Another tool's orders come out with that tool's prefix.
PREFIX = "readloom|minimal"


def entropy(seed: str, dataset: str, prefix: str = PREFIX) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), F.lit(seed), F.lit(dataset), "cluster_id"), 256), 1, 32)


def _shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bits, n in zip(batch.column("entropy_bits").to_pylist(), batch.column("n").to_pylist()):
            order = list(range(n))
            random.Random(int(bits, 16)).shuffle(order)
            out.append(order)
        yield pa.RecordBatch.from_arrays([batch.column("cluster_id"), batch.column("entropy_bits"), pa.array(out, pa.list_(pa.int32()))], names=["cluster_id", "entropy_bits", "permutation"])


def orders(reads: DataFrame, seed: str, dataset: str, prefix: str = PREFIX) -> DataFrame:
    """``(cluster_id, entropy_bits, permutation)``.  The permutation is Python's Mersenne Twister's: exact, so in Python."""
    sizes = reads.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return sizes.select("cluster_id", entropy(seed, dataset, prefix).alias("entropy_bits"), "n").mapInArrow(_shuffle, "cluster_id string, entropy_bits string, permutation array<int>")


def broken(order: DataFrame, reads: DataFrame) -> DataFrame:
    """Clusters whose permutation isn't one of all their reads, or that only one side has."""
    sizes = reads.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    right = F.array_sort("permutation") == F.sequence(F.lit(0), F.col("n") - 1)
    return order.join(sizes, "cluster_id", "full_outer").where(~F.coalesce(right, F.lit(False))).select("cluster_id")


def numbered(rows: DataFrame, by: str, folder: str) -> DataFrame:
    """Rows with their ``ordinal`` (from 0, gapless) in the order of ``by``, whose values are distinct.

    Rows are dealt to ranges of ``by`` and written to ``folder`` with their range, so that counting ranges and placing rows
    see the same ones.  A row's ordinal is what all earlier ranges count, and its place in its own: no task sees more
    than one range, but for the sums over one row a range.
    """
    rows.repartitionByRange(by).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    ranged = rows.sparkSession.read.parquet(folder)
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn("ordinal", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def misplaced(order: DataFrame, reads: DataFrame, at: str, folder: str) -> DataFrame:
    """``(cluster_id, read_ordinal, order_ordinal, state)`` where a pack's clusters aren't those of the reads in their order.

    Both sides have a column ``at``; a cluster of the reads stands where its first read does.  States: ``moved``,
    ``missing`` from the pack, ``extra`` in it, and ``repeated`` for a cluster that the pack has again, at its later places.
    """
    first = reads.groupBy("cluster_id").agg(F.min(at).alias("_at"))
    a = numbered(first, "_at", f"{folder}/reads").select("cluster_id", F.col("ordinal").alias("read_ordinal"))
    b = numbered(order.select("cluster_id", F.col(at).alias("_at")), "_at", f"{folder}/order").select("cluster_id", F.col("ordinal").alias("order_ordinal"))
    again = F.row_number().over(Window.partitionBy("cluster_id").orderBy("order_ordinal")) > 1
    state = F.when(F.col("again"), "repeated").when(F.col("order_ordinal").isNull(), "missing").when(F.col("read_ordinal").isNull(), "extra").otherwise("moved")
    both = a.join(b.withColumn("again", again), "cluster_id", "full_outer").where("again OR NOT read_ordinal <=> order_ordinal")
    return both.select("cluster_id", "read_ordinal", "order_ordinal", state.alias("state"))


def replay(reads: DataFrame, order: DataFrame, at: str) -> DataFrame:
    """Reads with their ``arrival`` (from 1): positions in the order of ``at`` meet the permutation by an equi-join."""
    placed = reads.withColumn("_i", F.row_number().over(Window.partitionBy("cluster_id").orderBy(at)) - 1)
    turns = order.select("cluster_id", F.posexplode("permutation").alias("arrival", "_i")).withColumn("arrival", F.col("arrival") + 1)
    return placed.join(turns, ["cluster_id", "_i"]).drop("_i")
