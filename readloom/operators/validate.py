"""Constraint checks as one frame of violations; ``require`` raises on the first of them.

A check is an aggregation or a filter of the reads; duplicates and changes within clusters are found by the same grouping.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.schema import LEAST_K, MOST_LENGTH


def _rows(df: DataFrame, rule: str, bad: Column, detail: Column) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), F.col("cluster_id").cast("string").alias("cluster_id"), detail.cast("string").alias("detail"))


def _broken(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """All rules of one scan: a row for each that is broken."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in rules]))
    return df.select(F.col("cluster_id").cast("string").alias("cluster_id"), F.inline(found)).select("rule", "cluster_id", "detail")


def violations(reads: DataFrame, k: int = LEAST_K) -> DataFrame:
    """``(rule, cluster_id, detail)``.  With a ``row_no`` column the contiguity of clusters is checked too."""
    length = F.expr("try_cast(design_length AS INT)")
    rules = [("empty_" + c, F.coalesce(F.col(c), F.lit("")) == "", F.col("read_id")) for c in ("dataset_id", "cluster_id", "read_id", "read_sequence")]
    rules += [("length_not_integer", length.isNull(), F.col("design_length")), ("length_out_of_range", ~length.between(k, MOST_LENGTH), length)]
    if "_corrupt" in reads.columns:
        rules.append(("malformed_row", F.col("_corrupt").isNotNull(), F.col("_corrupt")))
    out = [_broken(reads, rules)]
    place = "row_no" if "row_no" in reads.columns else None
    more = [F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")] if place else []
    by = reads.groupBy("cluster_id").agg(F.min(length).alias("lo"), F.max(length).alias("hi"), *more)
    rules = [("length_varies", F.col("lo") != F.col("hi"), F.concat_ws("-", "lo", "hi"))]
    if place:  # first and last row of a cluster are as far apart as it has rows, if nothing stands between
        rules.append(("cluster_not_contiguous", F.col("b") - F.col("a") + 1 != F.col("n"), F.col("a")))
    out.append(_broken(by, rules))
    dup = reads.groupBy("cluster_id", "read_id").agg(F.count(F.lit(1)).alias("n"))
    out.append(_rows(dup, "duplicate_read_id", F.col("n") > 1, F.col("read_id")))
    sets = reads.agg(F.count_distinct("dataset_id").alias("n")).select(F.lit(None).cast("string").alias("cluster_id"), "n")
    out.append(_rows(sets, "not_one_dataset", F.col("n") != 1, F.col("n")))
    return reduce(DataFrame.unionByName, out)


def truth_violations(truth: DataFrame) -> DataFrame:
    """``truth(cluster_id, sequence, ...)``; lines of another form, where the reader tells them, are violations too."""
    return _keyed(truth, "empty_truth")


def prediction_violations(pred: DataFrame) -> DataFrame:
    """No prediction at all, clusters twice or without a name, lines of another form."""
    return _keyed(pred, "empty_predictions")


def _keyed(df: DataFrame, none: str) -> DataFrame:
    rules = [("empty_cluster_id", F.coalesce("cluster_id", F.lit("")) == "", F.lit(None))]
    if "_corrupt" in df.columns:
        rules.append(("malformed_row", F.col("_corrupt").isNotNull(), F.col("_corrupt")))
    dup = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    count = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("cluster_id"), "n")
    return reduce(DataFrame.unionByName, [_broken(df, rules), _rows(dup, "duplicate_cluster_id", F.col("n") > 1, F.col("n")), _rows(count, none, F.col("n") == 0, F.col("n"))])


def evaluation_violations(rows: DataFrame) -> DataFrame:
    """Distances outside 0 to the longer length, and lengths below 0."""
    ed, most = F.col("edit_distance"), F.greatest("pred_length", "truth_length")
    return _broken(rows, [("distance_out_of_range", ~F.coalesce(ed.between(0, most), F.lit(False)), ed), ("negative_length", F.least("pred_length", "truth_length") < 0, F.lit(None))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, run, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        column = batch.column("cluster_id")
        new = np.ones(len(column), bool)
        if len(column):
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] = code[1:] != code[:-1]
            new[0] = last is None or column[0].as_py() != last[0]
            last = (column[-1].as_py(),)
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int64)), pa.array(np.arange(run, run + len(at))), column.take(pa.array(at))], names=["part", "run", "cluster_id"])
        run += len(at)


def blocks(reads: DataFrame, order: str | None = None) -> DataFrame:
    """Runs of equal cluster_id in the order of rows, or of a column: ``(cluster_id, n_blocks)``.

    Each partition counts its own runs.  A run that goes on in the next partition counts once: only the first and the last
    run of each partition are compared across partitions.
    """
    rows = reads.select("cluster_id") if order is None else reads.select("cluster_id", order).repartitionByRange(order).sortWithinPartitions(order)
    runs = rows.select("cluster_id").mapInArrow(_runs, "part long, run long, cluster_id string")
    by_part = runs.groupBy("part").agg(F.min_by("cluster_id", "run").alias("head"), F.max_by("cluster_id", "run").alias("tail"))
    goes_on = by_part.withColumn("before", F.lag("tail").over(Window.orderBy("part"))).where(F.col("before") == F.col("head"))  # a row a partition
    less = goes_on.groupBy(F.col("head").alias("cluster_id")).agg(F.count(F.lit(1)).alias("less"))
    n = runs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(less, "cluster_id", "left").select("cluster_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n_blocks"))


def id_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """``(cluster_id, side)``: ids missing from ``observed``, and extra ones."""
    a, b = expected.select("cluster_id").distinct(), observed.select("cluster_id").distinct()
    return a.join(b, "cluster_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "cluster_id", "left_anti").withColumn("side", F.lit("extra")))


#: Fixed value: why a reference has no part in an evaluation.
NO_READS = "TRUTH_ONLY_NO_READS"


def without_reads(truth: DataFrame, reads: DataFrame) -> DataFrame:
    """``(cluster_id, reason)``: references whose cluster has no read."""
    return truth.select("cluster_id").distinct().join(reads.select("cluster_id"), "cluster_id", "left_anti").withColumn("reason", F.lit(NO_READS))


def require(found: DataFrame, what: str) -> None:
    """Raises with the first ten rows in order, and how many there are."""
    first = found.orderBy(*found.columns).limit(10).collect()
    if first:
        raise ValueError(f"{what} ({found.count()}): " + "; ".join(str(tuple(r)) for r in first))
