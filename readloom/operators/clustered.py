"""Decode reads where they lie: files hold each cluster as one run of lines, so most clusters need no shuffle at all.

Spark cuts files into blocks.  A cluster that neither begins nor ends its block is whole and is decoded in the task that
reads it.  The first and the last cluster of a block may go on in the next one: their reads, counted, are the only ones
that are shuffled, at most two clusters a block.  Their table is written once, with the names of all other clusters; the
names show whether a cluster comes twice, in one block, in two, or in blocks that aren't neighbours, which is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.columns import canonical
from readloom.operators.decode import DECODED, SPLIT, decode_counted, decode_lists
from readloom.plans.staging import scratch
from readloom.schema import READS, Config

#: Clusters that are decoded together.
TOGETHER = 512
PIECES = "cluster_id string, design_length int, seq string, n long, file string, block long, size long, first boolean, last boolean"


def read_lines(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """``(cluster_id, design_length, seq, file, block, size)`` in the order of the lines; a line of another form is an error."""
    names = READS.fieldNames()
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length")
    head = (F.col("value") == "\t".join(names)) & (F.col("file_block_start") == 0)
    f = F.split("value", "\t", -1)
    at = {name: f[i] for i, name in enumerate(names)}
    size = F.expr("try_cast(split(value, '\t', -1)[6] AS INT)")
    bad = (F.size(f) != len(names)) | (at["cluster_id"] == "") | (at["read_sequence"] == "") | size.isNull()
    fields = F.when(bad, F.raise_error(F.concat(F.lit("not a read: "), "value"))).otherwise(f)
    rows = lines.where(~head).select(fields.alias("f"), "file_path", "file_block_start", "file_block_length")
    design = F.col("f")[6].cast("int") if length is None else F.lit(length)
    return rows.select(F.col("f")[1].alias("cluster_id"), design.alias("design_length"), canonical(F.col("f")[3]).alias("seq"), F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.col("file_block_length").alias("size"))


class _Run:
    """Lines of one cluster within one block."""

    def __init__(self, cluster: str, design: int, place: tuple, first: bool):
        self.cluster, self.design, self.place, self.first, self.last = cluster, design, place, first, False
        self.parts: list[pa.Array] = []

    @property
    def reads(self) -> Counter[str]:
        return Counter(x for part in self.parts for x in part.to_pylist())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """Runs in order, each when it has ended; the same cluster twice in a block is an error."""
    run, seen = None, set()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, file, block = (batch.column(c) for c in ("cluster_id", "file", "block"))
        code = [np.asarray(x.dictionary_encode().indices) for x in (ids, file)] + [block.to_numpy()]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in code], axis=0)
        at = np.flatnonzero(new)
        design, size = batch.column("design_length").to_numpy(), batch.column("size")
        seq = batch.column("seq")
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), batch.num_rows]):
            cluster, place = ids[lo].as_py(), (file[lo].as_py(), block[lo].as_py(), size[lo].as_py())
            if run is None or (run.cluster, run.place) != (cluster, place):
                fresh = run is None or run.place != place
                if run is not None:
                    run.last = fresh
                    yield run
                seen = set() if fresh else seen
                if cluster in seen:
                    raise ValueError(f"cluster {cluster} comes twice in {place[0]}")
                seen.add(cluster)
                run = _Run(cluster, int(design[lo]), place, fresh)
            if (design[lo:hi] != run.design).any():
                raise ValueError(f"cluster {cluster} has several design lengths")
            run.parts.append(seq.slice(lo, hi - lo))
    if run is not None:
        run.last = True
        yield run


def _inside(cfg: Config) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Run] = []
        for r in _runs(batches):
            if not (r.first or r.last):
                held.append(r)
                if len(held) == TOGETHER:
                    yield _decoded(held, cfg)
                    held = []
        if held:
            yield _decoded(held, cfg)

    return run


def _decoded(runs: list[_Run], cfg: Config) -> pa.RecordBatch:
    counted = [r.reads for r in runs]
    return decode_lists([r.cluster for r in runs], [r.design for r in runs], [[x.encode() for x in c] for c in counted], [list(c.values()) for c in counted], cfg)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted reads of clusters at a block's ends, and the names of all others."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        rows.clear()
        return made

    for r in _runs(batches):
        own = [(None, None)] if not (r.first or r.last) else r.reads.items()
        rows += [(r.cluster, r.design, seq, n, *r.place, r.first, r.last) for seq, n in own]
        if len(rows) >= 10_000:
            yield batch()
    if rows:
        yield batch()


def split_clusters(pieces: DataFrame) -> DataFrame:
    """``(cluster_id, why)`` of clusters that aren't one run of lines."""
    each = pieces.groupBy("cluster_id", "file", "block").agg(F.max("size").alias("size"), F.max("first").alias("first"), F.max("last").alias("last"), F.max("design_length").alias("most"), F.min("design_length").alias("least"))
    n = F.col("n")
    by = each.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("file").alias("files"),
        (F.max(F.col("block") + F.col("size")) - F.min("block") - F.sum("size")).alias("gap"),
        F.count_if("first").alias("firsts"),
        F.count_if("last").alias("lasts"),
        F.min_by("first", "block").alias("lowest_first"),
        F.max_by("last", "block").alias("highest_last"),
        (F.max("most") - F.min("least")).alias("lengths"),
    )
    # only the lowest piece may begin, and only the highest one end, within its block
    begins = (F.col("firsts") < n - 1) | ((F.col("firsts") == n - 1) & F.col("lowest_first"))
    ends = (F.col("lasts") < n - 1) | ((F.col("lasts") == n - 1) & F.col("highest_last"))
    why = F.when((n > 1) & ((F.col("files") > 1) | (F.col("gap") != 0) | begins | ends), "not one run of lines").when(F.col("lengths") != 0, "several design lengths")
    return by.select("cluster_id", why.alias("why")).where("why is not null")


def decode_in_place(spark: SparkSession, path: str, cfg: Config = Config(), length: int | None = None, split: int = SPLIT) -> DataFrame:
    """Decode a file or folder of reads, each cluster one run of lines of one file: ``cluster_id, design_length, total_reads, sequence, family, score``."""
    lines = read_lines(spark, path, length)
    held = scratch(spark, "pieces")
    lines.mapInArrow(_pieces, PIECES).write.parquet(held)
    pieces = spark.read.schema(PIECES).parquet(held)
    wrong = split_clusters(pieces).limit(1).collect()
    if wrong:
        raise ValueError(f"cluster {wrong[0]['cluster_id']}: {wrong[0]['why']}")
    open_ = pieces.where("seq is not null").groupBy("cluster_id", "design_length", "seq").agg(F.sum("n").alias("n"))
    return lines.mapInArrow(_inside(cfg), DECODED).unionByName(decode_counted(open_, cfg, split))
