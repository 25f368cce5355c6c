"""A stored ledger: counters of clusters on disk, to which batches of reads are added and from which clusters are decoded.

Counters add up, so a batch appends its own counts and nothing stored is rewritten.  Rows lie by batch, then by a hash of the
cluster: writing a batch again replaces it (a failed batch can simply be repeated), and decoding some clusters reads only
the parts they lie in.  A store belongs to one context size, which its folder names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.decode import DECODING, decode_ledger
from readloom.operators.evidence import counters, multiplicity, tasks
from readloom.schema import Config

PARTS = 64
STORED = "cluster_id string, design_length int, kind int, code long, seq string, support long, batch long, part int"


def part_of(cluster: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(cluster), F.lit(parts)).cast("int")


def _folder(path: str, k: int) -> str:
    return f"{path.rstrip('/')}/counters_k{k}"


def append(reads: DataFrame, path: str, batch: int, cfg: Config = Config(), parts: int = PARTS) -> None:
    """Count ``reads(cluster_id, design_length, read_sequence)`` and store the counts as ``batch``, in place of what that batch had."""
    named = multiplicity(reads).withColumn("cluster_id", F.struct("cluster_id", "design_length"))
    rows = counters(named, cfg.k, DECODING, reads=True, many=tasks(reads))
    rows = rows.select("cluster_id.cluster_id", "cluster_id.design_length", "kind", "code", "seq", "support").withColumns({"batch": F.lit(batch).cast("long"), "part": part_of("cluster_id", parts)})
    # a part's rows in one file, or in several of a file's size where a cluster is hot
    rows.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(_folder(path, cfg.k))


def stored(spark: SparkSession, path: str, cfg: Config = Config(), upto: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """Counters as they were stored, a row a batch; only batches up to ``upto`` and the folders of ``parts`` are read."""
    rows = spark.read.schema(STORED).parquet(_folder(path, cfg.k))
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    return rows if parts is None else rows.where(F.col("part").isin(parts))


def summed(rows: DataFrame) -> DataFrame:
    """The batches' counters added up.  Clusters have one design length, the largest one stored."""
    return rows.groupBy("cluster_id", "kind", "code", "seq").agg(F.max("design_length").alias("design_length"), F.sum("support").alias("support"))


def decode_stored(spark: SparkSession, path: str, clusters: DataFrame | None = None, cfg: Config = Config(), upto: int | None = None, parts: int = PARTS) -> DataFrame:
    """Decode the clusters of ``clusters(cluster_id)``, or all, from their stored counters."""
    if clusters is None:
        return decode_ledger(summed(stored(spark, path, cfg, upto)), cfg)
    touched = [r[0] for r in clusters.select(part_of("cluster_id", parts).alias("part")).distinct().collect()]  # at most ``parts`` numbers
    rows = stored(spark, path, cfg, upto, touched).join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return decode_ledger(summed(rows), cfg)
