"""Scores of predictions against references, fingerprints, comparisons, and means over rounds."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from readloom.functions.distance import edit_distance


def evaluate(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``pred(cluster_id, reconstructed_sequence)`` and ``truth(cluster_id, sequence)`` -> a row for each cluster of both."""
    ed = edit_distance("reconstructed_sequence", "sequence")
    both = pred.select("cluster_id", "reconstructed_sequence").join(truth.select("cluster_id", "sequence"), "cluster_id")
    rows = both.select("cluster_id", F.octet_length("reconstructed_sequence").alias("pred_length"), F.octet_length("sequence").alias("truth_length"), ed.alias("edit_distance"))
    return rows.withColumn("exact", (F.col("edit_distance") == 0).cast("int")).withColumn("normalized_accuracy", 1.0 - F.col("edit_distance") / F.greatest(F.lit(1), "truth_length"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rate of exact results, accuracy, distances: one row, or one for each value of ``by``."""
    return rows.groupBy(*by).agg(
        F.avg(F.col("exact").cast("double")).alias("exact"),
        F.avg("normalized_accuracy").alias("accuracy"),
        F.avg(F.col("edit_distance").cast("double")).alias("mean_ed"),
        F.count(F.lit(1)).alias("evaluated_clusters"),
        F.sum("exact").cast("long").alias("exact_count"),
        F.sum("edit_distance").cast("long").alias("total_ed"),
        F.sum("truth_length").cast("long").alias("total_truth_bases"),
    )


def edit_distances(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """``(key, a, b)`` -> lengths and distance in bytes, -1 beyond ``most``; an empty or null key, or a null side, is an error."""
    bad = (F.coalesce("key", F.lit("")) == "") | F.col("a").isNull() | F.col("b").isNull()
    key = F.when(bad, F.raise_error(F.lit("expected a key and two sequences"))).otherwise(F.col("key"))
    return pairs.select(key.alias("key"), F.octet_length("a").alias("a_length"), F.octet_length("b").alias("b_length"), edit_distance("a", "b", most).alias("edit_distance"))


def fingerprint(pred: DataFrame) -> DataFrame:
    """A digest of all ``id TAB sequence`` lines that no order of rows changes.

    Lines are digested by slices of their hash, and slices' digests in order, so no task holds all lines.
    """
    line = F.concat_ws("\t", "cluster_id", "reconstructed_sequence")
    parts = pred.select(F.substring(F.sha2(line, 256), 1, 3).alias("slice"), line.alias("line")).groupBy("slice").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat("slice", "digest")))), 256).alias("sha256"), F.sum("n").alias("lines"))


def canonical_digest(pred: DataFrame) -> str:
    """SHA-256 of all ``id TAB sequence NEWLINE`` lines in order of id.  Lines pass the driver a partition at a time."""
    digest = hashlib.sha256()
    for r in pred.select("cluster_id", "reconstructed_sequence").orderBy("cluster_id").toLocalIterator():
        digest.update(f"{r[0]}\t{r[1]}\n".encode())
    return digest.hexdigest()


def measures() -> list[Column]:
    """Sums over the predictions of a run that need no grouping, so a job that writes them can observe them on its way."""
    return [
        F.count(F.lit(1)).alias("clusters"),
        F.sum("total_reads").alias("total_reads"),
        F.sum("consumed_reads").alias("consumed_reads"),
        F.count_if(F.col("consumed_reads") < F.col("total_reads")).alias("early_clusters"),
        F.count_if(F.col("status") == "completed_empty").alias("completed_empty"),
    ]


def totals(run: DataFrame | Observation) -> DataFrame | dict:
    """Of a run: clusters, reads, clusters stopped early or without a sequence, repeated ids; it passes if all was consumed.

    ``run``: predictions, which give one row, or what was observed of their ``measures``, which gives a dictionary, without
    repeated ids and without a job.
    """
    if isinstance(run, Observation):
        n = run.get
        return n | {"status": "PASS" if n["completed_empty"] == 0 and n["consumed_reads"] == n["total_reads"] else "FAIL"}
    n = run.agg(*measures(), (F.count(F.lit(1)) - F.count_distinct("cluster_id")).alias("duplicates"))
    return n.withColumn("status", F.when((F.col("completed_empty") == 0) & (F.col("consumed_reads") == F.col("total_reads")), "PASS").otherwise("FAIL"))


def by_task(pred: DataFrame, task: str | None = None) -> DataFrame:
    """Clusters, reads, and seconds where there are any, of each value of ``task``; without it of each partition as it lies."""
    worker = F.col(task) if task else F.spark_partition_id()
    spent = [F.sum("seconds").alias("seconds")] if "seconds" in pred.columns else []
    return pred.groupBy(worker.alias("worker_id")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("consumed_reads").alias("reads_consumed"), *spent)


def matrix(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Results of several sources side by side, for the combinations of keys that all of them have; columns get the source's name."""
    out = None
    for name, df in frames.items():
        df = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = df if out is None else out.join(df, keys)
    return out


def matrix_differences(observed: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Combinations of the axes (small frames of one column) that were not observed, and observed ones beyond them."""
    want = axes[0]
    for x in axes[1:]:
        want = want.crossJoin(x)
    have = observed.select(*want.columns)
    return want.exceptAll(have.distinct()).withColumn("side", F.lit("missing")).unionByName(have.distinct().exceptAll(want).withColumn("side", F.lit("extra")))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(cluster_id, state)`` for clusters that aren't the same in two predictions: missing, extra or changed."""
    a = old.select("cluster_id", F.col("reconstructed_sequence").alias("a"))
    b = new.select("cluster_id", F.col("reconstructed_sequence").alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return a.join(b, "cluster_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("cluster_id", state.alias("state"))


def with_means(rows: DataFrame, metrics: list[str], none: tuple[str, ...] = ("seed", "pred"), fixed: dict[str, str] = {"metric_closure": "PASS_ALL_ROUNDS"}) -> DataFrame:
    """Detail rows by threads and round, and a ``MEAN`` row for each number of threads with more than one round.

    Means skip nulls and have 12 digits; a mean row has no value of the columns ``none``, the values of ``fixed``, and those
    of the first round elsewhere.
    """
    others = [c for c in rows.columns if c not in (*metrics, "threads", "round")]
    by_round = F.col("round").cast("int")
    mean = rows.groupBy("threads").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in metrics], *[F.min_by(c, by_round).alias(c) for c in others], F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    mean = mean.withColumns({c: F.format_string("%.11e", c).cast("double") for c in metrics} | {c: F.lit(None).cast(rows.schema[c].dataType) for c in none if c in others} | {c: F.lit(v) for c, v in fixed.items() if c in others})
    return rows.withColumns({c: F.col(c).cast("double") for c in metrics} | {"round": F.col("round").cast("string")}).unionByName(mean.withColumn("round", F.lit("MEAN")))


def modal_length(reads: DataFrame, order: str) -> DataFrame:
    """The most frequent design length; of equal counts the one that comes first."""
    n = reads.groupBy("design_length").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return n.agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "design_length")).alias("best")).select(F.col("best.design_length").alias("design_length"))


def switches(rows: DataFrame, order: str, value: str) -> DataFrame:
    """How often a value changes from one arrival of a cluster to the next."""
    before = F.lag(value).over(Window.partitionBy("cluster_id").orderBy(order))
    return rows.withColumn("_s", (before.isNotNull() & (before != F.col(value))).cast("long")).groupBy("cluster_id").agg(F.sum("_s").alias("switches"))
