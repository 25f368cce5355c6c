"""The jobs as queries: each runs twice over the whole tables into one new shared folder, and gives what then stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import incremental_reconstruction, turn_drift
from readloom.plans.catalogue import RECONSTRUCTED
from readloom.plans.staging import scratch


def job1_turn_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job1")
    for _ in range(2):
        tables = turn_drift.run(spark, f"{sf_dir}/conversations.parquet", out)
    rounded = [F.round(c, 9).alias(c) for c in ("exact", "accuracy", "mean_ed")]
    kinds = {
        "reference": tables["references"].select("role", "conv_id", F.col("first_turn").alias("turn"), F.sha2("reference", 256).alias("digest"), F.col("copies").alias("n")),
        "turn": tables["turns"].select("role", "conv_id", "turn", "first_turn", "pred_length", "truth_length", "edit_distance", F.col("exact").cast("double").alias("exact"), F.round("normalized_accuracy", 9).alias("accuracy")),
        "summary": tables["summary"].select("role", *rounded, F.col("evaluated_clusters").alias("n"), "exact_count", "total_ed", "total_truth_bases"),
    }
    all_ = None
    for kind, df in kinds.items():
        df = df.withColumn("kind", F.lit(kind))
        all_ = df if all_ is None else all_.unionByName(df, allowMissingColumns=True)
    return all_


def job2_incremental_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job2")
    for _ in range(2):
        got = incremental_reconstruction.run(spark, f"{sf_dir}/events.parquet*", out)
    return got.select("cluster_id", "design_length", "total_reads", "sequence", "family")


QUERIES = {f.__name__: f for f in (job1_turn_drift, job2_incremental_reconstruction)}

_JOB1 = """
WITH w AS (SELECT conv_id, turn, nullif(role, '') AS role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS r, count(*) OVER (PARTITION BY conv_id, role) AS n FROM w),
refs AS (SELECT conv_id, role, turn AS first_turn, text AS reference, n FROM f WHERE r = 1),
t AS (SELECT w.role, w.conv_id, w.turn, refs.first_turn, CAST(strlen(w.text) AS INT) AS pred_length, CAST(strlen(reference) AS INT) AS truth_length, CAST(levenshtein(w.text, reference) AS INT) AS edit_distance
      FROM w JOIN refs ON w.conv_id = refs.conv_id AND w.role IS NOT DISTINCT FROM refs.role WHERE w.turn > first_turn OR w.text <> reference),
e AS (SELECT *, CAST(edit_distance = 0 AS INT) AS exact, 1.0 - CAST(edit_distance AS DOUBLE) / greatest(1, truth_length) AS accuracy FROM t)
SELECT 'reference' AS kind, role, conv_id, first_turn AS turn, NULL AS first_turn, NULL AS pred_length, NULL AS truth_length, NULL AS edit_distance, NULL AS exact, NULL AS accuracy, NULL AS mean_ed,
       sha256(reference) AS digest, n, NULL AS exact_count, NULL AS total_ed, NULL AS total_truth_bases FROM refs
UNION ALL SELECT 'turn', role, conv_id, turn, first_turn, pred_length, truth_length, edit_distance, CAST(exact AS DOUBLE), round(accuracy, 9), NULL, NULL, NULL, NULL, NULL, NULL FROM e
UNION ALL SELECT 'summary', role, NULL, NULL, NULL, NULL, NULL, NULL, round(avg(exact), 9), round(avg(accuracy), 9), round(avg(edit_distance), 9), NULL, count(*),
       CAST(sum(exact) AS BIGINT), CAST(sum(edit_distance) AS BIGINT), CAST(sum(truth_length) AS BIGINT) FROM e GROUP BY role
"""
ORACLE_SQL = {"job1_turn_drift": _JOB1, "job2_incremental_reconstruction": RECONSTRUCTED}
