"""How far each turn of a conversation has moved from the first one of its role: distances, exact repeats, accuracy.

The comparison of two results of the same thing, as an evaluation of predictions against references makes it, for texts:
the reference of a conversation and role is its first turn, every later turn is compared with it byte by byte.

    python -m jobs.turn_drift --config jobs/turn_drift.json [--conversations DIR] [--output DIR]

Reads ``conversations(conv_id, turn, role, text)``.  Writes Parquet below the output folder: ``references`` (a row for each
conversation and role), ``turns`` and ``summary``, each by role.  A run replaces the roles it finds, so a second run over
the same table leaves the same output.  Rows without conv_id, turn or text are not compared; how many is logged.  A null
or empty role is a role of its own.  Of several first turns the least text is the reference; it isn't compared with itself.

One conversation may hold any share of the rows: references are small sums made before the shuffle, and the join with
them is one that Spark can split.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, main
from readloom.functions.distance import edit_distance
from readloom.operators.evaluate import summary

log = logging.getLogger("jobs.turn_drift")
DEFAULTS = {"conversations": None, "output": None}
TABLES = {
    "references": "conv_id long, first_turn long, reference string, copies long, role string",
    "turns": "conv_id long, turn long, first_turn long, pred_length int, truth_length int, edit_distance int, exact int, normalized_accuracy double, role string",
    "summary": "exact double, accuracy double, mean_ed double, evaluated_clusters long, exact_count long, total_ed long, total_truth_bases long, role string",
}


def _write(df: DataFrame, path: str, name: str) -> None:
    rows, seen = counted(df, name)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role").parquet(path)
    log.info("wrote %d rows of %s to %s", seen.get["rows"], name, path)


def read(spark: SparkSession, output: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}")


def run(spark: SparkSession, conversations: str, output: str) -> dict[str, DataFrame]:
    """Returns the written tables, read back."""
    every = spark.read.parquet(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.nullif(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("text").cast("string").alias("text"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull()
    turns = every.where(whole)

    first = F.struct("turn", "text")
    least = turns.groupBy("conv_id", "role").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
    _write(least.select("conv_id", F.col("first.turn").alias("first_turn"), F.col("first.text").alias("reference"), "copies", "role"), f"{output}/references", "references")

    n = every.agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("whole")).first()
    log.info("read %d rows of %s, %d without conversation, turn or text", n["rows"], conversations, n["rows"] - n["whole"])
    later = turns.join(read(spark, output, "references").withColumnRenamed("conv_id", "_conv").withColumnRenamed("role", "_role"), (F.col("conv_id") == F.col("_conv")) & F.col("role").eqNullSafe(F.col("_role")))
    rows = later.where("turn > first_turn or text <> reference").select(
        "conv_id", "turn", "first_turn", F.octet_length("text").alias("pred_length"), F.octet_length("reference").alias("truth_length"), edit_distance("text", "reference").alias("edit_distance"), "role"
    )
    accuracy = 1.0 - F.col("edit_distance") / F.greatest(F.lit(1), F.col("truth_length"))
    rows = rows.withColumns({"exact": (F.col("edit_distance") == 0).cast("int"), "normalized_accuracy": accuracy})
    _write(rows, f"{output}/turns", "turns")
    _write(summary(read(spark, output, "turns"), "role"), f"{output}/summary", "summary")
    return {name: read(spark, output, name) for name in TABLES}


if __name__ == "__main__":
    sys.exit(main(run, None, __doc__, DEFAULTS))
