"""Reconstruct clusters of reads as they come in: each run takes only files that are new and decodes only clusters they touch.

    python -m jobs.incremental_reconstruction --config jobs/incremental_reconstruction.json [--events PATTERN] [--output DIR] ...

Reads event files (Parquet, ``event_id``, ``ts``, ``user_id``) as a file stream that ends with what is there, derives reads
from them, and keeps below the output folder:

``ledger``       counters of all reads so far, a batch of new files as one partition; earlier ones are never rewritten
``predictions``  ``batch=.../part=...``: for each batch the sequences of the clusters that it touched
``checkpoint``   Spark's log of the files taken

``latest`` gives the valid prediction of each cluster, that of its last batch.  A batch that failed is taken again with the
same number and replaces what it had written; a run without new files changes nothing.  Predictions equal those of all
reads decoded at once.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, main
from readloom.operators import store
from readloom.operators.decode import FAMILIES
from readloom.schema import Config
from readloom.sources.derived import event_reads

log = logging.getLogger("jobs.incremental_reconstruction")
DEFAULTS = {"events": None, "output": None, "config_name": Config().name, "parts": 16, "files_a_batch": 1000}
EVENTS = "event_id long, ts timestamp, user_id long"
PREDICTIONS = "cluster_id string, design_length int, total_reads long, sequence string, family string, batch long, part int"


def latest(spark: SparkSession, output: str) -> DataFrame:
    """``(cluster_id, design_length, total_reads, sequence, family, batch)``: a row for each cluster."""
    columns = ["batch", "design_length", "total_reads", "sequence", "family"]
    rows = spark.read.schema(PREDICTIONS).parquet(f"{output}/predictions")
    return rows.groupBy("cluster_id").agg(F.max(F.struct(*columns)).alias("last")).select("cluster_id", *[F.col(f"last.{c}").alias(c) for c in columns])


def run(spark: SparkSession, events: str, output: str, config_name: str = Config().name, parts: int = 16, files_a_batch: int = 1000) -> DataFrame:
    """Take all new files that match ``events``, a folder or pattern; returns ``latest``."""
    cfg, ledger = Config.parse(config_name), f"{output}/ledger"
    family = F.element_at(F.create_map(*[F.lit(x) for item in FAMILIES.items() for x in item]), F.col("family"))

    def take(batch: DataFrame, number: int) -> None:
        rows, seen = counted(batch.where("event_id is not null and user_id is not null"), f"events_{number}")
        reads = event_reads(rows)
        store.append(reads, ledger, number, cfg, parts)
        log.info("batch %d: read %d events, stored their counters in %s", number, seen.get["rows"], ledger)
        touched = store.stored(spark, ledger, cfg, number).where(F.col("batch") == number).select("cluster_id")
        decoded = store.decode_stored(spark, ledger, touched, cfg, number, parts).withColumns({"family": family, "batch": F.lit(number).cast("long"), "part": store.part_of("cluster_id", parts)})
        out, done = counted(decoded.select(*[c.split()[0] for c in PREDICTIONS.split(", ")]), f"predictions_{number}")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(f"{output}/predictions")
        log.info("batch %d: wrote %d predictions to %s/predictions", number, done.get["rows"], output)

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(events)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [p for p in query.recentProgress if p["numInputRows"]]
    log.info("took %d batches of %s", len(taken), events)
    return latest(spark, output)


if __name__ == "__main__":
    sys.exit(main(run, None, __doc__, DEFAULTS))
