"""A session: validate reads, replay orders, reconstruct, evaluate, and publish results in one rename.

    python -m readloom run --data DIR [--aim | --no-aim] [--length N] [--k 5..15] [--threads 1,2]
                           [--seeds a,b | --rounds N] --results DIR
"""

from __future__ import annotations

import argparse
import secrets
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom.operators import evaluate as ev
from readloom.operators import order as od
from readloom.operators.decode import decode, predictions, stop_points
from readloom.operators.validate import blocks, evaluation_violations, id_differences, require, truth_violations, violations
from readloom.schema import LEAST_K, MOST_K, MOST_LENGTH, Config, parse_threads
from readloom.sources import files, tsv

METRICS = ["exact", "accuracy", "mean_ed"]
TIMES = ["engine_time_s", "round_time_s"]


def closure(reads: DataFrame, pred: DataFrame, truth: DataFrame | None) -> dict[str, object]:
    """Counts that show input, predictions and truth to have the same clusters; raises if they haven't."""
    require(id_differences(reads, pred), "predictions and input differ")
    ids = lambda df: df.agg(F.count(F.lit(1)), F.count_distinct("cluster_id")).first()
    n_in, n_pred, n_truth = ids(reads), ids(pred), (None, None)
    if truth is not None:
        require(id_differences(reads, truth), "truth and input differ")
        n_truth = ids(truth)
    none = None if truth is None else 0
    twice = {"duplicate_pred": n_pred[0] - n_pred[1], "duplicate_truth": None if truth is None else n_truth[0] - n_truth[1]}
    if any(twice.values()):
        raise ValueError(f"clusters occur twice: {twice}")
    return {"input_rows": n_in[0], "input_unique_clusters": n_in[1], "pred_rows": n_pred[0], "pred_unique_clusters": n_pred[1], "truth_rows": n_truth[0], "truth_unique_clusters": n_truth[1], "duplicate_input": 0, **twice, "missing_pred": 0, "extra_pred": 0, "missing_truth": none, "extra_truth": none, "metric_closure": "PASS"}


def identity(spark: SparkSession, data: str, digest: bool = False) -> dict[str, list]:
    """Size and time of change of a session's input files, with ``digest`` their content too, to see that they stay the same."""
    found = {}
    for name in ("reads.tsv", "truth.tsv"):
        if now := files.files(spark, f"{data}/{name}"):
            found[name] = [sorted(now.items()), *(tsv.content(spark, f"{data}/{name}") if digest else [])]
    return found


def _kinds(row: dict) -> str:
    return ", ".join(f"{c} {'double' if c in (*METRICS, *TIMES, 'total_wall_seconds', 'task_wall_seconds') else 'string' if isinstance(x, str) else 'long'}" for c, x in row.items())


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Written and read back: what is asked again and again is made once, and outlives executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, data: str, results: str, aim: bool = False, length: int | None = None, k: int = 9, threads: list[int] | None = None, seeds: list[str] | None = None, rounds: int = 1, digest: bool = False, prefix: str = od.PREFIX) -> str:
    """Returns the session's folder.  Both folders may be on any file system that Spark reaches.

    Results don't depend on ``threads``, which set the number of shuffle partitions; without any, Spark's own setting
    stays.  ``prefix`` begins what replay orders are seeded with.
    """
    if length is not None and not k <= length <= MOST_LENGTH:
        raise ValueError(f"length must be {k} to {MOST_LENGTH}")
    if seeds is not None and not seeds or rounds < 1:
        raise ValueError("at least one seed or round is needed")
    cfg, began, results = Config(k=k), datetime.now(timezone.utc), results.rstrip("/")
    name = began.strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    stage, setting = f"{results}/.{name}.partial", "spark.sql.shuffle.partitions"
    partitions = spark.conf.get(setting)
    manifest = {"config": cfg.name, "data": data, "started": began.isoformat(), "aim": aim, "length": length, "order_prefix": prefix}
    try:
        before = identity(spark, data, digest)
        reads = tsv.read_reads(spark, f"{data}/reads.tsv", length)
        require(violations(reads, k), "reads are not valid")
        require(blocks(reads).where("n_blocks > 1"), "clusters are not contiguous")
        dataset = reads.first()["dataset_id"]
        truth = None
        if "truth.tsv" in before:
            truth = tsv.read_truth(spark, f"{data}/truth.tsv")
            require(truth_violations(truth), "truth is not valid")
        elif aim:
            raise ValueError("--aim needs truth.tsv")
        labels = [(s, i) for i, s in enumerate(seeds, 1)] if seeds else [(secrets.token_hex(16), i) for i in range(1, rounds + 1)]
        modal = ev.modal_length(reads.withColumn("_at", F.monotonically_increasing_id()), "_at").first()[0]
        rows = []
        for seed, i in labels:
            tsv.write_orders(od.orders(reads, seed, dataset, prefix), f"{stage}/.orders/round_{i}")
        for n in threads or [spark.sparkContext.defaultParallelism]:
            if threads:
                spark.conf.set(setting, str(n))
            for seed, i in labels:
                t0 = time.time()
                order = tsv.read_orders(spark, f"{stage}/.orders/round_{i}")
                require(od.broken(order, reads), "the replay order is not one of the reads")
                label = f"threads_{n}_round_{i}"
                out = f"{stage}/{label}"
                # the job that writes the predictions counts them too; a partition counts once, however often it is tried
                seen = Observation()
                timed = predictions(decode(reads, cfg, timed=True), dataset, "task", "seconds").observe(seen, *ev.measures(), F.sum("seconds").alias("task_wall_seconds"))
                timed = _kept(timed, f"{stage}/.kept/pred_{label}")
                pred = timed.drop("task", "seconds")
                tsv.write_rows(pred, f"{out}/pred.tsv", "cluster_id")
                tsv.write_rows(stop_points(pred, str(i)), f"{out}/STOP_POINT_WALL.tsv", "cluster_id")
                engine = time.time() - t0
                row = {"dataset": dataset, "threads": n, "round": i, "seed": seed, "design_length": modal} | dict.fromkeys([*METRICS, "evaluated_clusters", "exact_count", "total_ed", "total_truth_bases"])
                if truth is not None:
                    scored = _kept(ev.evaluate(pred, truth), f"{stage}/.kept/scored_{label}")
                    tsv.write_rows(scored, f"{out}/evaluation.tsv", "cluster_id")
                    require(evaluation_violations(scored), "distances are not valid")
                    row |= ev.summary(scored).first().asDict()
                row |= {"engine_time_s": engine, "round_time_s": time.time() - t0, "pred": f"{label}/pred.tsv"} | closure(reads, pred, truth)
                total = ev.totals(seen)
                spent, status = total.pop("task_wall_seconds"), total.pop("status")
                total |= {"duplicates": row["duplicate_pred"], "status": status}
                whole = {"dataset": dataset, "round_id": str(i), "workers": n} | total | {"total_wall_seconds": time.time() - t0, "task_wall_seconds": spent}
                tsv.write_rows(spark.createDataFrame([tuple(whole.values())], _kinds(whole)), f"{out}/RUN_METRICS.tsv")
                tsv.write_rows(ev.by_task(timed, "task"), f"{out}/WORKER_LEDGER.tsv", "worker_id")
                if status != "PASS":
                    raise ValueError("a cluster has no sequence, or reads that weren't consumed")
                tsv.write_rows(spark.createDataFrame([tuple(row.values())], _kinds(row)), f"{out}/summary.tsv")
                rows.append(row)
        table = spark.createDataFrame([tuple(r.values()) for r in rows], _kinds(rows[0]))
        if identity(spark, data, digest) != before:
            raise ValueError("input files changed while the session ran")
        manifest["files"] = before
        tsv.write_rows(ev.with_means(table, [*METRICS, *TIMES]), f"{stage}/SUMMARY.tsv")
        files.delete(spark, f"{stage}/.kept")
        tsv.write_json(spark, manifest, f"{stage}/RUN_MANIFEST.json")
        tsv.write_json(spark, {"status": "COMPLETED"}, f"{stage}/RUN_STATUS.json")
    except BaseException as e:
        end = "interrupted" if isinstance(e, KeyboardInterrupt) else "failed"
        tsv.write_json(spark, {"status": end.upper(), "error": str(e)[:2000]}, f"{stage}/RUN_STATUS.json")
        files.move(spark, stage, f"{results}/{name}.{end}")
        raise
    finally:
        spark.conf.set(setting, partitions)
    files.move(spark, stage, f"{results}/{name}")
    return f"{results}/{name}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="readloom")
    r = p.add_subparsers(dest="command", required=True).add_parser("run")
    r.add_argument("--data", required=True)
    r.add_argument("--results", required=True)
    r.add_argument("--aim", action=argparse.BooleanOptionalAction, default=False)
    r.add_argument("--length", type=int)
    r.add_argument("--k", type=int, choices=range(LEAST_K, MOST_K + 1), default=9)
    r.add_argument("--threads", type=parse_threads, help="numbers of shuffle partitions; Spark's setting stays without")
    r.add_argument("--digest", action="store_true", help="compare the input's content too, before and after")
    r.add_argument("--order-prefix", default=od.PREFIX)
    group = r.add_mutually_exclusive_group()
    group.add_argument("--seeds", type=lambda s: [x for x in s.split(",") if x])
    group.add_argument("--rounds", type=int, default=1)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    print(run(spark, a.data, a.results, a.aim, a.length, a.k, a.threads, a.seeds, a.rounds, a.digest, a.order_prefix))
    return 0
