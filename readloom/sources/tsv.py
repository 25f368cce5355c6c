"""Tab-separated reads, truth, predictions and evaluator rows; JSON-lines replay orders.  Explicit schemas, checked headers.

Files are read by Spark (gzip included) and stay distributed.  Results are written by tasks, a single file by
one of them, and become visible by a rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.operators.validate import prediction_violations, require
from readloom.schema import ORDER, PREDICTION, READS, TRUTH, TRUTH_KEYED
from readloom.sources import files


def _lines_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def header(spark: SparkSession, path: str) -> list[str]:
    rows = _lines_of(spark, path).limit(1).collect()
    line = rows[0][0] if rows else ""
    if line.endswith("\r"):
        raise ValueError(f"{path}: the header ends with a carriage return")
    return line.split("\t")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows, with a ``_corrupt`` column that holds lines of another number of fields.

    Fields are split at tabs and taken as they are: no quotes, and empty fields are empty strings.  Numbers that aren't
    numbers are null.  Of one file the first line is the header, of a folder every line equal to it.
    """
    names = schema.fieldNames()
    found = header(spark, path)
    if found != names:
        raise ValueError(f"{path}: header {found} is not {names}")
    lines = _lines_of(spark, path).select("value", F.monotonically_increasing_id().alias("at"))
    head = F.col("value") == "\t".join(names)
    if len(lines.inputFiles()) == 1:  # the first partition begins where the file does
        head = head & (F.col("at") == 0)
    rows = lines.where(~head).select("value", F.split("value", "\t", -1).alias("f"))
    fields = [F.expr(f"try_cast(f[{i}] AS {x.dataType.simpleString()})").alias(x.name) for i, x in enumerate(schema.fields)]
    rows = rows.withColumn("right", F.size("f") == len(names)).withColumn("f", F.when(F.col("right"), F.col("f")).otherwise(F.array_repeat(F.lit(""), len(names))))
    return rows.select(*fields, F.when(~F.col("right"), F.col("value")).alias("_corrupt"))


def read_reads(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """Reads; ``length`` overrides their design length."""
    reads = read_tsv(spark, path, READS)
    return reads if length is None else reads.withColumn("design_length", F.lit(length))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(cluster_id, sequence)`` from either of the two formats."""
    if header(spark, path) == TRUTH.fieldNames():
        return read_tsv(spark, path, TRUTH)
    keyed = read_tsv(spark, path, TRUTH_KEYED)
    return keyed.select(F.get(F.split("row_key", r"\|"), F.lit(1)).alias("cluster_id"), F.coalesce("reference_sequence", F.lit("")).alias("sequence"), "_corrupt")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions, checked: no line of another form, no cluster twice, at least one."""
    pred = read_tsv(spark, path, PREDICTION)
    require(prediction_violations(pred), f"{path}: predictions are not valid")
    return pred.drop("_corrupt")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(key, a, b)`` from lines without a header.  Blank lines don't count; a carriage return, another number of fields or an empty key is an error."""
    f = F.split("value", "\t", -1)
    bad = F.col("value").endswith("\r") | (F.size(f) != 3) | (f[0] == "")
    lines = _lines_of(spark, path).where("value <> ''")
    line = F.when(bad, F.raise_error(F.concat(F.lit("expected a key and two sequences: "), "value"))).otherwise(f)
    return lines.select(line.alias("f")).select(F.col("f")[0].alias("key"), F.col("f")[1].alias("a"), F.col("f")[2].alias("b"))


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDER).json(path)


def write_orders(orders: DataFrame, path: str) -> None:
    orders.write.mode("errorifexists").json(path, compression="gzip")


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of TSV parts, for results of any size."""
    df.write.mode("errorifexists").options(sep="\t", header=True, quote="", emptyValue="").csv(path)


def text(value: object, digits: bool = False) -> str:
    """``digits``: floating point numbers in 12 digits."""
    return "NA" if value is None else f"{value:.12g}" if digits and isinstance(value, float) else str(value)


def _formatted(names: list[str], key: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in batch.select(names).to_pylist():
                mean = row.get("round") == "MEAN"
                lines.append("\t".join(text(x, mean) for x in row.values()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], pa.array(lines, pa.string())], names=[*key, "_line"])

    return run


def write_rows(df: DataFrame, path: str, order: str | None = None) -> None:
    """One TSV file with a header, on any file system: tasks make the lines, one task merges them, a rename makes the file visible.

    Rows stand in the order of a column, or else as they lie.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", F.col(order) if order else F.monotonically_increasing_id())
    kind = keyed.schema["_key"].dataType.simpleString()
    rows = keyed.mapInArrow(_formatted(df.columns, ["_key"]), f"_key {kind}, _line string").select(F.lit(1).alias("_at"), "_key", "_line")
    head = spark.createDataFrame([("\t".join(df.columns),)], "_line string").select(F.lit(0).alias("_at"), F.lit(None).cast(kind).alias("_key"), "_line")
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    # one task, but no collection of it: its sort spills
    head.unionByName(rows).repartition(1).sortWithinPartitions("_at", "_key").select("_line").write.option("lineSep", "\n").text(part, compression="none")
    made = [x for x in files.files(spark, part) if x.startswith("part-")]
    if len(made) != 1:
        raise OSError(f"{part}: expected one part, found {made}")
    files.move(spark, f"{part}/{made[0]}", path)
    files.delete(spark, part)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small value as a new file, under its name only when it is whole."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    files.write(spark, part, json.dumps(value, indent=2, sort_keys=True) + "\n")
    files.move(spark, part, path)


def content(spark: SparkSession, path: str) -> list[int]:
    """Number of lines and a sum of their hashes, by tasks: equal for equal lines in any order."""
    total = _lines_of(spark, path).agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first()
    return [total[0], int(total[1] or 0)]
