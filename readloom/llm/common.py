"""Helpers shared by the training-data operators: table access, staging in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that all executors share.

    Only where that setting is missing and the master is local (tests) a temporary folder of this machine is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("readloom.local.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="readloom-")
            spark.conf.set("readloom.local.dir", base)
    path = f"{base.rstrip('/')}/readloom-{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_jsc", None) is None:  # the session has ended; nothing can be reached any more
        return
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of an Arrow batch: texts are long, and a batch is held several times on its way to Python and back.
BATCH_ROWS = 1500
#: Bytes of an Arrow batch, beyond which it takes no further row: rows of an index are as large as thousands of texts.
BATCH_BYTES = 16 << 20


def _release() -> None:
    """Give free memory back to the system: workers outlive their tasks, and later operators' tasks run in them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _releasing(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _release()

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` from here on in this session; a task's free memory goes back when it ends."""
    spark = df.sparkSession
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(name))[0]) <= most:
            spark.conf.set(name, str(most))
    return df.mapInArrow(_releasing(function), schema)


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
