"""Folders that all executors share, for streams and their checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """Under ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a temporary folder of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="readloom-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
