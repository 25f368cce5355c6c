"""Files and folders of any file system that Spark reaches, by the session's Hadoop settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """One rename; an existing target or a missing source is an error."""
    where, fs = _at(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(target) or not fs.rename(where, target):
        raise OSError(f"could not move {old} to {new}")


def write(spark: SparkSession, path: str, content: str) -> None:
    """A small text as a new file."""
    where, fs = _at(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Size and time of change of a file, or of each file of a folder, by name; nothing where nothing is."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return {}
    return {s.getPath().getName(): [s.getLen(), s.getModificationTime()] for s in fs.listStatus(where) if s.isFile()}
