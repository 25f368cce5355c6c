"""What a task holds, and how often a table is shuffled, on tables whose tasks are as large as they get."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from readloom.llm import decontaminate, substring
from readloom.llm.common import map_arrow


def test_row_groups_of_an_index_hold_a_few_segments(spark):
    """One task with nine segments: readers take a row group at once."""
    text = F.repeat(F.concat(F.lit("w" * 100), F.col("id").cast("string"), F.lit(" ")), 42_000)
    stored = decontaminate.index(spark.range(9).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text")))
    groups = [m.row_group(i).num_rows for m in (pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()) for i in range(m.num_row_groups)]
    assert sum(groups) == 9 and max(groups) <= 4


def test_batches_of_large_rows_are_small(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], names=["rows"])

    rows = spark.range(10, 50).coalesce(1).select(F.repeat(F.col("id").cast("string"), 1 << 19).alias("text"))
    got = [r["rows"] for r in map_arrow(rows, count, "rows int").collect()]
    assert sum(got) == 40 and max(got) <= 20


def test_salted_and_plain_anchors_share_one_shuffle(spark, monkeypatch):
    """No filter on the salt below a window: such ones would make several shuffles of one."""
    for name, value in (("SAMPLE", 1), ("LEAST", 2), ("SHARE", 100)):
        monkeypatch.setattr(substring, name, value)
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 20}" for j in range(i % 7, 60))) for i in range(40)], "doc_id long, text string")
    plan = substring.repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "salt" in x]
    assert filters and all("first_doc" in x for x in filters)
