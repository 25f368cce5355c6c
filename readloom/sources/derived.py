"""Reads by formula from a table of events: users are clusters, events are noisy reads of the user's template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 64


def event_reads(events: DataFrame) -> DataFrame:
    """``READS`` columns with ``truth`` and arrival time ``ts``.

    By event_id: 0 and 1 of 5 are clean, 2 has a substitution, 3 a deletion, 4 an insertion, all at 1 + 7 * event_id mod
    64; then one of 13 has an N there, and one of 11 is in lower case.
    """
    e, p = F.col("event_id"), F.col("p")
    user = F.col("user_id").cast("string")
    tpl = F.translate(F.concat(F.md5(F.concat(F.lit("t0:"), user)), F.md5(F.concat(F.lit("t1:"), user))), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = events.select("event_id", "ts", user.alias("cluster_id"), tpl.alias("truth"), (1 + (7 * e) % LENGTH).cast("int").alias("p"))
    before = lambda c: F.substring(c, F.lit(1), p - 1)
    behind = lambda c: F.substring(c, p + 1, F.length(c))
    t = F.col("truth")
    one = F.substring(t, p, F.lit(1))
    kind = e % 5
    s = F.when(kind == 2, F.concat(before(t), F.translate(one, "ACGT", "CGTA"), behind(t))).when(kind == 3, F.concat(before(t), behind(t))).when(kind == 4, F.concat(before(t), one, F.lit("G"), behind(t))).otherwise(t)
    rows = rows.withColumn("s", s)
    rows = rows.withColumn("s", F.when(e % 13 == 0, F.concat(before(F.col("s")), F.lit("N"), behind(F.col("s")))).otherwise(F.col("s")))
    rows = rows.withColumn("s", F.when(e % 11 == 0, F.lower("s")).otherwise(F.col("s")))
    return rows.select(
        F.lit("events").alias("dataset_id"),
        "cluster_id",
        e.cast("string").alias("read_id"),
        F.col("s").alias("read_sequence"),
        F.lit("").alias("original_read_sequence"),
        F.lit("").alias("read_quality"),
        F.lit(LENGTH).alias("design_length"),
        "truth",
        "ts",
    )
