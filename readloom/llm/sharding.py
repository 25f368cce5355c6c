"""Sharding by sampled splitters, of near equal bytes (operator 8).  DataFrame functions only.

Rows are ordered by (hash of text, hash of doc_id), so equal texts lie together and one text's copies can still be parted.
Splitters: keys are drawn with a chance in proportion to their size, quantiles of the draw cut the key space into many
more ranges than shards.  Ranges over twice their share of bytes, or over twice ``RANGE_ROWS`` rows (one key repeated, an
unlucky draw, or more rows than the first level has ranges for), are subdivided by a hash: the second level.
Ranges' exact bytes and rows then give every range its place; a row's place in its range gives its shard and slot.  So
shards' sizes differ by about one row's size, whatever was drawn, and no task sorts more than one range.

The draw is ``DRAWS`` keys a range on average and the first level has at most ``MOST_RANGES``: that bounds what the driver
holds.  It bounds nothing else: whatever the number of rows, a piece of the second level has about ``RANGE_ROWS`` at most.

A null text has size 16 and the empty text's hash and checksum.  Rows that repeat a doc_id get a slot each.  Law ``bytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import staged

SHARDS, RANGE_ROWS, LEAST_RANGES, MOST_RANGES, DRAWS = 40, 200_000, 256, 16_384, 24


def _range(cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted splitters are at or before the key: found among every ``step``-th, then among the next ones."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    lit = lambda c: f"struct({c[0]}L as h1, {c[1]}L as h2)".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
    array = lambda xs: "array(" + ", ".join(map(lit, xs)) + ")"
    key = "struct(h1, h2)"
    coarse = f"size(filter({array(cuts[step - 1 :: step])}, c -> c <= {key}))" if cuts[step - 1 :: step] else "0"
    return F.expr(f"{step} * {coarse} + size(filter(slice({array(cuts)}, {step} * {coarse} + 1, {step}), c -> c <= {key}))")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)).alias("h2"),
    )
    keys = staged(keys, "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, rows // RANGE_ROWS))
    # a key of size s is drawn s * rate times on average: the whole part for certain, the rest by a hash of the row
    rate = F.col("size") * F.lit(DRAWS * ranges / max(total, 1))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.select("h1", "h2", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).alias("draws")).where("draws > 0")
    sample = sorted((r["h1"], r["h2"], r["draws"]) for r in drawn.collect())  # about DRAWS * ranges rows
    cuts, seen, each = [], 0, sum(r[2] for r in sample) / ranges
    for h1, h2, n in sample:
        seen += n
        if seen >= (len(cuts) + 1) * each and len(cuts) < ranges - 1:
            cuts.append((h1, h2))
            seen = max(seen, (len(cuts)) * each)
    keyed = keys.withColumn("range", _range(cuts))
    sizes = keyed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    share = F.lit(max(total, 1) / ranges)
    over = lambda x, least: F.when(x > 2 * least, F.ceil(x / least)).otherwise(F.lit(1))
    parts = F.greatest(over(F.col("bytes"), share), over(F.col("n"), F.lit(RANGE_ROWS))).alias("parts")
    # at most ``ranges`` rows, then a row for each piece
    placed = staged(keyed.join(F.broadcast(sizes.select("range", parts)), "range").withColumn("part", F.pmod(F.xxhash64("h2", "doc_id", F.lit(3)), F.col("parts"))).drop("parts"), "ranges")
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    bases = pieces.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"))
    within = Window.partitionBy("range", "part").orderBy("h1", "h2", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("byte0") + F.sum("size").over(within) - F.col("size") / 2
    ranked = placed.join(F.broadcast(bases), ["range", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("row0") + F.row_number().over(within) - 1).alias("place"),
    )
    ranked = staged(ranked, "places")
    first = ranked.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
