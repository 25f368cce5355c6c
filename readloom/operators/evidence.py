"""Additive evidence of clustered reads.  Native DataFrame aggregations, partial before every shuffle.

All counters are linear in the number of equal reads, so equal reads are one row with a multiplicity before their grams
are taken.  Single counters have grams as strings (their order is that of their codes), ledgers as 2-bit codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.columns import canonical, code

KINDS = {"node": 0, "edge": 1, "outgoing": 2, "start": 3, "end": 4}
#: The kind of reads themselves among counters.
READ = 5


def multiplicity(reads: DataFrame) -> DataFrame:
    """``(cluster_id, design_length, seq, n)``: canonical reads, each once."""
    return reads.select("cluster_id", "design_length", canonical("read_sequence").alias("seq")).groupBy("cluster_id", "design_length", "seq").agg(F.count(F.lit(1)).alias("n"))


def _size(least: int = 0) -> Column:
    """The length of a counted read, null if under ``least``.

    It depends on the count in form, so that filters by it stay behind the counting: pushed below it they would make
    every read canonical twice.
    """
    return F.when((F.col("n") > 0) & (F.length("seq") >= least), F.length("seq"))


#: Reads whose grams a task adds up, and tasks below which Spark deals them by bytes.
A_TASK, FEW = 25_000, 32


def tasks(reads: DataFrame) -> int:
    """Tasks that the grams of ``reads`` ask for.  Counting asks files for no column."""
    return -(-reads.count() // A_TASK)


def _together(mult: DataFrame, many: int | None) -> DataFrame:
    """Counted reads dealt by cluster before their grams are taken.

    A task then adds up nearly all of a cluster's equal grams before they are shuffled, and holds those of its own clusters
    alone.  Spark deals a large cluster to several tasks; the hash, not the cluster, as key keeps the later grouping free of
    this dealing, which therefore may be uneven.
    A byte of reads gives many grams, so tasks of so many bytes would hold more grams the more reads there are: with
    ``many``, as of ``tasks``, the number of tasks grows instead.  Ranges of both hash and read part a large cluster too.
    """
    if many is not None and many >= FEW:
        return mult.withColumn("_dealt", F.xxhash64("cluster_id")).repartitionByRange(many, "_dealt", "seq").drop("_dealt")
    return mult.withColumn("_dealt", F.xxhash64("cluster_id")).hint("rebalance", "_dealt").drop("_dealt")


def grams(mult: DataFrame, size: int, many: int | None = None) -> DataFrame:
    """``(cluster_id, seq, n, pos, gram)``: windows of ``size`` bases without N."""
    out = _together(mult, many).select("cluster_id", "seq", "n", F.explode(F.sequence(F.lit(1), _size(size) - size + 1)).alias("pos"))
    # as a coalesce: from a plain predicate a check of ``seq`` for nulls would be inferred, and pushed below the counting
    return out.withColumn("gram", F.substring("seq", F.col("pos"), F.lit(size))).where(F.coalesce(~F.col("gram").contains("N"), F.lit(False)))


def nodes(mult: DataFrame, k: int, many: int | None = None) -> DataFrame:
    return grams(mult, k, many).groupBy("cluster_id", F.col("gram").alias("context")).agg(F.sum("n").alias("support"))


def edges(mult: DataFrame, k: int, many: int | None = None) -> DataFrame:
    """``(cluster_id, context, base, support)``"""
    summed = grams(mult, k + 1, many).groupBy("cluster_id", "gram").agg(F.sum("n").alias("support"))
    return summed.select("cluster_id", F.substring("gram", 1, k).alias("context"), F.substring("gram", k + 1, 1).alias("base"), "support")


def outgoing(edge: DataFrame) -> DataFrame:
    """Derived from edges: no second pass over reads."""
    return edge.groupBy("cluster_id", "context").agg(F.sum("support").alias("support"))


def terminals(mult: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, seq, n, first, last)``: a read's first and last gram, for reads that have one.  No gram is exploded."""
    gram = f"[ACGT]{{{k}}}"
    both = mult.select("cluster_id", "seq", "n", F.regexp_extract("seq", gram, 0).alias("first"), F.regexp_extract("seq", f"^.*({gram})", 1).alias("last"))
    return both.where("n > 0 and if(n > 0, first, '') <> ''")


def starts(mult: DataFrame, k: int) -> DataFrame:
    return terminals(mult, k).groupBy("cluster_id", F.col("first").alias("context")).agg(F.sum("n").alias("support"))


def ends(mult: DataFrame, k: int) -> DataFrame:
    return terminals(mult, k).groupBy("cluster_id", F.col("last").alias("context")).agg(F.sum("n").alias("support"))


#: Bases whose 2-bit codes fit a long.
PACK = 31


def counters(mult: DataFrame, k: int, kinds: tuple[str, ...] = tuple(KINDS), reads: bool = False, many: int | None = None) -> DataFrame:
    """``(cluster_id, kind, code, support)`` of several counters by one explosion and one grouping.

    Reads are packed ``PACK`` bases at a time, two bits a base; the codes of all grams that begin in a pack are shifts of
    its number, so no gram is ever a text.  ``reads``: the reads themselves too, as kind ``READ`` with a column ``seq``.
    """
    step = PACK - k  # every pack holds the base behind each gram that begins in it
    ends_ = [x for x in ("start", "end") if x in kinds]
    gram = f"[ACGT]{{{k}}}"
    both = {"start": F.regexp_extract("seq", gram, 0), "end": F.regexp_extract("seq", f"^.*({gram})", 1)}
    base = _together(mult, many).select("cluster_id", "seq", "n", *[F.when(F.col("n") > 0, both[x]).alias(f"_{x}") for x in ends_])
    base = base.select("cluster_id", "seq", "n", *[F.when(F.col(f"_{x}") != "", code(F.col(f"_{x}"))).alias(f"_{x}") for x in ends_])
    # places below 1 stand for what a read has once; the others are where packs begin
    once = [F.when(F.col(f"_{x}").isNotNull(), F.lit(-KINDS[x])) for x in ends_] + ([F.lit(-READ)] if reads else [])
    packs = F.when(_size(k).isNotNull(), F.sequence(F.lit(1), _size(k) - k + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    at = base.withColumn("at", F.explode(F.concat(F.array_compact(F.array(*once)), packs) if once else packs))
    text = F.substring("seq", F.col("at"), F.lit(PACK))
    number = lambda digits: F.conv(F.translate(F.col("text"), "ACGTN", digits), 4, 10).cast("long")
    pack = at.withColumn("text", F.when(F.col("at") > 0, text))
    pack = pack.withColumns({"bits": number("01230"), "bad": F.when(F.col("text").contains("N"), number("00003")).otherwise(F.lit(0)), "size": F.coalesce(F.length("text"), F.lit(k))})
    offsets = F.sequence(F.lit(0), F.least(F.lit(step), F.col("size") - k + 1) - 1)
    keep = ["cluster_id", "n", "at", "bits", "bad", "size", *[f"_{x}" for x in ends_], *(["seq"] if reads else [])]
    each = pack.select(*keep, F.explode(offsets).alias("o"))
    # the gram behind offset o lies that many bits above the pack's end
    bits = lambda c, w: F.expr(f"shiftright({c}, CAST(2 * (size - o - {w}) AS INT)) & {(1 << (2 * w)) - 1}L")
    inner, edge = F.col("at") > 0, (F.col("size") - F.col("o") > k)
    whole_edge = inner & edge & (F.when(edge, bits("bad", k + 1)).otherwise(F.lit(1)) == 0)
    context = bits("bits", k)
    said = {"node": (inner & (bits("bad", k) == 0), context), "edge": (whole_edge, F.when(edge, bits("bits", k + 1))), "outgoing": (whole_edge, context)}
    text_of = lambda c: [c.alias("seq")] if reads else []
    entry = lambda kind, ok, c: F.struct(F.when(ok, F.lit(KINDS[kind])).alias("kind"), c.alias("code"), *text_of(F.lit(None).cast("string")))
    entries = [entry(x, *said[x]) for x in kinds if x in said]
    if once:
        kind = -F.col("at")
        own = F.coalesce(*[F.when(kind == KINDS[x], F.col(f"_{x}")) for x in ends_], F.lit(0).cast("long"))
        entries.append(F.struct(F.when(~inner, kind).alias("kind"), own.alias("code"), *text_of(F.when(kind == READ, F.col("seq")))))
    parts = each.select("cluster_id", "n", F.inline(F.array(*entries))).where("kind is not null")
    return parts.groupBy("cluster_id", "kind", "code", *(["seq"] if reads else [])).agg(F.sum("n").alias("support"))


def ledger(mult: DataFrame, k: int, many: int | None = None) -> DataFrame:
    """All counters in long form: ``(cluster_id, kind, code, support)``."""
    return counters(mult, k, many=many)


def merge(*ledgers: DataFrame) -> DataFrame:
    """Ledgers of disjoint blocks of reads add up to the ledger of all."""
    out = ledgers[0]
    for x in ledgers[1:]:
        out = out.unionByName(x)
    return out.groupBy("cluster_id", "kind", "code").agg(F.sum("support").alias("support"))


def length_stats(reads: DataFrame) -> DataFrame:
    """Reads, exact-length reads, sums of ln(length), exact median of canonical lengths."""
    seq = reads.select("cluster_id", "design_length", F.octet_length("read_sequence").alias("len"))
    ln = F.log(F.greatest(F.lit(1), F.col("len")).cast("double"))
    return seq.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(F.col("len") == F.col("design_length")).alias("exact_reads"),
        F.sum(ln).alias("log_sum"),
        F.sum(ln * ln).alias("log_sq_sum"),
        F.percentile("len", F.lit(0.5)).alias("median_length"),
    )


def most_frequent_read(mult: DataFrame, exact: bool = False) -> DataFrame:
    """The most frequent canonical read of each cluster, or of its design length; ties go to the least sequence."""
    rows = mult.where(_size() == F.col("design_length")) if exact else mult
    best = rows.groupBy("cluster_id", "seq").agg(F.sum("n").alias("n")).groupBy("cluster_id").agg(F.max("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), F.col("seq").alias("seq"))).alias("best"))
    return best.select("cluster_id", F.col("best.seq").alias("seq"), "n")


def top_starts(mult: DataFrame, k: int, beam: int = 16) -> DataFrame:
    """The ``beam`` best supported first grams of each cluster, with totals over all of them."""
    whole = Window.partitionBy("cluster_id")
    by = whole.orderBy(F.col("support").desc(), "context")
    rows = starts(mult, k).select("*", F.row_number().over(by).alias("place"), F.sum("support").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("kinds"))
    return rows.where(F.col("place") <= beam)


def prefix_support(reads: DataFrame, order: str) -> DataFrame:
    """Running evidence at each arrival: reads, distinct canonical reads and exact-length reads so far."""
    seq = reads.select("cluster_id", "read_id", "design_length", F.col(order).alias("_at"), canonical("read_sequence").alias("seq"))
    by = Window.partitionBy("cluster_id").orderBy("_at", "read_id")
    new = F.row_number().over(Window.partitionBy("cluster_id", "seq").orderBy("_at", "read_id")) == 1
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seq.withColumn("new", new.cast("long")).select(
        "cluster_id",
        "read_id",
        F.row_number().over(by).alias("arrival"),
        F.sum("new").over(so_far).alias("distinct_reads"),
        F.sum((F.length("seq") == F.col("design_length")).cast("long")).over(so_far).alias("exact_reads"),
    )
