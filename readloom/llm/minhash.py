"""MinHash near-duplicates (operator 2).

Whole texts become sets of word shingles.  Equal sets are one class first, so exact copies never meet in a bucket.  Each
class has ``bands * rows`` universal hash minima; bands of ``rows`` minima are bucket keys.  Every member of a bucket is
compared with the bucket's smallest class (a star: as many pairs as members), links are confirmed on the full sets, and
components come from alternating large-star and small-star.  Buckets whose members still lie in several components are
then finished exactly: members outside the bucket's largest component meet the others block by block, first with their
bucket keys alone.  Two of them are compared in the first band they share, if they share ``SHARED``; only members with
somebody to be compared with bring their texts to a block.  No pairs are written, and no bucket has a cap.

At similarity s two sets share none of the bands with probability (1 - s^rows)^bands: 6e-11 at 0.85, 5e-8 at 0.8; fewer
than ``SHARED``: 2e-9 and 1e-6.

Null or empty texts, or texts without words, have no shingles and are linked with nothing; nor are rows with a null
doc_id, whose component_id is null and which stay.  Rows that repeat a doc_id are all returned.  Each class is a node of
its own, and classes that share a doc_id are joined: such a document has the links of all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow, staged
from readloom.llm.components import components
from readloom.llm.textnp import SPACED, U, Words, blocks, mix, segments

ROWS, BANDS = 4, 32
#: Bands that two sets of the exact finish have to share before they are compared.
SHARED = 2
#: Members of a bucket in one block of the exact finish.
BLOCK = 512


def shingles(w: Words, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of n texts, sorted within each text, and their bounds.  Fewer than k words: the whole sequence."""
    at, h = w.grams(k)
    doc = w.doc[at]
    for short in range(1, k):
        few = np.flatnonzero(w.count == short)
        if len(few):
            s = np.zeros(len(few), U)
            for j in range(short):
                s = mix(s * U(31) + w.hash[w.first[few] + j])
            doc, h = np.concatenate([doc, few]), np.concatenate([h, mix(s + U(short))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return h, segments(doc, n)


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(4242))
    return rng.integers(0, 1 << 63, (count, 1), dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, (count, 1), dtype=U)


def _signatures(k: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(rows * bands)
        step = 4096
        for batch in batches:
            for block in blocks(batch.column("text")):
                h, at = shingles(block.words(SPACED, lower=True), k, block.n)
                size = np.diff(at)
                low = np.full((block.n, rows * bands), ~U(0))
                for d in np.flatnonzero(size):
                    for lo in range(at[d], at[d + 1], step):
                        np.minimum(low[d], (h[lo : min(lo + step, at[d + 1])] * a + b).min(axis=1), out=low[d])
                key = np.zeros((block.n, bands), U)
                for r in range(rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + low[:, r::rows])
                key = mix(key + np.arange(bands, dtype=U))
                one, two = (np.zeros(block.n, U) for _ in range(2))
                if len(h):
                    full = np.flatnonzero(size)
                    one[full] = np.add.reduceat(mix(h ^ U(0x5555)), at[full])
                    two[full] = np.add.reduceat(mix(h + U(0x9999)), at[full])
                ids, texts = (batch.column(c).slice(block.lo, block.n) for c in ("doc_id", "text_key"))
                flat = pa.array(key.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids, texts, pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * bands), flat)],
                    names=["doc_id", "text_key", "n_shingles", "one", "two", "bands"],
                )

    return run


def _set(text: str | None, k: int) -> np.ndarray:
    for block in blocks(pa.array([text], pa.string())):
        return shingles(block.words(SPACED, lower=True), k, 1)[0]
    return np.empty(0, U)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| for two arrays of distinct values."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            ok, last, held = [], None, None
            for i, (u, v) in enumerate(zip(us, vs)):
                if v != last:
                    last, held = v, _set(batch.column("tv")[i].as_py(), k)
                if linked(_set(batch.column("tu")[i].as_py(), k), held, percent):
                    ok.append((u, v))
            yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in ok], pa.int64()), "v": pa.array([x[1] for x in ok], pa.int64())})

    return run


def _block(rows: pa.Table):
    """One block of a bucket's members (side 0) with one block of its members outside the largest component (side 1).

    Yields each member of side 1 with the members of side 0 to compare it with.
    """
    band = rows.column("band")[0].as_py()
    comp, side = (rows.column(c).to_numpy() for c in ("comp", "side"))
    keys = np.array(rows.column("bands").combine_chunks().flatten()).reshape(len(comp), -1)
    base = np.flatnonzero(side == 0)
    for q in np.flatnonzero(side == 1):
        same = keys[base] == keys[q]
        yield q, base[(comp[base] != comp[q]) & (same.sum(axis=1) >= SHARED) & (same.argmax(axis=1) == band)]


def _asked(rows: pa.Table) -> pa.Table:
    """The members of a block that are compared with somebody."""
    take = np.zeros(rows.num_rows, bool)
    for q, others in _block(rows):
        if len(others):
            take[q] = take[others] = True
    return rows.filter(pa.array(take))


def _finish(k: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("rep", "ascending")])
        ids, comp = rows.column("rep").to_numpy(), rows.column("comp").to_numpy()
        texts, sets, out = rows.column("text"), {}, []
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        def held(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _set(texts[int(i)].as_py(), k)
            return sets[i]

        for q, others in _block(rows):
            for i in others:
                if root(comp[q]) != root(comp[i]) and linked(held(i), held(q), percent):
                    top[root(comp[q])] = root(comp[i])
                    out.append((ids[q], ids[i]))
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row for each input row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    made = map_arrow(text, _signatures(k, rows, bands), "doc_id long, text_key long, n_shingles long, one long, two long, bands array<long>")
    # texts without shingles, and rows without an id, are classes of their own
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    alone = F.when(some, F.col("two")).otherwise(F.col("doc_id"))
    # rows get their numbers as they are written, so that these stay what they are
    sig = staged(made.withColumns({"two": alone, "row": F.monotonically_increasing_id()}), "minhash")
    same = ["n_shingles", "one", "two"]
    # Heads of classes and buckets are tables of their own before they are joined back: a join straight on an aggregate
    # keeps its partitioning, and adaptive execution splits no hot group there.
    classes = staged(sig.groupBy(*same).agg(F.min("row").alias("head"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "heads")
    placed = sig.drop("bands").join(classes, same, "left")
    member = staged(placed.select("doc_id", "text_key", "n_shingles", "row", F.coalesce("head", "row").alias("rep"), F.coalesce("least", "doc_id").alias("least")), "classes")
    heads = member.where("row = rep and n_shingles > 0 and doc_id is not null")
    reps = sig.join(heads.select("row"), "row", "left_semi").select(F.col("row").alias("rep"), "bands")
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = staged(keyed.groupBy("band", "key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1"), "centers")
    full = staged(keyed.join(buckets, ["band", "key"]), "buckets")
    pairs = full.where("rep <> center").select(F.col("rep").alias("u"), F.col("center").alias("v")).distinct()
    need = heads.join(full.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_key")
    # a head's text is that of its own row; equal rows have the same one
    texts = staged(text.join(need, ["doc_id", "text_key"]).groupBy("rep").agg(F.first("text").alias("text")), "texts")
    with_u = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("tu")), "u")
    both = with_u.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("tv")), "v")
    # classes that share a doc_id: none as long as ids don't repeat with different texts
    shared = member.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").drop("last")
    joined = member.join(staged(shared, "shared"), "doc_id").where("n_shingles > 0 and rep <> v").select(F.col("rep").alias("u"), "v")
    confirmed = map_arrow(both.select("u", "v", "tu", "tv"), _confirm(k, percent), "u long, v long")
    links = staged(confirmed.unionByName(joined.distinct()), "links")
    comp = staged(components(links), "components")

    # Buckets of three or more whose members are still apart.
    placed = full.where("members > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    parts = placed.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = staged(parts.groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most")).where("parts > 1"), "parts")
    apart = placed.join(largest, ["band", "key"]).select("band", "key", "rep", "comp", "largest", F.ceil(F.col("all") / BLOCK).cast("int").alias("b0"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("b1"))
    base = apart.select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("rep"), "b0").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("b1") - 1)).alias("y"))
    ask = apart.where("comp <> largest").select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("b0") - 1)).alias("x"), F.pmod(F.xxhash64("rep", F.lit(1)), "b1").cast("int").alias("y"))
    columns, block = ["band", "key", "x", "y", "side", "rep", "comp", "bands"], ["band", "key", "x", "y"]
    blocks_ = base.unionByName(ask).join(reps, "rep").select(*columns)
    asked = staged(blocks_.groupBy(*block).applyInArrow(_asked, "band int, key long, x int, y int, side int, rep long, comp long, bands array<long>"), "asked")
    more = staged(asked.join(texts, "rep").select(*columns, "text").groupBy(*block).applyInArrow(_finish(k, percent), "u long, v long"), "more")
    if not more.isEmpty():
        comp = staged(components(links.unionByName(more)), "components")
    # of each component the smallest doc_id
    inside = comp.join(heads.select(F.col("rep").alias("node"), F.col("least").alias("own")), "node")
    smallest = staged(inside.groupBy("component").agg(F.min("own").alias("component_id")), "smallest")
    named = staged(comp.join(smallest, "component").select(F.col("node").alias("rep"), "component_id"), "named")
    found = member.join(named, "rep", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "least", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
