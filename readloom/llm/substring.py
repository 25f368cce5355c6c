"""Exact substring de-duplication by seed and extend (operator 5).

Seeds: of the ``SEED``-word grams within any window of ``window`` words, the one with the smallest hash is an anchor
(winnowing), so equal windows hold the same anchor at the same place.  Occurrences of an anchor meet by its hash.
Extend: each occurrence carries a hash of the words up to ``window - SEED`` on both sides.  An occurrence whose extended
context also starts in a smaller document repeats as far as that context reaches.  The smallest document of each
different context of an anchor is where a match may end inside the context; only there are the windows themselves
compared, by (anchor, window) hash, 128 bits in all.  Overlapping repeats merge to maximal ones, whose words go.

Hot anchors, with a share of over one in ``SHARE`` times the shuffle's partitions, are found in the anchors of one document
in ``SAMPLE``; that list, of ``SHARE`` entries a partition at most, decides where rows go and never what comes out.  Rows
of hot anchors are spread by a salt.  In each salted group all but the rows of its first document are settled; those, at
most one document for each salt, meet in a second, small step.

A word is removed if a window covering it also starts in a document with a smaller doc_id; windows are judged on the
input.  Nothing is paired: an anchor of m occurrences costs m rows, however many documents share it, and rows carry
hashes and positions instead of text.  Null, empty and short texts (under ``window`` words) keep all words.  Rows that
repeat a doc_id count as one document: repeats within one document are not removed; where their texts differ, each row
loses what its own text repeats of smaller documents (a key of the text tells them apart, which is 0 for all rows as long
as every doc_id has one text).  A null doc_id is neither smaller nor larger than another: such rows keep all words, and
others don't lose any to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow
from readloom.llm.textnp import _MULT, SPACED, U, Words, blocks, mix

#: Words of a seed.
SEED = 5
SHARE, SAMPLE, LEAST = 8, 64, 16


class _Anchors:
    """Anchors of a block: ``at`` (word), ``hash``; ``of``: for each window (in order of ``win``) its anchor's word."""

    def __init__(self, w: Words, window: int):
        reach = window - SEED
        self.win, _ = w.grams(window)
        g_at, g = w.grams(SEED)
        gram = np.zeros(max(len(w.hash), 1), U)
        gram[g_at] = g
        if len(self.win):
            best, of = gram[self.win].copy(), self.win.copy()
            for j in range(1, reach + 1):
                g = gram[self.win + j]
                less = g < best  # the leftmost of equal hashes stays: decided by the window's own words
                best[less], of[less] = g[less], self.win[less] + j
            self.of, self.at = of, np.unique(of)
        else:
            self.of = self.at = np.empty(0, np.int64)
        self.hash = gram[self.at] if len(self.at) else np.empty(0, U)


def _contexts(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words within ``window - SEED`` on both sides of each anchor, cut at the text's ends."""
    reach = window - SEED
    lo, hi = w.first[w.doc[at]], w.first[w.doc[at] + 1]
    h = np.zeros(len(at), U)
    for j in range(-reach, window):
        p = at + j
        inside = (p >= lo) & (p < hi)
        h += np.where(inside, w.hash[np.clip(p, 0, len(w.hash) - 1)], U(0)) * _MULT[j + reach]
    return mix(h + np.minimum(at - lo, reach).astype(U) * U(64) + np.minimum(hi - at, window).astype(U))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("doc_id")
    return pc.fill_null(column, 0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _salt(anchor: np.ndarray, row: np.ndarray, hot: np.ndarray, salts: int) -> pa.Array:
    """0, and 1 to ``salts`` for rows of hot anchors."""
    out = np.zeros(len(anchor), np.int32)
    if len(hot):
        i = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor)
        out[i] = (mix(row[i].astype(U) + U(77)) % U(salts)).astype(np.int32) + 1
    return pa.array(out)


def _seeds(window: int, hot: np.ndarray, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, valid), key = _ids(batch), batch.column("key")
            for block in blocks(batch.column("text")):
                w = block.words(SPACED)
                a = _Anchors(w, window)
                own = valid[block.lo + w.doc[a.at]]
                at, h = a.at[own], a.hash[own]
                doc = w.doc[at]
                pos = (at - w.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), _salt(h, ids[block.lo + doc] * 8191 + pos, hot, salts), pa.array(_contexts(w, at, window).view(np.int64)), pa.array(ids[block.lo + doc]), key.take(pa.array(block.lo + doc)), pa.array(pos)],
                    names=["anchor", "salt", "context", "doc_id", "key", "pos"],
                )

    return run


def _windows(window: int, hot: np.ndarray, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows whose anchor is at one of a text's positions ``open``."""
        for batch in batches:
            (ids, _), key, asked = _ids(batch), batch.column("key"), batch.column("open")
            for block in blocks(batch.column("text")):
                w = block.words(SPACED)
                a = _Anchors(w, window)
                flag = np.zeros(len(w.hash) + 1, bool)
                rows = asked.slice(block.lo, block.n)
                many = np.diff(rows.offsets.to_numpy())
                pos = rows.flatten().to_numpy() + np.repeat(w.first[:-1], many)
                flag[pos] = True
                take = flag[a.of]
                at, of = a.win[take], a.of[take]
                h = np.zeros(len(at), U)
                for j in range(window):
                    h += w.hash[at + j] * _MULT[j]
                doc = w.doc[at]
                anchor = a.hash[np.searchsorted(a.at, of)]
                pos = (at - w.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), _salt(anchor, ids[block.lo + doc] * 8191 + pos, hot, salts), pa.array(mix(h).view(np.int64)), pa.array(ids[block.lo + doc]), key.take(pa.array(block.lo + doc)), pa.array(pos)],
                    names=["anchor", "salt", "win", "doc_id", "key", "pos"],
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge the repeats of each text and drop their words."""
        for batch in batches:
            n_words, n_removed, sha, kept_text = [], [], [], []
            ranges = batch.column("ranges")
            for i, text in enumerate(batch.column("text")):
                words = text.as_py().encode().split() if text.is_valid else []
                n = len(words)
                gone = 0
                if ranges[i].is_valid and len(ranges[i]):
                    starts, ends = (ranges[i].values.field(c).to_numpy() for c in range(2))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.maximum(starts, 0), 1)
                    np.add.at(edge, np.minimum(ends, n), -1)
                    keep = np.cumsum(edge[:n]) == 0
                    gone = n - int(keep.sum())
                    words = [x for x, k in zip(words, keep.tolist()) if k]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, text)`` of rows with a doc_id.  The key tells different texts of one doc_id apart, if there are any in the table."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    several = text.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a < b")
    # a zero that the optimizer doesn't know: a literal would drop out of the joins' keys, and they would shuffle the texts anew
    none = F.col("doc_id") - F.col("doc_id")
    return text.select("doc_id", (none if several.isEmpty() else key).alias("key"), "text")


def repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``(doc_id, key, lo, hi)``: word ranges of documents that repeat text of a document with a smaller doc_id.  Ranges may overlap."""
    return _ranges(_keyed(docs), window)


def _ranges(text: DataFrame, window: int) -> DataFrame:
    if not SEED <= window <= 32:
        raise ValueError("window must be 5 to 32 words")
    reach = window - SEED
    hot, salts = _hot(text, window)
    seeds = map_arrow(text, _seeds(window, hot, salts), "anchor long, salt int, context long, doc_id long, key long, pos int")
    by_anchor = Window.partitionBy("anchor", "salt")
    met = (
        seeds.repartition("anchor", "salt")
        .withColumn("first_doc", F.first("doc_id").over(_first("anchor", "salt", "context")))
        # a hot anchor is taken to have several contexts: that may ask for windows in vain, and costs no look at all its rows
        .withColumn("several", (F.col("salt") > 0) | (F.min("context").over(by_anchor) < F.max("context").over(by_anchor)))
        .where("first_doc < doc_id or several")
    )
    again = _again(met, hot, "context")
    around = lambda df: df.where("first_doc < doc_id").select("doc_id", "key", (F.col("pos") - reach).alias("lo"), (F.col("pos") + window).alias("hi"))
    # Only where an anchor has several contexts can a match end inside one; the first document of each gets its windows compared.
    first = met.where("if(first_doc = doc_id, salt, -1) = 0").select("doc_id", "key", "pos").unionByName(again.where("first_doc = doc_id").select("doc_id", "key", "pos")) if len(hot) else met.where("first_doc = doc_id")
    opened = first.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("open"))
    # a left join, as in drop_repeats: with the same rows on the left, both read one shuffle of the texts
    found = map_arrow(text.repartition("doc_id", "key").join(opened, ["doc_id", "key"], "left"), _windows(window, hot, salts), "anchor long, salt int, win long, doc_id long, key long, pos int")
    ended = found.withColumn("first_doc", F.first("doc_id").over(_first("anchor", "salt", "win")))
    inside = lambda df: df.where("first_doc < doc_id").select("doc_id", "key", F.col("pos").alias("lo"), (F.col("pos") + window).alias("hi"))
    out = around(met).unionByName(inside(ended))
    return out.unionByName(around(again)).unionByName(inside(_again(ended, hot, "win"))) if len(hot) else out


def _first(*keys: str):
    return Window.partitionBy(*keys).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _again(met: DataFrame, hot: np.ndarray, key: str) -> DataFrame | None:
    """The first rows of salted groups, compared over all salts.

    Filters on the salt, here and for the salt 0, hang on ``first_doc``: a plain one would be pushed below the window and the
    exchange, which each reader would then write anew instead of sharing one.
    """
    if not len(hot):
        return None
    return met.where("if(first_doc = doc_id, salt, -1) > 0").drop("first_doc").withColumn("first_doc", F.first("doc_id").over(_first("anchor", key)))


def _hot(text: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """Hot anchors, sorted, and how many salts they get."""
    parts = max(2, int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = text.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE)) == 0).select("doc_id", F.lit(0).cast("long").alias("key"), "text")
    counted = map_arrow(some, _seeds(window, np.empty(0, U), 1), "anchor long, salt int, context long, doc_id long, key long, pos int").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    most = counted.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "anchor").limit(SHARE * parts).collect()
    if not most:
        return np.empty(0, U), parts
    total = counted.agg(F.sum("n")).first()[0]
    return np.sort(np.array([r["anchor"] for r in most if r["n"] * SHARE * parts > total], np.int64).view(U)), parts


def drop_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, n_removed, kept_sha256, kept_text)`` for every input row."""
    text = _keyed(docs)
    # a set: equal rows of one doc_id give the same ranges
    ranges = _ranges(text, window).groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    placed = text.repartition("doc_id", "key").join(ranges, ["doc_id", "key"], "left").select("doc_id", "text", "ranges")
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast(placed.schema["ranges"].dataType).alias("ranges"))
    # the ends of a text bound a context's range: words before its start or after its end don't exist
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return map_arrow(placed, _cut(window), ddl).unionByName(map_arrow(unnamed, _cut(window), ddl))
