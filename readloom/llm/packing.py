"""Sequence packing: shortest-pack-first over the length histogram (operator 10).

Documents become token ids, are cut into full sequences and one rest each, and the histogram of the rests' lengths (at
most ``size`` rows, whatever the corpus) is packed on the driver: lengths longest first, each into the shortest packs, those
of the open pattern with the most room, whose counts are updated; where not even they have room, into new packs.
Patterns then go back to the pieces by rank: the r-th piece of a length takes the r-th place that the patterns have for
that length.

Ranks within a length come in two levels, so a length that a third of all documents have is no single task's work:
pieces are ranked within (length, slice), slices being a hash of the piece, and the slices' counts give the bases.  A
length of n pieces has some sqrt(n) slices, so neither a slice nor the list of slices is long.

A null or empty text is the end token alone.  Rows that repeat a doc_id are packed once for each row.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import map_arrow, staged

END_ID, SIZE = 1, 2048
#: Words whose ids a worker remembers (two generations of this many).
REMEMBERED = 500_000
#: Marks behind a word that the pre-tokenizer takes as one unit.
MARKS = ".,;:!?*#%&$|"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Known(dict):
    """Ids by word; notes what was asked for in vain."""

    def __init__(self):
        super().__init__({"": b""})
        self.missed: set[str] = set()

    def __missing__(self, word: str) -> None:
        self.missed.add(word)


class WordIds:
    """Ids of whole texts, by remembering those of words: the vocabulary's pre-tokenizer always parts at white space.

    New words are mostly letters with marks behind.  Such letters are one unit of the pre-tokenizer, whose last id ends a
    word, so many of them are encoded as one text whose ids are parted again at these ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.new, self.old = _Known(), {}

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters."""
        out: list[bytes] = []
        for lo in range(0, len(units), 4096):
            part = units[lo : lo + 4096]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("this vocabulary doesn't end words as expected")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _encode(self, words: set[str]) -> None:
        """Put the ids of words that aren't in ``new`` there."""
        new, old = self.new, self.old
        found = {x: old[x] for x in words if x in old}
        plain: list[tuple[str, str, str]] = []
        other: list[str] = []
        for x in words if not found else words - found.keys():
            body = x.rstrip(MARKS)
            # characters below U+0250 stay as they are in normal form, and but for one have one lower-case form
            if body.isalpha() and (body.isascii() or (max(body) < "\u0250" and "\u0130" not in body)):
                plain.append((x, body.lower(), x[len(body) :]))
            else:
                other.append(x)
        for x, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False) if other else ()):
            found[x] = np.array(e.ids, "<u4").tobytes()
        for k in (1, 2):
            ask = [y for y in {p[k] for p in plain} if y not in new]
            have = {y: old[y] for y in ask if y in old}
            ask = [y for y in ask if y not in have]
            if k == 1:
                have.update(zip(ask, self._units(ask)))
            else:
                have.update((y, np.array(self.tok.encode(y, add_special_tokens=False).ids, "<u4").tobytes()) for y in ask)
            new.update(have)
        for x, body, marks in plain:
            found[x] = new[body] + new[marks] if marks else new[body]
        new.update(found)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, _Known()
        known = self.new
        get = known.__getitem__
        rows = [self._plain(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        ids = [list(map(get, r)) for r in rows]
        if known.missed:
            missed, known.missed = known.missed, set()
            self._encode(missed)
            ids = [[get(w) if x is None else x for w, x in zip(r, out)] if None in out else out for r, out in zip(rows, ids)]
        return list(map(b"".join, ids))

    @staticmethod
    def _plain(text: str) -> str:
        """In lower case where that is certain, to remember fewer forms; special tokens have none."""
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if max(text) >= "\u0250" or "\u0130" in text:
                    return text
        return text.lower()


@lru_cache(maxsize=1)
def _worker_ids(path: str) -> WordIds:
    """A worker's tasks share what it has learned of a vocabulary.  (A nested function's globals would be copied for each task.)"""
    return WordIds(path)


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _worker_ids(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, ids in zip(part.column("doc_id").to_pylist(), ids_of(pc.fill_null(part.column("text"), "").to_pylist())):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    for lo in range(0, n, size):
                        cut = ids[4 * lo : 4 * (lo + size)]
                        for column, value in zip(rows, (doc, lo, len(cut) // 4, zlib.crc32(cut), n)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: each document's ids in cuts of at most ``size``."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(text, _pieces(tokenizer, size), PIECES)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """Shortest-pack-first: ``(count, {length: pieces of it in one pack})``, which use up the histogram.

    ``room`` has the open patterns by what is left in them; a length goes to the one with the most, for as many packs as
    both have.
    """
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    open_: list[int] = []

    def put(left: int, count: int, pack: dict[int, int]) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(open_, left)
        room[left].append((count, pack))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            if not open_ or open_[-1] < length:
                put(size - length, todo, {length: 1})
                break
            left = open_[-1]
            count, pack = room[left].pop()
            if not room[left]:
                del room[open_.pop()]
            used = min(count, todo)
            if count > used:
                put(left, count - used, pack)
            put(left - length, used, {**pack, length: pack.get(length, 0) + 1})
            todo -= used
    return [x for xs in room.values() for x in xs]


def _places(found: list[tuple[int, dict[int, int]]], first: int) -> list[tuple[int, ...]]:
    """``(length, lo, hi, each, offset, sequence)``: ranks lo to hi of a length go to sequences of one pattern, ``each`` in a row."""
    used: dict[int, int] = {}
    out = []
    for count, pack in found:
        offset = 0
        for length, each in pack.items():
            lo = used.get(length, 0)
            out.append((length, lo, lo + count * each, each, offset, first))
            used[length] = lo + count * each
            offset += length * each
        first += count
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for every piece of every document."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, size), "pieces")
    total = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    sizes = spark.createDataFrame([(x, math.isqrt(n) + 1) for x, n in sorted(total.items())], "length long, slices long")
    cut = cut.join(F.broadcast(sizes), "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("slices"))).drop("slices")
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    full = total.pop(size, 0)
    places = [(size, 0, full, 1, 0, 0), *_places(patterns(total, size), full)]
    place = spark.createDataFrame(places, T.StructType.fromDDL("length long, lo long, hi long, each long, offset0 long, first long"))
    by = Window.partitionBy("length", "slice").orderBy("doc_id", "start")
    ranked = cut.withColumn("rank", F.row_number().over(by)).join(base, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("rank") - 1)
    put = ranked.join(F.broadcast(place), "length").where("rank >= lo and rank < hi")
    within = F.col("rank") - F.col("lo")
    return put.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("offset0") + (within % F.col("each")) * F.col("length")).alias("offset"),
    )
