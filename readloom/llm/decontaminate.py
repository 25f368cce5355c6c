"""Benchmark decontamination with a distributed positional inverted index (operator 7).

``index`` stores, once for any number of test sets, the postings of every term of every document: one row for each segment
of consecutive documents, with a dictionary of its terms (sorted hashes) and for each term the sorted positions, counted
over the segment's words and kept as differences.  Segments are built where the documents are: nothing is shuffled.

``search`` takes the phrases of a test set to the segments.  Phrases with a term that the segment lacks drop out at once.
Of the others the rarest term's list, shifted by the term's place in the phrase, is intersected with the other shifted
lists, shortest next; all phrases of a segment take a step together.  ``slop`` > 0 looks for proximity instead.

The test set goes out in parts of at most ``PART_BYTES`` of text (an item larger than that is a part by itself), held as
arrays of some 40 bytes a word; the driver holds one part at a time.  Every part is searched in the stored index, and the
parts' hits meet by a document's place in the index, so what comes out doesn't depend on the number of parts.

Null or empty texts have no words.  Every row of documents gives a row, also rows that repeat a doc_id or have none.  A
null item_id is the empty text; rows that repeat an item_id are one item.  An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow, staged
from readloom.llm.textnp import _MULT, ALNUM, U, blocks, mix

#: Bytes of query text in one part.
PART_BYTES = 4 << 20
#: Bytes of document text in one index segment, and of a row group of the stored index.
SEGMENT_BYTES, GROUP_BYTES = 4 << 20, 16 << 20
#: Segments of a row group: Parquet looks at a group's bytes only from its hundredth row on, and readers take a group at once.
GROUP_ROWS = 4
#: Candidate positions of a segment that are intersected at a time.
CANDIDATES = 1 << 20

INDEX = "segment long, docs array<long>, words array<int>, terms array<long>, counts array<int>, postings array<int>"
FOUND = "segment long, row int, doc_id long, n_words long, hits array<int>, items array<string>"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    ids, counts, hashes, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32

    def segment() -> pa.RecordBatch:
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable").astype(np.int32)
        h = h[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        step = np.diff(order, prepend=np.int32(0))
        step[head] = order[head]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(ids, pa.int64()), one(np.concatenate(counts), pa.int32()), one(h[head].view(np.int64), pa.int64()), one(np.diff(np.append(head, len(h))), pa.int32()), one(step, pa.int32())],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )

    for batch in batches:
        column = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            w = block.words(ALNUM, lower=True)
            hashes.append(w.hash)
            ids += column.slice(block.lo, block.n).to_pylist()
            counts.append(w.count)
            size += len(block.data)
            if size >= SEGMENT_BYTES:
                yield segment()
                ids, counts, hashes, size, number = [], [], [], 0, number + 1
    if ids:
        yield segment()


def index(docs: DataFrame) -> DataFrame:
    """The stored index of all terms of ``docs(doc_id, text, ...)``, for any number of searches."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(map_arrow(text, _index, INDEX), "postings", **{"parquet.block.size": str(GROUP_BYTES), "parquet.block.row.count.limit": str(GROUP_ROWS)})


class Query:
    """Distinct phrases of a part of the query set.

    ``vocab``: sorted term hashes; ``words``: all items' words as places in it; a phrase is ``length`` of them from ``start``;
    its items are ``item[bound[i]:bound[i + 1]]``, places in ``names``.
    """

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        name, h, start, length, owner = np.array([x for x, _ in items], dtype=object), [], [], [], []
        at = 0
        for block in blocks(pa.array([t for _, t in items], pa.string())):
            w = block.words(ALNUM, lower=True)
            full, _ = w.grams(size)
            few = np.flatnonzero((w.count > 0) & (w.count < size))
            start.append(np.concatenate([full, w.first[few]]) + at)
            length.append(np.concatenate([np.full(len(full), size), w.count[few]]))
            owner.append(np.concatenate([w.doc[full], few]) + block.lo)
            h.append(w.hash)
            at += len(w.hash)
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
        h, start, length, owner = join(h, U), join(start, np.int64), join(length, np.int64), join(owner, np.int64)
        self.vocab, words = np.unique(h, return_inverse=True)
        self.words = words.astype(np.int32)
        key = np.zeros(len(start), U)
        for j in range(int(length.max(initial=0))):
            inside = j < length
            key[inside] = mix(key[inside] * _MULT[1] + h[start[inside] + j])
        _, first, same = np.unique(mix(key + length.astype(U)), return_index=True, return_inverse=True)
        self.start, self.length = start[first], length[first]
        names, number = np.unique(name[owner].astype(str), return_inverse=True)
        pairs = np.unique(same.ravel() * max(1, len(names)) + number)
        self.names, self.item = names.tolist(), (pairs % max(1, len(names))).astype(np.int32)
        self.bound = np.searchsorted(pairs // max(1, len(names)), np.arange(len(first) + 1))


class Segment:
    """One row of the index, with its postings as positions, and where the query's terms have theirs."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocab: np.ndarray):
        get = lambda name: batch.column(name)[row].values
        self.number, self.docs = batch.column("segment")[row].as_py(), get("docs")
        words, terms, count, step = (get(c).to_numpy(zero_copy_only=False) for c in ("words", "terms", "counts", "postings"))
        self.words = words.astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.words)])
        offs = np.concatenate([[0], np.cumsum(count)])
        run = np.cumsum(step, dtype=np.int64)
        before = np.concatenate([[0], run])[offs[:-1]]
        self.post = run - np.repeat(before, count)
        self.key = (np.repeat(np.arange(len(terms)), count) << 32) | self.post  # ascending: intersections look up term and position
        terms = terms.view(U)
        self.rank = np.minimum(np.searchsorted(terms, vocab), max(0, len(terms) - 1))
        has = terms[self.rank] == vocab if len(terms) else np.zeros(len(vocab), bool)
        self.lo = np.where(has, offs[self.rank], 0) if len(terms) else np.zeros(len(vocab), np.int64)
        self.many = np.where(has, count.astype(np.int64)[self.rank], 0) if len(terms) else np.zeros(len(vocab), np.int64)

    def possible(self, q: Query) -> np.ndarray:
        """Phrases whose terms the segment has, all of them."""
        lacks = np.concatenate([[0], np.cumsum(self.many[q.words] == 0)])
        return np.flatnonzero(lacks[q.start + q.length] == lacks[q.start])


def exact(s: Segment, q: Query, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, start)`` of all occurrences of the phrases in the segment, across documents too."""
    if not len(phrases):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = int(q.length[phrases].max())
    place = np.minimum(np.arange(width)[None, :], q.length[phrases][:, None] - 1)
    term = q.words[q.start[phrases][:, None] + place]
    many = np.where(np.arange(width)[None, :] < q.length[phrases][:, None], s.many[term], 1 << 60)
    order = np.argsort(many, axis=1, kind="stable")  # rarest first
    rows = np.arange(len(phrases))
    load = np.cumsum(many[rows, order[:, 0]])
    found = []
    lo = 0
    while lo < len(phrases):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + CANDIDATES, "right")))
        n = many[rows[lo:hi], order[lo:hi, 0]]
        of = np.repeat(rows[lo:hi], n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.lo[term[rows[lo:hi], order[lo:hi, 0]]], n)
        start = s.post[at] - order[of, 0]
        for step in range(1, width):
            j = order[of, step]
            more = j < q.length[phrases[of]]
            want = (s.rank[term[of, j]].astype(np.int64) << 32) | np.maximum(start + j, 0)
            i = np.minimum(np.searchsorted(s.key, want), len(s.key) - 1)
            ok = ~more | ((s.key[i] == want) & (start >= 0))
            of, start = of[ok], start[ok]
            if not len(of):
                break
        found.append((phrases[of], start))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found))


def near(lists: list[np.ndarray], need: list[int], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of all minimal spans of at most ``reach`` words that hold ``need[j]`` positions of each lists[j].

    For each position as the end, the latest start is the least of the terms' need-th last positions up to it; of spans with
    one start, the shortest is minimal.  A span that leaves its document has no other with this end inside the document.
    """
    rare = min(lists, key=len)

    def close(x: np.ndarray) -> np.ndarray:  # every span holds a rarest term
        i = np.searchsorted(rare, x)
        left, right = x - rare[np.maximum(i - 1, 0)], rare[np.minimum(i, len(rare) - 1)] - x
        return x[(np.abs(left) < reach) | (np.abs(right) < reach)]

    lists = [close(x) for x in lists]
    end = np.unique(np.concatenate(lists)).astype(np.int64)
    start = end.copy()
    for x, n in zip(lists, need):
        i = np.searchsorted(x, end, "right") - n
        ok = i >= 0
        end, start = end[ok], np.minimum(start[ok], x[i[ok]])
    ok = (end - start < reach) & (np.diff(start, prepend=-1) > 0)
    return start[ok], end[ok]


def _proximity(s: Segment, q: Query, phrases: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [(np.empty(0, np.int64),) * 3]
    for k in phrases.tolist():
        term, need = np.unique(q.words[q.start[k] : q.start[k] + q.length[k]], return_counts=True)
        a, b = near([s.post[s.lo[t] : s.lo[t] + s.many[t]] for t in term.tolist()], need.tolist(), int(q.length[k]) + slop)
        found.append((np.full(len(a), k), a, b))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(query, slop: int, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch, row, q.vocab)
                phrases = s.possible(q)
                if slop:
                    k, a, b = _proximity(s, q, phrases, slop)
                else:
                    k, a = exact(s, q, phrases)
                    b = a + q.length[k] - 1
                d = np.searchsorted(s.ends, a, "right") - 1
                ok = b < s.ends[d + 1]
                k, a, b, d = k[ok], a[ok], b[ok], d[ok]
                edge = np.zeros(s.ends[-1] + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, b + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                of = np.searchsorted(s.ends, at, "right") - 1
                # items of each document, once each
                n = q.bound[k + 1] - q.bound[k]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.bound[k], n)
                pairs = np.unique(np.repeat(d, n) * max(1, len(q.names)) + q.item[place])
                doc = np.unique(d) if only_hits else np.arange(len(s.docs))
                cut = lambda x: pa.array(np.append(np.searchsorted(x, doc), np.searchsorted(x, doc[-1], "right") if len(doc) else 0).astype(np.int32))  # noqa: B023, E731
                item = pairs % max(1, len(q.names))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), s.number)),
                        pa.array(doc.astype(np.int32)),
                        s.docs.take(pa.array(doc)),
                        pa.array(s.words[doc]),
                        pa.ListArray.from_arrays(cut(of), pa.array((at - s.ends[of]).astype(np.int32))),
                        pa.ListArray.from_arrays(cut(pairs // max(1, len(q.names))), pa.array([q.names[i] for i in item.tolist()], pa.string())),
                    ],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return run


def _parts(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    part, size = [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        part.append((r[0], r[1]))
        size += len((r[1] or "").encode())
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    yield part


def search(stored: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """``(doc_id, n_words, hits array<int>, items array<string>)``: words of each document inside an item's phrase, and those items.

    A phrase is ``size`` consecutive words of an item, or the whole of a shorter one.  ``slop`` > 0: proximity, all words of
    the phrase, as often as it has them, in any order within as many words as it has and ``slop`` more; hits are the words of
    the minimal such spans.
    """
    out = []
    for part in _parts(items):
        query = stored.sparkSession.sparkContext.broadcast(Query(part, size))
        out.append(map_arrow(stored, _search(query, slop, bool(out)), FOUND))
    if len(out) == 1:
        return out[0].drop("segment", "row")
    both = out[0]
    for x in out[1:]:  # these have rows for documents with hits only
        both = both.unionByName(x)
    merged = both.groupBy("segment", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return merged.select("doc_id", "n_words", F.array_distinct("hits").alias("hits"), F.array_distinct("items").alias("items"))


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """``search`` in a new index of ``docs``."""
    return search(index(docs), items, size, slop)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row for each document: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``."""
    m = matches(docs, items, size)
    return m.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
