"""What is known after each arrival of a read: length statistics, and the sequence that the reads so far decode to.

Decoding keeps a cluster's counters as running sums: an arrival adds its own grams, and a block of prefixes, of one cluster
or of several, is decoded together.  Prefixes of a cluster share one graph; only those without a path of the design length
are decoded as clusters of their own.  A cluster's arrivals are dealt in chunks of ``CHUNK`` to different tasks; a chunk
starts from the summed counters of all earlier ones, so a hot cluster is neither gathered nor walked in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.columns import canonical
from readloom.operators.decode import DECODING, Beams, Evidence, _length_model, _ln, choose, shaped
from readloom.operators.evidence import KINDS, counters
from readloom.schema import Config

#: Arrivals of a task's chunk, prefixes decoded together, and cells of a chunk's table there.
CHUNK, BLOCK, CELLS = 2048, 1024, 1 << 21
EARLIER = "struct<grams: array<struct<kind: int, code: bigint, support: bigint>>, lengths: array<struct<len: int, n: bigint, most: bigint, seq: string, counts: array<struct<seq: string, n: bigint>>>>>"
PREFIXES = "cluster_id string, arrival int, sequence string, family int"


def _arrivals(order: str):
    return Window.partitionBy("cluster_id").orderBy(order, "read_id")


def prefix_lengths(reads: DataFrame, order: str) -> DataFrame:
    """Exact median of the lengths so far, and their sums of logarithms, at each arrival."""
    so_far = _arrivals(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.octet_length("read_sequence")
    ln = F.log(F.greatest(F.lit(1), F.col("len")).cast("double"))
    return reads.withColumn("len", size).select(
        "cluster_id",
        "read_id",
        F.row_number().over(_arrivals(order)).alias("arrival"),
        F.percentile("len", F.lit(0.5)).over(so_far).alias("median_length"),
        F.sum(ln).over(so_far).alias("log_sum"),
        F.sum(ln * ln).over(so_far).alias("log_sq_sum"),
    )


class _Chunk:
    """A chunk of a cluster's arrivals, with counters and lengths of the reads before it; both move on with each block."""

    def __init__(self, design: int, seqs: list[str], grams: list[dict], lengths: list[dict]):
        self.design, self.seqs, self.at = design, seqs, 0
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for name in DECODING:
            own = sorted((x["code"], x["support"]) for x in grams if x["kind"] == KINDS[name])
            self.known[name] = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)
        self.hist = {x["len"]: x["n"] for x in lengths}
        self.best: dict[bool, tuple[int, str]] = {}
        for x in lengths:
            for exact in {False, x["len"] == design}:
                self.best[exact] = min(self.best.get(exact, (0, "")), (-x["most"], x["seq"]))
        self.count = {r["seq"]: r["n"] for x in lengths for r in x["counts"]}

    def block(self, room: int) -> list[str]:
        """The next arrivals, at most ``room``, and as few as keep the block's tables within ``CELLS``."""
        while room > 1 and room * (len(self.known["edge"][0]) + sum(map(len, self.seqs[self.at : self.at + room]))) > CELLS:
            room //= 2
        out = self.seqs[self.at : self.at + room]
        self.at += len(out)
        return out

    def told(self, s: str) -> tuple[tuple[tuple[int, int], ...], str | None, str | None]:
        """A read comes: the lengths so far, and the most frequent read of the design length and of any."""
        self.hist[len(s)] = self.hist.get(len(s), 0) + 1
        n = self.count[s] = self.count.get(s, 0) + 1
        for exact in (False, True) if len(s) == self.design else (False,):
            self.best[exact] = min(self.best.get(exact, (0, "")), (-n, s))
        return tuple(sorted(self.hist.items())), *(self.best[x][1] if x in self.best else None for x in (True, False))

    def sums(self, name: str, key: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes ``arrival << 32 | code`` with counts, each once; gives codes, and their sums so far at each of ``rows`` arrivals."""
        held, before = self.known[name]
        code = np.union1d(held, key & 0xFFFFFFFF)
        table = np.zeros((rows, len(code)), np.int64)
        table[key >> 32, np.searchsorted(code, key & 0xFFFFFFFF)] = n
        table[0, np.searchsorted(code, held)] += before
        np.cumsum(table, axis=0, out=table)
        self.known[name] = code, table[-1].copy()
        return code, table


@lru_cache(1 << 16)
def _prior(lengths: tuple[tuple[int, int], ...], design: int, cfg: Config) -> float:
    return _length_model(dict(lengths), cfg)[1](design)


@lru_cache(4)
def _small_gains(size: int) -> np.ndarray:
    """Gains of a step by its support and that of its context, both under ``size``; none without support."""
    out = np.full((size, size), -np.inf)
    for s in range(1, size):
        seen = 0.15 * math.log(1.0 + s)
        out[s, s:] = [math.log((s + 1.0) / (o + 4.0)) + seen for o in range(s, size)]
    return out


def _gains(support: np.ndarray, out: np.ndarray) -> np.ndarray:
    size = 1 << int(out.max(initial=1)).bit_length()
    if size <= 1024:
        return _small_gains(max(128, size))[support, out]
    gain = _ln((support + 1.0) / (out + 4.0)) + 0.15 * _ln(1.0 + support)
    gain[support == 0] = -np.inf
    return gain


def _whole(score: np.ndarray) -> np.ndarray:
    """As ``buckets``, still as doubles; minus infinity stays."""
    x = score * 1e12
    out = np.rint(x)
    with np.errstate(invalid="ignore"):
        half = np.abs(x - out) == 0.5
    if half.any():
        out[half] = np.copysign(np.floor(np.abs(x[half])) + 1, x[half])
    return out


class _Block:
    """Prefixes of one design length, decoded together.

    The prefixes of a chunk share one graph and differ in counts alone, so nodes are looked up once a chunk and gains are a
    table of prefixes by nodes.  All paths go to the design length and no further; what ``Beams`` finds there is found here.
    """

    def __init__(self, parts: list[tuple[_Chunk, list[str]]], cfg: Config):
        self.cfg, self.design, k = cfg, parts[0][0].design, cfg.k
        seqs = [s for _, own in parts for s in own]
        self.told = [chunk.told(s) for chunk, own in parts for s in own]
        each = Evidence.of_reads([[s.encode()] for s in seqs], [[1]] * len(seqs), k)
        first = np.cumsum([0] + [len(own) for _, own in parts])
        self.rows, self.tables, self.part = len(seqs), [], np.repeat(np.arange(len(parts)), np.diff(first))
        self.first = first
        for i, (chunk, own) in enumerate(parts):
            found = {}
            for name in DECODING:
                key, n = getattr(each, name), getattr(each, name + "_n")
                a, b = np.searchsorted(key, [first[i] << 32, first[i + 1] << 32])
                found[name] = chunk.sums(name, key[a:b] - (first[i] << 32), n[a:b], len(own))
            self.tables.append(found)

    def _graph(self) -> None:
        """Edges lie by node: those of a node from ``edges[node]`` to the next node's; ``gain`` by ``at[row] + edge``.

        ``row``, ``state``, ``cum``: the paths, a row's paths together in the order of their sequences; at first the starts.
        """
        k, B, mask = self.cfg.k, self.cfg.beam, (1 << (2 * self.cfg.k)) - 1
        own = np.diff(self.first)
        inner = np.arange(self.rows) - self.first[self.part]
        degree, succ, letter, gain, end, ends, paths, nodes = [], [], [], [], [], [], [], 0
        for i, found in enumerate(self.tables):
            (edge, n), (start, many), (last, stops) = (found[x] for x in DECODING)
            node = np.unique(np.concatenate([edge >> 2, edge & mask, start, last]))
            ctx = edge >> 2
            degree.append(np.bincount(np.searchsorted(node, ctx), minlength=len(node)))
            succ.append(nodes + np.searchsorted(node, edge & mask))
            letter.append(edge & 3)
            out = n
            if len(edge):
                new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
                out = np.add.reduceat(n, np.flatnonzero(new), axis=1)[:, np.cumsum(new) - 1]
            gain.append(_gains(n, out))
            total, kinds = many.sum(axis=1), np.count_nonzero(many, axis=1)
            top = np.sort(np.argsort(-many, axis=1, kind="stable")[:, :B], axis=1)
            r, c = np.nonzero(np.take_along_axis(many, top, axis=1))
            of = top[r, c]
            s = many[r, of].astype(float)
            paths.append((self.first[i] + r, nodes + np.searchsorted(node, start[of]), _ln((s + 1.0) / (total[r] + np.maximum(1, kinds[r]))) + 0.15 * _ln(1.0 + s), start[of]))
            # the first of a chunk's columns is that of nodes where no read ends
            column = np.zeros(len(node), np.int64)
            column[np.searchsorted(node, last)] = np.arange(1, len(last) + 1)
            end.append(column)
            ends.append(np.concatenate([np.zeros((own[i], 1), np.int64), stops], axis=1))
            nodes += len(node)
        self.row, self.state, self.cum, self.root = (np.concatenate(x) for x in zip(*paths))
        self.degree, self.succ, self.letter, self.end = (np.concatenate(x) for x in (degree, succ, letter, end))
        self.edges, self.paths = np.cumsum(self.degree) - self.degree, np.bincount(self.row, minlength=self.rows)
        self.gain, self.ends = (np.concatenate([x.ravel() for x in t]) for t in (gain, ends))
        wide, stop = (np.array([x.shape[1] for x in t]) for t in (gain, ends))
        self.at = (np.cumsum(own * wide) - own * wide - (np.cumsum(wide) - wide))[self.part] + inner * wide[self.part]
        self.ends_at = (np.cumsum(own * stop) - own * stop)[self.part] + inner * stop[self.part]

    def _step(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths by one base; which path each comes from, and its edge."""
        B, degree = self.cfg.beam, self.degree.take(self.state)
        behind = np.concatenate([[0], np.cumsum(degree)])
        ends = behind.take(np.concatenate([[0], np.cumsum(self.paths)]))  # where each row's new paths begin and end
        size = int(behind[-1])
        parent = np.repeat(np.arange(len(degree)), degree)
        edge = self.edges.take(self.state) - behind[:-1]  # a new path's edge is this of its parent, and its own place
        cell = (edge + self.at.take(self.row)).take(parent)
        cell += np.arange(size)
        score = self.gain.take(cell)
        score += self.cum.take(parent)
        keep = score > -np.inf  # the others are edges of later reads
        n = np.diff(np.concatenate([[0], np.cumsum(keep)]).take(ends))
        large = n > B
        if large.any():
            own = np.diff(ends)
            at = np.flatnonzero(np.repeat(large, own))
            own = own[large]
            wide = int(own.max())
            spot = np.arange(len(at)) + np.repeat(wide * np.arange(len(own)) - (np.cumsum(own) - own), own)
            value = np.full(len(own) * wide, -np.inf)
            value[spot] = _whole(score.take(at))
            value = value.reshape(len(own), wide)
            least = np.partition(value, wide - B, axis=1)[:, wide - B, None]
            best = value >= least
            spare = np.count_nonzero(best, axis=1) - B
            if spare.any():  # of equal scores the first sequences
                rows = np.flatnonzero(spare)
                tie = value[rows] == least[rows]
                best[rows] &= ~(tie & (np.cumsum(tie, axis=1) > (np.count_nonzero(tie, axis=1) - spare[rows])[:, None]))
            keep[at] = best.ravel().take(spot)
            n[large] = B
        keep = np.flatnonzero(keep)
        parent = parent.take(keep)
        edge = edge.take(parent) + keep
        self.row, self.state, self.cum, self.paths = self.row.take(parent), self.succ.take(edge), score.take(keep), n
        return parent, edge

    def _exact(self) -> tuple[np.ndarray, list[str]]:
        """The prefixes that have a path of the design length, and the best one of each."""
        k = self.cfg.k
        self._graph()
        back = [self._step() for _ in range(self.design - k)]
        prior = np.array([_prior(x[0], self.design, self.cfg) for x in self.told])
        bonus = 0.05 * _ln(1.0 + self.ends[self.ends_at[self.row] + self.end[self.state]])
        value = _whole((self.cum / (self.design - k + 1) + prior[self.row]) + bonus)
        if not (np.abs(value) < 2.0**63).all():
            raise ValueError("score is not finite")
        top = np.full(self.rows, -np.inf)
        np.maximum.at(top, self.row, value)
        row, path = np.unique(self.row[at := np.flatnonzero(value == top[self.row])], return_index=True)
        path = at[path]  # of equal ones the first sequence
        text = np.zeros((len(row), self.design), np.int64)
        for t in range(len(back) - 1, -1, -1):
            parent, edge = back[t]
            path, text[:, k + t] = parent[path], self.letter[edge[path]]
        head = self.root[path]
        for j in range(k):
            text[:, j] = (head >> (2 * (k - 1 - j))) & 3
        letters = np.frombuffer(b"ACGT", np.uint8)[text].tobytes().decode()
        return row, [letters[i : i + self.design] for i in range(0, len(letters), self.design)]

    def decode(self) -> tuple[list[tuple[str, int] | None], dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]]:
        """Sequence and family of each prefix; of those without a path or a read of the design length the counters."""
        out: list[tuple[str, int] | None] = [None] * self.rows
        if self.design >= self.cfg.k and not self.cfg.band:
            for i, text in zip(*self._exact()):
                out[i] = text, 1
            for i, x in enumerate(out):
                if x is None and self.told[i][1]:
                    out[i] = self.told[i][1], 2
        rest = {}
        for i, x in enumerate(out):
            if x is None:
                own = {name: (code, table[i - self.first[self.part[i]]]) for name, (code, table) in self.tables[self.part[i]].items()}
                rest[i] = {name: (code[n > 0], n[n > 0]) for name, (code, n) in own.items()}
        return out, rest


def _by_all_lengths(rest: list[tuple], cfg: Config) -> list[tuple[str, int]]:
    """Prefixes ``(design, counters, lengths, exact, common)`` as clusters of their own."""
    e = Evidence(len(rest), cfg.k)
    for name in DECODING:
        setattr(e, name, np.concatenate([(i << 32) | x[1][name][0] for i, x in enumerate(rest)]))
        setattr(e, name + "_n", np.concatenate([x[1][name][1] for x in rest]))
    e.hist = [dict(x[2]) for x in rest]
    beams = Beams(e, [x[0] for x in rest], cfg)
    return [choose(beams, i, x[0], *x[3:])[:2] for i, x in enumerate(rest)]


def _decode_chunks(chunks: list[_Chunk], cfg: Config) -> list[list[tuple[str, int]]]:
    """Sequence and family of each arrival of each chunk; chunks of a design length share blocks."""
    found: list[list[tuple[str, int] | None]] = [[] for _ in chunks]
    parts: list[tuple[int, list[str]]] = []
    rest: list[tuple[int, int, tuple]] = []  # chunk, place, and what decoding asks for

    def others() -> None:
        if rest:
            for (i, at, _), x in zip(rest, _by_all_lengths([x for _, _, x in rest], cfg)):
                found[i][at] = x
            rest.clear()

    def flush() -> None:
        if parts:
            block = _Block([(chunks[i], own) for i, own in parts], cfg)
            out, left = block.decode()
            for p, (i, own) in enumerate(parts):
                rows = range(block.first[p], block.first[p + 1])
                rest.extend((i, len(found[i]) + j, (block.design, left[row], *block.told[row])) for j, row in enumerate(rows) if row in left)
                found[i] += [out[row] for row in rows]
            parts.clear()
            if sum(len(x[1]["edge"][0]) for _, _, x in rest) > CELLS >> 3 or len(rest) > BLOCK:
                others()

    for i in sorted(range(len(chunks)), key=lambda i: chunks[i].design):
        c = chunks[i]
        while c.at < len(c.seqs):
            if parts and (parts[-1][0] == i or chunks[parts[-1][0]].design != c.design or sum(len(own) for _, own in parts) + len(c.seqs) - c.at > BLOCK):
                flush()  # a chunk's next block starts from its last one
            parts.append((i, c.block(BLOCK)))
    flush()
    others()
    return found


def _chunks(cfg: Config):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                yield one(batch.slice(lo, 128))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        reads = batch.column("reads")
        of, cut = reads.flatten(), np.concatenate([[0], np.cumsum(np.diff(reads.offsets.to_numpy()))])
        seqs = of.field("seq").to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("design_length", "grams", "lengths")]
        chunks = [_Chunk(design, seqs[cut[i] : cut[i + 1]], grams or [], lengths or []) for i, (design, grams, lengths) in enumerate(zip(*columns))]
        found = [x for rows in _decode_chunks(chunks, cfg) for x in rows]
        names = batch.column("cluster_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(cut))))
        arrays = [names, of.field("arrival"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PREFIXES.split(", ")])

    return run


def prefix_decode(reads: DataFrame, order: str, cfg: Config = Config(), chunk: int = CHUNK) -> DataFrame:
    """``(cluster_id, arrival, sequence, family)``: what the first ``arrival`` reads decode to, for every arrival."""
    at = reads.select("cluster_id", "design_length", canonical("read_sequence").alias("seq"), F.row_number().over(_arrivals(order)).alias("arrival"))
    at = at.withColumn("chunk", F.floor((F.col("arrival") - 1) / chunk).cast("int"))
    own = at.groupBy("cluster_id", "design_length", "chunk").agg(F.array_sort(F.collect_list(F.struct("arrival", "seq"))).alias("reads"))
    # asks for one answer, yes or no, after partial counts: where no cluster has a second chunk there is nothing to add up
    if reads.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).isEmpty():
        none = F.lit(None).cast(EARLIER)
        return own.select("cluster_id", "design_length", "reads", none.getField("grams").alias("grams"), none.getField("lengths").alias("lengths")).mapInArrow(_chunks(cfg), PREFIXES)
    # the counters of a chunk count for all later ones; clusters of one chunk have none
    last = F.max("chunk").over(Window.partitionBy("cluster_id"))
    early = at.withColumn("last", last).where("chunk < last")
    key = F.struct("cluster_id", "design_length", "chunk", "last")
    rows = counters(early.groupBy(key.alias("cluster_id"), "seq").agg(F.count(F.lit(1)).alias("n")), cfg.k, DECODING, reads=True)
    each = rows.select("cluster_id.*", F.explode(F.sequence(F.col("cluster_id.chunk") + 1, F.col("cluster_id.last"))).alias("later"), "kind", "code", "seq", "support")
    summed = each.groupBy(F.struct("cluster_id", "later").alias("cluster_id"), "design_length", "kind", "code", "seq").agg(F.sum("support").alias("support"))
    base = shaped(summed, counts=True).select("cluster_id.*", "lengths", "grams")
    both = own.join(base, (own["cluster_id"] == base["cluster_id"]) & (own["chunk"] == base["later"]), "left").drop(base["cluster_id"])
    return both.select("cluster_id", "design_length", "reads", "grams", "lengths").mapInArrow(_chunks(cfg), PREFIXES)
