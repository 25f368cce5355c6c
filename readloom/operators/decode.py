"""Width-bounded beam decoding of clusters, and the choice of one sequence for each.

Equal reads are counted in one shuffle (with partial sums before it, by cluster and sequence, so a hot cluster is spread),
different ones gathered by cluster in a second one, and decoded many clusters at a time as arrays: all clusters of a batch
take a step together.  Clusters with more than
``SPLIT`` distinct reads are not gathered; their evidence is summed by the cluster as a ledger, whose size is bounded by
the number of grams (4^(k+1)), and only that ledger is decoded.  Results don't depend on partitions or on read order.

Scores are compared as whole numbers of 1e-12, higher first, then by sequence.  The first of these families that has a
sequence gives the result: (1) paths of the design length, (2) the most frequent read of that length, (3) paths 1 to 5
bases shorter or longer, both at once, nearest first, (4) paths of the reads' own lengths, (5) the most frequent read.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.evidence import KINDS, READ, counters, multiplicity, tasks
from readloom.schema import Config

SPLIT = 50_000
REACH = 5
FAMILIES = {1: "beam_exact", 2: "read_exact", 3: "beam_near", 4: "beam_window", 5: "read_any"}
_LUT = np.full(256, 4, np.uint8)
_LUT[list(b"ACGT")] = range(4)
_LETTERS = np.array(list("ACGT"), object)


def buckets(score: np.ndarray) -> np.ndarray:
    """round(score * 1e12), the product in double precision and halves away from zero, as SQL has it."""
    x = np.asarray(score, float) * 1e12
    size = np.abs(x)
    if not (size < 2.0**63).all():
        raise ValueError("score is not finite")
    whole = np.floor(size)
    return np.copysign(whole + (size - whole >= 0.5), x).astype(np.int64)


def _ln(x: np.ndarray) -> np.ndarray:
    """Logarithms of the C library, as SQL has them: those of numpy's vectors differ in the last bit, which parts equal scores."""
    u, inverse = np.unique(x, return_inverse=True)
    return np.array([math.log(v) for v in u.tolist()], float)[inverse.ravel()].reshape(np.shape(x))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(key, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64)


class Evidence:
    """Counters of a batch of clusters.  Keys are ``cluster << 32 | code``; ``hist``: per cluster (lengths, counts)."""

    def __init__(self, clusters: int, k: int):
        self.clusters, self.k = clusters, k

    @classmethod
    def of_reads(cls, reads: list[list[bytes]], n: list[list[int]], k: int) -> Evidence:
        e = cls(len(reads), k)
        flat = [r for rs in reads for r in rs]
        size = np.array([len(r) for r in flat], np.int64)
        many = np.array([x for xs in n for x in xs], np.int64)
        owner = np.repeat(np.arange(len(reads)), [len(rs) for rs in reads])
        base = _LUT[np.frombuffer(b"".join(flat), np.uint8)]
        first = np.concatenate([[0], np.cumsum(size)])
        bad = np.concatenate([[0], np.cumsum(base > 3)])
        of = np.repeat(np.arange(len(flat)), size)
        codes = base.astype(np.int64) & 3

        def windows(w: int) -> tuple[np.ndarray, np.ndarray]:
            at = np.arange(max(0, len(base) - w + 1))
            ok = at[(at + w <= first[of[: len(at)] + 1]) & (bad[w:] == bad[: len(at)])] if len(at) else at
            c = np.zeros(len(ok), np.int64)
            for j in range(w):
                c = (c << 2) | codes[ok + j]
            return ok, c

        at, c = windows(k + 1)
        r = of[at]
        e.edge, e.edge_n = _summed((owner[r] << 32) | c, many[r])
        at, c = windows(k)
        r = of[at]
        head = np.ones(len(r), bool)
        head[1:] = r[1:] != r[:-1]
        tail = np.ones(len(r), bool)
        tail[:-1] = head[1:]
        key = (owner[r] << 32) | c
        e.start, e.start_n = _summed(key[head], many[r[head]])
        e.end, e.end_n = _summed(key[tail], many[r[tail]])
        hist: list[dict[int, int]] = [{} for _ in reads]
        for o, s, m in zip(owner.tolist(), size.tolist(), many.tolist()):
            hist[o][s] = hist[o].get(s, 0) + m
        e.hist = hist
        return e


def _length_model(hist: dict[int, int], cfg: Config):
    """Median, window, and score of a length, from a histogram in ascending order: the same for any order of reads."""
    lengths = sorted(hist)
    total = sum(hist.values())
    seen, mids = 0, []
    for target in ((total + 1) // 2, total // 2 + 1):
        seen = 0
        for x in lengths:
            seen += hist[x]
            if seen >= target:
                mids.append(x)
                break
    med = 0.5 * (mids[0] + mids[1]) if mids else 0.0
    if cfg.prior == "median_band":
        tol = max(3, math.floor(0.15 * med + 0.5))
        return (max(cfg.k, math.floor(med) - tol), max(cfg.k, math.ceil(med) + tol)), lambda n: -0.75 * abs(n - med) / tol
    n = max(1, total)
    mu = math.fsum(hist[x] * math.log(max(1, x)) for x in lengths) / n
    var = max(0.0, math.fsum(hist[x] * math.log(max(1, x)) ** 2 for x in lengths) / n - mu * mu)
    s = max(0.08, math.sqrt(var))
    lo = max(cfg.k, math.floor(math.exp(mu - 2 * s)), math.floor(0.60 * med))
    hi = max(lo, min(math.ceil(math.exp(mu + 2 * s)), math.ceil(1.50 * med)))

    def score(length: int) -> float:
        z = (math.log(max(1, length)) - mu) / s
        return -0.375 * z * z

    return (lo, hi), score


def _bands(first: np.ndarray, succ: np.ndarray, support: np.ndarray, steps: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First step of each cluster's band, and the one after its last.

    A walk takes the most frequent base at every step up to the design length (of equal ones the first in the alphabet); the
    weakest step is the first one whose best base leads its next one by the least.  As the totals cancel, a lead is measured
    by the ratio of both counts, each plus one.  The band lies around that step as far as there are steps on both sides.
    """
    rows = np.arange(len(support))
    letter = support.argmax(axis=1)
    top = support[rows, letter]
    rest = support.copy()
    rest[rows, letter] = 0
    second = rest.max(axis=1)
    lead = np.where(second > 0, (top + 1) / (second + 1), np.inf)
    ahead = np.where(top > 0, succ[rows, letter], -1)
    at, weakest, least = first.copy(), np.zeros(len(first), np.int64), np.full(len(first), np.inf)
    for t in range(int(steps.max(initial=0))):
        at[t >= steps] = -1
        if not (at >= 0).any():
            break
        weaker = (at >= 0) & (lead[at] < least)
        weakest[weaker], least[weaker] = t, lead[at[weaker]]
        at = np.where(at >= 0, ahead[at], -1)
    stop = np.minimum(steps, np.maximum(0, weakest - width // 2) + width)
    return np.maximum(0, stop - width), stop


class Beams:
    """All steps of all clusters of a batch.

    A cluster's paths stand in the order of their sequences, so a stable sort by score alone breaks ties by sequence.
    ``complete``: for each length the row of each cluster, and the buckets and scores of its complete paths.
    """

    def __init__(self, e: Evidence, design: list[int], cfg: Config, keep_frontier: bool = False):
        k, B, C = cfg.k, cfg.beam, e.clusters
        self.k, mask = k, (1 << (2 * k)) - 1
        to = (e.edge >> 32 << 32) | (e.edge & mask)
        ctx = (e.edge >> 32 << 32) | ((e.edge & 0xFFFFFFFF) >> 2)
        node = np.unique(np.concatenate([ctx, to, e.start, e.end]))
        at = np.searchsorted(node, ctx)
        out = np.bincount(at, e.edge_n, len(node))
        succ = np.full((len(node) + 1, 4), -1, np.int64)
        gain = np.full((len(node) + 1, 4), -np.inf)
        base = e.edge & 3
        succ[at, base] = np.searchsorted(node, to)
        support = e.edge_n.astype(float)
        gain[at, base] = _ln((support + 1.0) / (out[at] + 4.0)) + 0.15 * _ln(1.0 + support)
        end = np.zeros(len(node) + 1)
        end[np.searchsorted(node, e.end)] = e.end_n
        bonus = 0.05 * _ln(1.0 + end)
        steps = np.maximum(0, np.array(design, np.int64) - k)

        owner = e.start >> 32
        order = np.lexsort((e.start & 0xFFFFFFFF, -e.start_n, owner))
        owner, key, n = owner[order], e.start[order], e.start_n[order].astype(float)
        total, kinds = np.bincount(owner, n, C), np.bincount(owner, minlength=C)
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        if cfg.band:
            counts = np.zeros((len(node) + 1, 4))
            counts[at, base] = support
            first = np.full(C, -1, np.int64)
            first[owner[place == 0]] = np.searchsorted(node, key[place == 0])
            lo, hi = _bands(first, succ, counts, steps, cfg.band)
            width = lambda t, c: np.where((lo[c] <= t) & (t < hi[c]), B, 1)
        else:
            width = lambda t, c: np.full(len(c), B)
        keep = place < width(0, owner)
        owner, key, n = owner[keep], key[keep], n[keep]
        order = np.argsort(key, kind="stable")
        owner, key, n = owner[order], key[order], n[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        state = np.full((C, B), -1, np.int64)
        cum = np.full((C, B), -np.inf)
        state[owner, place] = np.searchsorted(node, key)
        cum[owner, place] = _ln((n + 1.0) / (total[owner] + np.maximum(1, kinds[owner]))) + 0.15 * _ln(1.0 + n)
        self.root = np.zeros((C, B), np.int64)
        self.root[owner, place] = key & 0xFFFFFFFF

        models = [_length_model(h, cfg) for h in e.hist]
        soft_lo = np.array([max(k, d - REACH) for d in design])
        soft_hi = np.array([max(max(k, d - REACH), d + REACH) for d in design])
        a_lo, a_hi = np.array([m[0][0] for m in models]), np.array([m[0][1] for m in models])
        most = np.maximum(a_hi, soft_hi)
        self.window, self.soft = list(zip(a_lo.tolist(), a_hi.tolist())), list(zip(soft_lo.tolist(), soft_hi.tolist()))
        self.back: list[tuple[np.ndarray, np.ndarray]] = []  # rows of live clusters, and their paths' parents times 4 and letters
        self.complete: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.frontier: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # clusters, length, places, sequences
        paths = np.array([["".join("ACGT"[(head >> (2 * (k - 1 - j))) & 3] for j in range(k)) for head in row] for row in self.root.tolist()], object).reshape(C, B) if keep_frontier else None
        lowest, highest = np.minimum(a_lo, soft_lo), np.maximum(a_hi, soft_hi)
        live = np.arange(C)
        length = k
        while True:
            has = state[:, 0] >= 0
            wanted = np.flatnonzero(has & (length >= lowest[live]) & (length <= highest[live]))
            if len(wanted):
                prior = np.array([models[c][1](length) for c in live[wanted].tolist()])
                some = state[wanted] >= 0
                score = (cum[wanted] / max(1, length - k + 1) + prior[:, None]) + bonus[state[wanted]]
                value = np.full(score.shape, np.iinfo(np.int64).min)
                value[some] = buckets(score[some])
                row = np.full(C, -1)
                row[live[wanted]] = np.arange(len(wanted))
                self.complete[length] = (row, some, value, score)
            go = has & (length < most[live])
            if not go.any():
                break
            if not go.all():
                live, state, cum = live[go], state[go], cum[go]
                paths = paths[go] if keep_frontier else None
            nxt = succ[state].reshape(len(live), 4 * B)
            score = (cum[:, :, None] + gain[state]).reshape(len(live), 4 * B)
            ok = (nxt >= 0) & np.repeat(state >= 0, 4, axis=1)
            worst = np.full(score.shape, np.iinfo(np.int64).max)
            worst[ok] = -buckets(score[ok])
            best = worst.argsort(axis=1, kind="stable")[:, :B]
            rows = np.arange(len(live))[:, None]
            best = np.where(ok[rows, best] & (np.arange(best.shape[1]) < width(length - k, live)[:, None]), best, 4 * B)
            best.sort(axis=1)
            good = best < 4 * B
            best = np.minimum(best, 4 * B - 1)
            state = np.where(good, nxt[rows, best], -1)
            cum = np.where(good, score[rows, best], -np.inf)
            row = np.full(C, -1, np.int32)
            row[live] = np.arange(len(live))
            self.back.append((row, best.astype(np.int8)))
            length += 1
            if keep_frontier:
                paths = paths[rows, best // 4] + _LETTERS[best % 4]
                r, p = np.nonzero(good)
                self.frontier.append((live[r], length, p, paths[r, p]))

    def candidates(self, c: int, lengths) -> list[tuple[int, int, int, float]]:
        """``(length, bucket, place, score)`` of a cluster's complete paths of some lengths."""
        out = []
        for n in lengths:
            if n in self.complete:
                row, some, value, score = self.complete[n]
                if (r := row[c]) >= 0:
                    out += [(n, int(value[r, p]), p, float(score[r, p])) for p in np.flatnonzero(some[r]).tolist()]
        return out

    def all_candidates(self, c: int) -> list[tuple[int, int, int, float]]:
        """Those near the design length, or of the reads' own lengths."""
        (a, b), (x, y) = self.window[c], self.soft[c]
        return self.candidates(c, sorted({*range(a, b + 1), *range(x, y + 1)}))

    def sequence(self, c: int, length: int, place: int) -> str:
        tail = []
        for step in range(length - self.k - 1, -1, -1):
            row, best = self.back[step]
            place, letter = divmod(int(best[row[c], place]), 4)
            tail.append("ACGT"[letter])
        head = int(self.root[c, place])
        return "".join("ACGT"[(head >> (2 * (self.k - 1 - j))) & 3] for j in range(self.k)) + "".join(reversed(tail))

    def best(self, c: int, lengths) -> tuple[str, float] | None:
        """The best candidate of some lengths; of equal scores the least sequence."""
        rows = self.candidates(c, lengths)
        if not rows:
            return None
        top = max(x[1] for x in rows)
        return min((self.sequence(c, x[0], x[2]), x[3]) for x in rows if x[1] == top)


def choose(beams: Beams, c: int, design: int, exact: str | None, common: str | None) -> tuple[str, int, float | None]:
    lo, hi = beams.soft[c]
    inside = lambda n: lo <= n <= hi
    if inside(design) and (x := beams.best(c, (design,))):
        return x[0], 1, x[1]
    if exact:
        return exact, 2, None
    for d in range(1, REACH + 1):
        if x := beams.best(c, tuple(n for n in (design - d, design + d) if inside(n))):
            return x[0], 3, x[1]
    a, b = beams.window[c]
    if x := beams.best(c, range(a, b + 1)):
        return x[0], 4, x[1]
    return common or "", 5, None


def favourites(reads: list[bytes], n: list[int], design: int) -> tuple[str | None, str | None]:
    top = lambda rows: min(rows)[1].decode() if rows else None
    rows = [(-m, r) for r, m in zip(reads, n)]
    return top([x for x in rows if len(x[1]) == design]), top(rows)


def decode_lists(ids: list[str], design: list[int], reads: list[list[bytes]], n: list[list[int]], cfg: Config) -> pa.RecordBatch:
    """Decode clusters whose different reads and their counts are at hand."""
    e = Evidence.of_reads(reads, n, cfg.k)
    beams, out = Beams(e, design, cfg), []
    for c, name in enumerate(ids):
        seq, family, score = choose(beams, c, design[c], *favourites(reads[c], n[c], design[c]))
        out.append((name, design[c], sum(e.hist[c].values()), seq, family, score))
    return _batch(out, DECODED)


DECODED = "cluster_id string, design_length int, total_reads long, sequence string, family int, score double"
#: With the task that decoded the cluster, and the cluster's share of the time that its batch took there.
TIMED = DECODED + ", task int, seconds double"
CANDIDATES = "cluster_id string, length int, place int, sequence string, score double, soft boolean, window boolean"
FRONTIER = "cluster_id string, length int, place int, sequence string"


def _decode(cfg: Config, what: str, from_ledger: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield from one(batch.slice(lo, 512))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        began = time.perf_counter()
        ids, design = batch.column("cluster_id").to_pylist(), batch.column("design_length").to_pylist()
        if from_ledger:
            e, own = Evidence(len(ids), cfg.k), np.arange(len(ids))
            grams = batch.column("grams")
            owner = np.repeat(own, np.diff(grams.offsets.to_numpy()))
            kind, key, n = (grams.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(3))
            key = (owner << 32) | key
            for name in ("edge", "start", "end"):
                take = kind == KINDS[name]
                u, s = _summed(key[take], n[take])
                setattr(e, name, u)
                setattr(e, name + "_n", s)
            lengths = batch.column("lengths").to_pylist()
            e.hist = [{x["len"]: x["n"] for x in r} for r in lengths]
            best = lambda rows: min(((-x["most"], x["seq"]) for x in rows), default=(0, None))[1]
            favourite = [(best([x for x in r if x["len"] == d]), best(r)) for r, d in zip(lengths, design)]
        else:
            rows = batch.column("reads").to_pylist()
            reads, n = [[x["seq"].encode() for x in r] for r in rows], [[x["n"] for x in r] for r in rows]
            e = Evidence.of_reads(reads, n, cfg.k)
            favourite = [favourites(r, m, d) for r, m, d in zip(reads, n, design)]
        beams = Beams(e, design, cfg, what == "frontier")
        if what == "frontier":
            name = np.array(ids, object)
            for c, length, p, seq in beams.frontier:
                yield pa.RecordBatch.from_arrays([pa.array(name[c], pa.string()), pa.array(np.full(len(c), length, np.int32)), pa.array(p.astype(np.int32)), pa.array(seq, pa.string())], names=[f.split()[0] for f in FRONTIER.split(", ")])
        elif what == "candidates":
            out = []
            for c in range(len(ids)):
                by: dict[int, list] = {}
                for length, b, p, s in beams.all_candidates(c):
                    by.setdefault(length, []).append((-b, beams.sequence(c, length, p), s))
                for length, xs in by.items():
                    soft, window = beams.soft[c][0] <= length <= beams.soft[c][1], beams.window[c][0] <= length <= beams.window[c][1]
                    out += [(ids[c], length, i, seq, s, soft, window) for i, (_, seq, s) in enumerate(sorted(xs), 1)]
            yield _batch(out, CANDIDATES)
        else:
            out = []
            for c, name in enumerate(ids):
                seq, family, score = choose(beams, c, design[c], *favourite[c])
                out.append((name, design[c], sum(e.hist[c].values()), seq, family, score))
            if what == "timed":
                each = (TaskContext.get().partitionId(), (time.perf_counter() - began) / max(1, len(out)))
                yield _batch([(*row, *each) for row in out], TIMED)
            else:
                yield _batch(out, DECODED)

    return run


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _gathered(mult: DataFrame) -> DataFrame:
    return mult.groupBy("cluster_id", "design_length").agg(F.collect_list(F.struct("seq", "n")).alias("reads"))


#: Counters that decoding needs.
DECODING = ("edge", "start", "end")


def shaped(rows: DataFrame, counts: bool = False) -> DataFrame:
    """Rows of ``counters(..., DECODING, reads=True)`` with ``design_length``, by cluster, as the decoder takes them.

    At most 4^(k+1) grams a cluster, however many reads it has, and a row for each length of its reads; with ``counts`` also
    all reads of that length, which a caller has to bound.
    """
    read = F.col("kind") == READ
    slot = F.when(read, F.length("seq")).otherwise(F.lit(-1))
    gram = F.when(~read, F.struct("kind", "code", "support"))
    best = F.min(F.when(read, F.struct((-F.col("support")).alias("m"), F.col("seq").alias("seq"))))
    every = [F.collect_list(F.when(read, F.struct("seq", F.col("support").alias("n")))).alias("counts")] if counts else []
    by = rows.groupBy("cluster_id", slot.alias("len")).agg(F.max("design_length").alias("design_length"), F.collect_list(gram).alias("grams"), F.sum(F.when(read, F.col("support"))).alias("n"), best.alias("best"), *every)
    length = F.when(F.col("len") >= 0, F.struct("len", "n", (-F.col("best.m")).alias("most"), F.col("best.seq").alias("seq"), *(["counts"] if counts else [])))
    return by.groupBy("cluster_id").agg(F.max("design_length").alias("design_length"), F.collect_list(length).alias("lengths"), F.flatten(F.collect_list("grams")).alias("grams"))


def _ledgers(mult: DataFrame, k: int, many: int | None = None) -> DataFrame:
    """One row a cluster, with its summed evidence."""
    # a cluster has one design length; it rides on the name, so that the counters know of none
    named = mult.withColumn("cluster_id", F.struct("cluster_id", "design_length"))
    rows = counters(named, k, DECODING, reads=True, many=many)
    return shaped(rows.select("cluster_id.cluster_id", "cluster_id.design_length", "kind", "code", "seq", "support"))


def decode_ledger(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Decode summed counters ``(cluster_id, design_length, kind, code, seq, support)``, as of ``DECODING`` and reads."""
    return shaped(rows).mapInArrow(_decode(cfg, "decode", True), DECODED)


def _run(reads: DataFrame, cfg: Config, what: str, ddl: str, split: int | None) -> DataFrame:
    mult = multiplicity(reads)
    if split is not None and split <= 0:  # every cluster has a read
        return _ledgers(mult, cfg.k, tasks(reads)).mapInArrow(_decode(cfg, what, True), ddl)
    # asks for one answer, yes or no, after partial counts: without large clusters the plan has one branch and one shuffle
    if split is None or reads.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).isEmpty():
        return _gathered(mult).mapInArrow(_decode(cfg, what, False), ddl)
    return _branches(mult, cfg, what, ddl, split, tasks(reads))


def _branches(mult: DataFrame, cfg: Config, what: str, ddl: str, split: int, many: int | None = None) -> DataFrame:
    """Large clusters from their ledgers, the others from their reads."""
    big = mult.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > split).select("cluster_id")
    small = _gathered(mult.join(big, "cluster_id", "left_anti")).mapInArrow(_decode(cfg, what, False), ddl)
    large = _ledgers(mult.join(big, "cluster_id", "left_semi"), cfg.k, many).mapInArrow(_decode(cfg, what, True), ddl)
    return small.unionByName(large)


def decode_counted(mult: DataFrame, cfg: Config = Config(), split: int = SPLIT) -> DataFrame:
    """``decode`` of reads that are counted already: ``(cluster_id, design_length, seq, n)``, canonical, each once."""
    if mult.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > split).isEmpty():
        return _gathered(mult).mapInArrow(_decode(cfg, "decode", False), DECODED)
    return _branches(mult, cfg, "decode", DECODED, split)


def decode(reads: DataFrame, cfg: Config = Config(), split: int | None = SPLIT, timed: bool = False) -> DataFrame:
    """``reads(cluster_id, design_length, read_sequence)`` -> one row a cluster: sequence, family, score.

    ``split``: distinct reads from which a cluster is decoded from its summed ledger; None where clusters are known to be
    small, which spares counting them.  ``timed``: with the columns ``task`` and ``seconds`` too.
    """
    return _run(reads, cfg, "timed", TIMED, split) if timed else _run(reads, cfg, "decode", DECODED, split)


def candidates(reads: DataFrame, cfg: Config = Config(), split: int | None = SPLIT) -> DataFrame:
    """Every complete path by length, best first; ``soft``: near the design length, ``window``: of the reads' own lengths."""
    return _run(reads, cfg, "candidates", CANDIDATES, split)


def frontier(reads: DataFrame, cfg: Config = Config(), split: int | None = SPLIT) -> DataFrame:
    """The kept paths after every step."""
    return _run(reads, cfg, "frontier", FRONTIER, split)


def predictions(decoded: DataFrame, dataset: str, *more: str) -> DataFrame:
    """Prediction rows; every read is consumed.  ``more``: columns to keep beside them."""
    n = F.col("total_reads")
    alias = F.least(F.lit(20), n).cast("int")
    return decoded.select(
        F.concat_ws("|", F.lit(dataset), "cluster_id", alias.cast("string")).alias("row_key"),
        F.lit(dataset).alias("dataset_id"),
        "cluster_id",
        alias.alias("legacy_prefix_alias"),
        n.alias("stop_index"),
        n.alias("consumed_reads"),
        n.alias("total_reads"),
        F.col("sequence").alias("reconstructed_sequence"),
        F.when(F.col("sequence") != "", "completed_nonempty").otherwise("completed_empty").alias("status"),
        *more,
    )


def stop_points(pred: DataFrame, round_id: str = "1") -> DataFrame:
    return pred.select(F.col("dataset_id").alias("dataset"), F.lit(round_id).alias("round_id"), "cluster_id", "stop_index", "total_reads", (F.col("total_reads") - F.col("consumed_reads")).alias("unused_reads"), (F.col("consumed_reads") < F.col("total_reads")).cast("int").alias("stopped_early"), F.col("status").alias("output_status"))
