"""A pool of candidate sequences for each cluster, kept up to date as batches of reads come in.

The first reads are candidates themselves.  A batch changes the counters of some contexts; only steps of candidates through
those contexts are scored again, and each such candidate gives one repaired one, with the base changed whose step through a
changed context gains most (of equal gains the first base, then the first place).  Repaired candidates and the batch's
reads join the pool, of which the best ``Config.beam`` stay.  Candidates with a step that no read has are left out.

Steps count in whole 1e-12s, so sums don't depend on order, and refreshed sums equal those made from nothing.  Clusters
without reads in a batch stay as they are.  Reads with bases other than A, C, G, T and those shorter than ``k`` count as
evidence, but are no candidates.

A candidate has nearly as many steps as bases, so its steps are not shuffled: a cluster's different reads and its pool are
gathered, and the clusters of an Arrow batch scored together as arrays.  Clusters with more than ``GATHERED`` bases of
different reads are not gathered; their steps are rows that meet the counters by joins, and name their candidate by a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import columns as C
from readloom.operators.decode import _LUT, Evidence, _batch, _length_model, _ln, buckets
from readloom.operators.evidence import edges, ends, outgoing, starts
from readloom.schema import Config

POOL = "cluster_id string, sequence string, points long, score double"
#: Bases of different reads up to which a cluster is gathered, and up to which clusters are scored together.
GATHERED, TOGETHER = 1 << 21, 1 << 20


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` for the right side of a join that shuffles: a table of few compressed bytes is large in a driver that broadcasts it."""
    return df.hint("merge")


def _points(mult: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, context, base, points)`` of all edges."""
    edge = edges(mult, k)
    total = outgoing(edge).withColumnRenamed("support", "total")
    return edge.join(_shuffled(total), ["cluster_id", "context"]).mapInArrow(_pointed, "cluster_id string, context string, base string, points long")


def _pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, total = (b.column(x).to_numpy(zero_copy_only=False) for x in ("support", "total"))
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("cluster_id", "context", "base")), pa.array(_points_of(n, total))], names=["cluster_id", "context", "base", "points"])


def uses(pool: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, id, at, context, base)``: which steps of which candidates go through a context."""
    at = pool.where(F.length("sequence") > k).select("cluster_id", "id", "sequence", F.explode(F.sequence(F.lit(1), F.length("sequence") - k)).alias("at"))
    return at.select("cluster_id", "id", "at", F.substring("sequence", F.col("at"), F.lit(k)).alias("context"), F.substring("sequence", F.col("at") + k, F.lit(1)).alias("base"))


def _from_nothing(found: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, sequence, points)`` of candidates all of whose steps have reads.

    ``id`` stands for a candidate in the rows of its steps; without that column the sequence does.
    """
    fit = found.where(F.col("sequence").rlike(f"^[ACGT]{{{k},}}$"))
    fit = fit if "id" in fit.columns else fit.withColumn("id", F.col("sequence"))
    summed = uses(fit, k).join(_shuffled(points), ["cluster_id", "context", "base"]).groupBy("cluster_id", "id").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("steps"))
    whole = fit.join(_shuffled(summed), ["cluster_id", "id"]).where(F.col("steps") == F.length("sequence") - k).select("cluster_id", "sequence", "points")
    return whole.unionByName(fit.where(F.length("sequence") == k).select("cluster_id", "sequence", F.lit(0).cast("long").alias("points")))


def _scored(sums: DataFrame, mult: DataFrame, cfg: Config) -> DataFrame:
    """``sums`` with the scores that whole sequences have."""
    k, size = cfg.k, F.length("seq")
    ln = F.log(F.greatest(F.lit(1), size).cast("double"))
    stat = mult.groupBy("cluster_id").agg(F.sum("n").alias("_n"), F.sum(ln * F.col("n")).alias("_logs"), F.sum(ln * ln * F.col("n")).alias("_squares"), F.percentile(size, F.lit(0.5), F.col("n")).alias("_median"))
    start = starts(mult, k)
    total = start.groupBy("cluster_id").agg(F.sum("support").alias("_total"), F.count(F.lit(1)).alias("_kinds"))
    head, tail = F.substring("sequence", 1, k), F.substring("sequence", F.length("sequence") - k + 1, F.lit(k))
    rows = sums.withColumns({"_head": head, "_tail": tail})
    rows = rows.join(_shuffled(start.select("cluster_id", F.col("context").alias("_head"), F.col("support").alias("_start"))), ["cluster_id", "_head"], "left")
    rows = rows.join(_shuffled(ends(mult, k).select("cluster_id", F.col("context").alias("_tail"), F.col("support").alias("_end"))), ["cluster_id", "_tail"], "left")
    rows = rows.join(_shuffled(total), "cluster_id", "left").join(_shuffled(stat), "cluster_id")
    zero = lambda c, least=0: F.coalesce(F.col(c), F.lit(least))
    first = C.start_score(zero("_start"), F.greatest(F.lit(1), zero("_total")), zero("_kinds"))
    prior = C.length_score(F.length("sequence"), F.col("_n"), F.col("_logs"), F.col("_squares"), F.col("_median"), cfg.prior)
    score = (first + F.col("points") * 1e-12) / (F.length("sequence") - k + 1) + prior + 0.05 * F.log1p(zero("_end"))
    return rows.select("cluster_id", "sequence", "points", score.alias("score"))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("cluster_id", "design_length", "seq").agg(F.sum("n").alias("n"))


def refreshed(pool: DataFrame, points_before: DataFrame, points: DataFrame, changed: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, sequence, points)`` of a pool with ``id``, with only the steps through ``changed(cluster_id, context)`` scored again."""
    on = ["cluster_id", "context", "base"]
    step = uses(pool, k).join(_shuffled(changed), ["cluster_id", "context"], "left_semi").groupBy("id", *on).agg(F.count(F.lit(1)).alias("times"))
    old = points_before.withColumnRenamed("points", "old")
    delta = step.join(_shuffled(points), on).join(_shuffled(old), on).groupBy("cluster_id", "id").agg(F.sum(F.col("times") * (F.col("points") - F.col("old"))).alias("delta"))
    return pool.join(_shuffled(delta), ["cluster_id", "id"], "left").select("cluster_id", "sequence", (F.col("points") + F.coalesce("delta", F.lit(0))).alias("points"))


def repaired(pool: DataFrame, points: DataFrame, changed: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, sequence)``: each candidate's best change of one base behind a changed context, where one gains."""
    step = uses(pool, k).join(_shuffled(changed), ["cluster_id", "context"], "left_semi")
    own = step.join(_shuffled(points), ["cluster_id", "context", "base"]).withColumnRenamed("points", "own").drop("base")
    gain = (F.col("points") - F.col("own")).alias("gain")
    best = own.join(_shuffled(points), ["cluster_id", "context"]).select("cluster_id", "id", "at", "base", gain).where("gain > 0").groupBy("cluster_id", "id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "base", "at")).alias("x"))
    fixed = pool.select("cluster_id", "id", "sequence").join(_shuffled(best), ["cluster_id", "id"])
    return fixed.select("cluster_id", F.overlay("sequence", "x.base", F.col("x.at") + k, F.lit(1)).alias("sequence")).distinct()


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points_of(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return buckets(_ln((n + 1) / (total + 4)) + 0.15 * _ln(1 + n))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among ascending ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _support(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at, there = _found(keys, wanted)
    out = np.zeros(len(wanted), np.int64)
    out[there] = n[at[there]]
    return out


def _totals(edge: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each edge the support of all edges of its context."""
    _, context = np.unique(edge >> 2, return_inverse=True)
    return np.bincount(context, n).astype(np.int64)[context]


def _walks(owner: np.ndarray, seqs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps of sequences, one after the other: whose, at which place, by which gram; and where those of each begin."""
    size = np.array([len(s) for s in seqs], np.int64)
    base = _LUT[np.frombuffer(b"".join(seqs), np.uint8)].astype(np.int64)
    first = np.cumsum(size) - size
    steps = np.maximum(size - k, 0)
    begin = np.concatenate([[0], np.cumsum(steps)])
    of = np.repeat(np.arange(len(seqs)), steps)
    at = np.arange(begin[-1]) - begin[of]
    place, code = first[of] + at, np.zeros(len(of), np.int64)
    for j in range(k + 1):
        code = (code << 2) | base[place + j]
    return of, at, (owner[of] << 32) | code, begin


def _sums(each: np.ndarray, begin: np.ndarray) -> np.ndarray:
    so_far = np.concatenate([[0], np.cumsum(each)])
    return so_far[begin[1:]] - so_far[begin[:-1]]


def _again(owner: np.ndarray, seqs: list[bytes], e: Evidence, points: np.ndarray, new: Evidence, k: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """What a pool's sums gain from steps through contexts of ``new``, and each candidate's best repair behind one, as ``refreshed`` and ``repaired``."""
    of, at, gram, begin = _walks(owner, seqs, k)
    changed = _found(np.unique(new.edge >> 2), gram >> 2)[1]
    own, there = _found(e.edge, gram)
    step = changed & there
    n = e.edge_n - _support(new.edge, new.edge_n, e.edge)  # counts before the batch
    old = _points_of(n, _totals(e.edge, n))
    delta = np.zeros(len(of), np.int64)
    delta[step] = np.where(n > 0, points - old, 0)[own[step]]
    step = np.flatnonzero(step)
    gain, base, place = [], [], []
    for b in range(4):
        other, known = _found(e.edge, (gram[step] & ~3) | b)
        more = np.where(known, points[other] - points[own[step]], 0)
        better = more > 0
        gain.append(more[better]), base.append(np.full(better.sum(), b)), place.append(step[better])
    gain, base, place = (np.concatenate(x) for x in (gain, base, place))
    order = np.lexsort((at[place], base, -gain, of[place]))
    _, best = np.unique(of[place[order]], return_index=True)
    fixed = []
    for i in order[best]:
        c, x = of[place[i]], at[place[i]] + k
        fixed.append((int(owner[c]), seqs[c][:x] + b"ACGT"[base[i] : base[i] + 1] + seqs[c][x + 1 :]))
    return _sums(delta, begin), fixed


def _ranked(e: Evidence, own: dict[tuple[int, bytes], int], cfg: Config) -> list[list[tuple[bytes, int, float]]]:
    """The best candidates of each cluster, with points and scores, of ``own``: the points of each by cluster and sequence."""
    k, every = cfg.k, list(own)
    c, size, points = (np.array(x, np.int64) for x in ([c for c, _ in every], [len(s) for _, s in every], list(own.values())))
    kinds = np.bincount(e.start >> 32, minlength=e.clusters)
    total = np.bincount(e.start >> 32, e.start_n, e.clusters)
    gram = lambda parts: (c << 32) | (_LUT[np.frombuffer(b"".join(parts), np.uint8)].reshape(-1, k).astype(np.int64) @ (1 << 2 * np.arange(k - 1, -1, -1)))
    first, last = _support(e.start, e.start_n, gram(s[:k] for _, s in every)), _support(e.end, e.end_n, gram(s[-k:] for _, s in every))
    known: dict[tuple[int, int], float] = {}
    models = [_length_model(h, cfg)[1] for h in e.hist]
    for x in zip(c.tolist(), size.tolist()):
        if x not in known:
            known[x] = models[x[0]](x[1])
    prior = np.array([known[x] for x in zip(c.tolist(), size.tolist())], float)
    head = _ln((first + 1) / (np.maximum(1, total) + np.maximum(1, kinds))[c]) + 0.15 * _ln(1 + first)
    score = (head + points * 1e-12) / (size - k + 1) + prior + 0.05 * _ln(1 + last)
    out: list[list] = [[] for _ in range(e.clusters)]
    for (o, s), b, p, x in zip(every, buckets(score).tolist(), points.tolist(), score.tolist()):
        out[o].append((-b, s, p, x))
    return [[row[1:] for row in sorted(rows)[: cfg.beam]] for rows in out]


def _listed(column: pa.ListArray, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """To which row each struct of a column's lists belongs, and the structs' fields."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), size), [flat.field(x) for x in names]


def _advanced(cfg: Config, again: bool):
    """Pools of gathered clusters after a batch; those without new reads as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = np.cumsum(batch.column("bases").to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(bases, (bases[lo - 1] if lo else 0) + TOGETHER, "right"))
                hi = min(max(hi, lo + 1), lo + 512, batch.num_rows)
                yield one(batch.slice(lo, hi - lo))
                lo = hi

    def one(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, k = rows.column("cluster_id").to_pylist(), cfg.k
        of, (seq, n, new) = _listed(rows.column("reads"), "seq", "n", "new")
        seq, n, new, of = [x.encode() for x in seq.to_pylist()], n.to_pylist(), new.to_pylist(), of.tolist()
        reads, counts, came, fresh = ([[] for _ in ids] for _ in range(4))
        for o, s, m, x in zip(of, seq, n, new):
            reads[o].append(s), counts[o].append(m)
            if x:
                came[o].append(s), fresh[o].append(x)
        e = Evidence.of_reads(reads, counts, k)
        points = _points_of(e.edge_n, _totals(e.edge, e.edge_n))
        found = {(o, s): None for o, xs in enumerate(came) for s in xs if len(s) >= k and b"N" not in s}
        of, (seq, had, score) = _listed(rows.column("pool"), "sequence", "points", "score")
        alone, out, mine = [not x for x in came], [], {}
        for row in zip(of.tolist(), seq.to_pylist(), had.to_pylist(), score.to_pylist()):
            if alone[row[0]]:
                out.append((ids[row[0]], *row[1:]))
            elif again:
                mine[row[0], row[1].encode()] = row[2]
        if mine:
            delta, fixed = _again(np.array([o for o, _ in mine], np.int64), [s for _, s in mine], e, points, Evidence.of_reads(came, fresh, k), k)
            found.update(dict.fromkeys(fixed))
            mine = {x: p + d for (x, p), d in zip(mine.items(), delta.tolist())}
        if found:
            owner = np.array([o for o, _ in found], np.int64)
            _, _, gram, begin = _walks(owner, [s for _, s in found], k)
            at, there = _found(e.edge, gram)
            whole = _sums(there, begin) == begin[1:] - begin[:-1]
            sums = _sums(np.where(there, points[at], 0) if len(points) else np.zeros(len(at), np.int64), begin)
            mine.update((x, p) for x, p, ok in zip(found, sums.tolist(), whole.tolist()) if ok)
        if mine:
            for name, best in zip(ids, _ranked(e, mine, cfg)):
                out += [(name, s.decode(), p, x) for s, p, x in best]
        return _batch(out, POOL)

    return run


def _gathered(pool: DataFrame | None, before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """``(cluster_id, bases, reads, pool)``: a row a cluster; no reads where none is new."""
    row = lambda df, new: df.select("cluster_id", "seq", "n", new.cast("long").alias("new"), F.lit(None).cast("long").alias("points"), F.lit(None).cast("double").alias("score"))
    rows = row(batch, F.col("n"))
    if before is not None:
        rows = rows.unionByName(row(before, F.lit(0)))
    if pool is not None:
        rows = rows.unionByName(pool.select("cluster_id", F.col("sequence").alias("seq"), F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("new"), "points", "score"))
    read, own = F.col("n").isNotNull() & F.col("seq").isNotNull(), F.col("points").isNotNull()
    touched = F.sum(F.when(read, F.col("new"))) > 0
    by = rows.where("cluster_id is not null").groupBy("cluster_id").agg(
        F.when(touched, F.sum(F.when(read, F.length("seq")))).alias("bases"),
        F.when(touched, F.collect_list(F.when(read, F.struct("seq", "n", "new")))).alias("reads"),
        F.collect_list(F.when(own, F.struct(F.col("seq").alias("sequence"), "points", "score"))).alias("pool"),
    )
    return by.select("cluster_id", F.coalesce("bases", F.lit(0)).cast("long").alias("bases"), "reads", "pool")


def _joined(pool: DataFrame | None, before: DataFrame | None, batch: DataFrame, folder: str, cfg: Config) -> DataFrame:
    """The pools of ``batch``'s clusters, their steps as rows."""
    k = cfg.k
    batch = _kept(batch, f"{folder}/large_batch")
    touched = batch.select("cluster_id").distinct()
    if before is not None:
        before = _kept(before.join(_shuffled(touched), "cluster_id", "left_semi"), f"{folder}/before")
    after = batch if before is None else _kept(_merged(before, batch), f"{folder}/after")
    points = _kept(_points(after, k), f"{folder}/points")
    # numbers are written, so that a row keeps its own
    numbered = lambda df, name: _kept(df.withColumn("id", F.monotonically_increasing_id()), f"{folder}/{name}")
    came = batch.select("cluster_id", F.col("seq").alias("sequence"))
    if pool is None or before is None:
        sums = _from_nothing(numbered(came.distinct(), "found"), points, k)
    else:
        mine = numbered(pool.join(_shuffled(touched), "cluster_id", "left_semi"), "mine")
        changed = edges(batch, k).select("cluster_id", "context").distinct()
        # one step through the points for all that is scored from nothing
        found = numbered(came.unionByName(repaired(mine, points, changed, k)).distinct(), "found")
        sums = _from_nothing(found, points, k).unionByName(refreshed(mine, _points(before, k), points, changed, k))
    rows = _scored(sums.groupBy("cluster_id", "sequence").agg(F.max("points").alias("points")), after, cfg)
    by = Window.partitionBy("cluster_id").orderBy(C.bucket(F.col("score")).desc(), "sequence")
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= cfg.beam).drop("_r")


def advance(pool: DataFrame | None, before: DataFrame | None, batch: DataFrame, folder: str, cfg: Config = Config(), most: int = GATHERED) -> DataFrame:
    """The pool (``POOL``) once a batch has come.

    ``before`` and ``batch``: counted reads as of ``multiplicity``, those so far (with ``pool``, None at first) and new
    ones; rows without a cluster or a sequence say nothing.  ``folder``: a new one that executors share; the batch is written there once (``batch``), the pool too, and of
    clusters with over ``most`` bases what several steps ask for.
    """
    batch = _kept(batch, f"{folder}/batch")
    reads = batch if before is None else batch.unionByName(before)
    large = _kept(reads.groupBy("cluster_id").agg(F.sum(F.length("seq")).alias("bases")).where(F.col("bases") > most).select("cluster_id"), f"{folder}/large")
    again = pool is not None and before is not None
    if large.isEmpty():
        return _kept(_gathered(pool, before, batch).mapInArrow(_advanced(cfg, again), POOL), f"{folder}/pool")
    of = lambda df, how, some: None if df is None else df.join(_shuffled(some), "cluster_id", how)
    hot = of(batch.where("seq is not null"), "left_semi", large)
    # large clusters without new reads come with their pools alone
    small = _gathered(of(pool, "left_anti", hot.select("cluster_id").distinct()), of(before, "left_anti", large), of(batch, "left_anti", large))
    known = None if before is None else of(before.where("seq is not null"), "left_semi", large)
    best = _joined(pool, known, hot, folder, cfg)
    return _kept(small.mapInArrow(_advanced(cfg, again), POOL).unionByName(best), f"{folder}/pool")
