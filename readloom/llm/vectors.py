"""Embedding near-duplicates (operator 11): int8 tile products with exact error bounds.

Vectors are compared where their labels and their dimensions are equal.  Equal vectors of a label are one class first, so
exact copies are never compared.  A unit vector x is stored as s * q + r with whole numbers q of -127 to 127; its residual
r has norm e, so the cosine of x and y lies within e_x + e_y + e_x * e_y of s_x * s_y * (q_x . q_y) (Cauchy-Schwarz).  A
tile multiplies the whole numbers of two blocks, which floating point does exactly; pairs that the bound leaves undecided,
and only those, are recomputed in double precision.

Which blocks meet: a label of more than a block's rows gets pivots, drawn by a hash of the vectors, about one for each
block of rows.  A vector lives in the cell of its nearest pivot.  Two linked vectors are at most ``sqrt(2 - 2 * least)``
apart, so one of them lies that near to the border between their two cells; only then is it sent to the other's cell, to
the one of the smaller number.  Any draw of pivots gives the same links.  Cells of more rows than a block are split, and
their blocks meet each other.

A tile gives one row a vector with its number of links, and one to the smallest vector it reaches within the tile, so no
pairs are written whatever the size of a group.

Defined results: null labels, null, empty or zero vectors, and vectors with null or non-finite components link with
nothing, nor do rows without a vec_id (component_id null, kept).  Rows that repeat a vec_id are rows of their own: equal
ones are copies of each other, different ones are linked by their vectors alone.  An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import map_arrow, staged
from readloom.llm.components import components

#: Numbers of a block of vectors, and the most rows of one.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 20, 2048
#: Bytes of all pivots, which go to every task: with more data blocks get more rows, not the tasks more pivots.
PIVOT_BYTES = 32 << 20
#: Covers the rounding of products in single precision.
SLACK = 1e-6


def finite(vector: str) -> Column:
    """True of vectors with components, all of them finite numbers."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, real)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``size`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1.  Powers of two come out first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers, scales and residual norms of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which unit rows of x and y have a cosine of at least ``least``."""
    (qx, sx, ex), (qy, sy, ey) = quantised(x), quantised(y)
    kind = np.float32 if x.shape[1] * 127**2 < 1 << 24 else np.float64  # sums of products stay exact
    near = qx.astype(kind) @ qy.astype(kind).T * sx.astype(kind)[:, None] * sy.astype(kind)[None, :]
    bound = (ex[:, None] + ey[None, :] + ex[:, None] * ey[None, :] + SLACK).astype(kind)
    sure = near - bound >= least
    i, j = np.nonzero((near + bound >= least) & ~sure)
    if len(i):
        rows, cols = np.unique(i), np.unique(j)
        if len(i) * 16 > len(rows) * len(cols):  # many of these pairs: one product over their rows
            part = np.zeros(near.shape, bool)
            part[np.ix_(rows, cols)] = x[rows] @ y[cols].T >= least
            sure[i, j] = part[i, j]
        else:
            for lo in range(0, len(i), step := max(1, (1 << 22) // x.shape[1])):
                a, b = i[lo : lo + step], j[lo : lo + step]
                sure[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= least
    return sure


def _roots(hit: np.ndarray, triangle: bool) -> np.ndarray:
    """For rows, then columns (``triangle``: the same vectors), the least number each one reaches through ``hit``."""
    n, m = hit.shape
    low = np.arange(n) if triangle else np.arange(n + m)
    i, j = np.nonzero(hit)
    j = j if triangle else j + n
    while len(i):
        was = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == was).all():
            break
    return low


def _tiles(least: float):
    """Tiles of one group: (node, root, links).  Side 0 is a block that meets itself; sides 1 and 2 meet each other."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key = rows.column("tile").to_numpy()
        order = np.lexsort((rows.column("node").to_numpy(), rows.column("side").to_numpy(), key))
        rows, key = rows.take(pa.array(order)), key[order]
        node, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(at, np.append(at[1:], len(key))):
            alone, mid = side[lo] == 0, lo + int(np.searchsorted(side[lo:hi], 2))
            if not alone and mid in (lo, hi):
                continue
            vectors = rows.column("vector").slice(lo, hi - lo).combine_chunks()
            x = unit(matrix(vectors, len(vectors[0])))
            if alone:
                hit = np.triu(linked(x, x, least), 1)
                full = hit | hit.T
                n = full @ copies[lo:hi]
            else:
                hit = linked(x[: mid - lo], x[mid - lo :], least)
                n = np.concatenate([hit @ copies[mid:hi], hit.T @ copies[lo:mid]])
            some = np.flatnonzero(n)
            root = _roots(hit, alone)
            out.append((node[lo:hi][some], node[lo:hi][root[some]], n[some]))
        cat = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]).astype(np.int64))
        return pa.table({"node": cat(0), "root": cat(1), "links": cat(2)})

    return run


def _router(pivots: dict[tuple, np.ndarray], least: float):
    """Adds to each class its cell and the cells of smaller number that it visits."""
    reach = np.sqrt(2 - 2 * least) + 1e-9

    def routes(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dots = x @ p.T
        home = dots.argmax(axis=1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home]
        own = dots[np.arange(len(x)), home]
        return home, (own[:, None] - dots <= reach * apart + 1e-9) & (np.arange(len(p))[None, :] < home[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, visits = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
            if pivots:
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
                    if key in pivots:
                        groups.setdefault(key, []).append(i)
                for key, rows in groups.items():
                    p = pivots[key]
                    for lo in range(0, len(rows), step := max(1, (1 << 22) // len(p))):
                        part = np.array(rows[lo : lo + step])
                        h, v = routes(unit(matrix(batch.column("vector").take(pa.array(part)), key[1])), p)
                        home[part] = h
                        for i, r in zip(part.tolist(), v):
                            visits[i] = np.flatnonzero(r)
            lists = pa.array(visits, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), lists], names=[*batch.schema.names, "cell", "visits"])

    return run


def _pivots(valid: DataFrame, rows: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of labels of more than ``rows`` vectors, about one for each ``rows``: a bounded sample by hash of the vectors."""
    large = valid.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    part = F.ceil(F.lit(2**31) / F.col("n") * F.ceil(F.col("n") / rows))
    drawn = valid.join(F.broadcast(large), ["label", "dim"]).where(F.pmod(F.xxhash64("vector", F.lit(7)), F.lit(2**31)) < part)
    found: dict[tuple, list] = {}
    for r in drawn.select("label", "dim", "vector").distinct().toLocalIterator():
        found.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    return {k: unit(np.array(sorted(v), float)) for k, v in found.items() if len(v) > 1}


def near_duplicates(table: DataFrame, least: float = 0.98) -> DataFrame:
    """``table(vec_id, embedding, label, ...)`` -> ``(vec_id, n_links, component_id, kept)``, one row for each input row."""
    kind = table.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    base = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), vector.alias("vector"))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # -0.0 and 0.0 have one hash; vectors that differ in nothing else are one class
    base = base.withColumns({"one": F.xxhash64("label", "vector"), "two": F.xxhash64(F.lit(1), "vector", "label")})
    valid = base.where("ok").select("vec_id", "label", F.size("vector").alias("dim"), "vector")

    total = valid.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    dim = total["dim"] or 1
    rows = max(64, min(BLOCK_ROWS, BLOCK_NUMBERS // dim), -(-total["n"] * dim * 8 // PIVOT_BYTES))
    pivots = _pivots(valid, rows)

    array = valid.schema["vector"].dataType.simpleString()
    made = valid.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    name = valid.schema["label"].dataType.simpleString()
    routed = map_arrow(made.select("label", "dim", "vector", "least", "copies"), _router(pivots, least), f"label {name}, dim int, vector {array}, least long, copies long, cell int, visits array<int>")
    # written once, so the numbers of the classes stay what they are
    classes = staged(routed.withColumns({"node": F.monotonically_increasing_id(), "one": F.xxhash64("label", "vector"), "two": F.xxhash64(F.lit(1), "vector", "label")}), "classes")

    key = ["label", "dim", "cell"]
    homes = classes.select(*key, F.lit(1).alias("home"), F.lit(0).alias("guest"))
    guests = classes.select("label", "dim", F.explode("visits").alias("cell"), F.lit(0).alias("home"), F.lit(1).alias("guest"))
    cells = staged(homes.unionByName(guests).groupBy(*key).agg(F.sum("home").alias("homes"), F.sum("guest").alias("guests")), "cells")
    # fewer cells have guests than there are pivots, and fewer are larger than a block than there are blocks
    large = F.broadcast(cells.where((F.col("homes") > rows) | (F.col("guests") > 0)).select(*key, F.ceil(F.col("homes") / rows).cast("int").alias("nh"), F.ceil(F.col("guests") / rows).cast("int").alias("ng")))
    places = cells.agg(F.sum(F.col("homes") * F.ceil(F.col("homes") / rows) + F.col("guests") * F.ceil(F.col("homes") / rows) + F.col("homes") * F.ceil(F.col("guests") / rows))).first()[0] or 0
    groups = max(1, -(-places // rows))

    step = lambda c: F.sequence(F.lit(0), c - 1)
    none = F.array().cast("array<struct<a:int,b:int,side:int>>")
    place = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    block = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    nh, ng = F.coalesce("nh", F.lit(1)), F.coalesce("ng", F.lit(0))
    columns = ["label", "dim", "cell", "node", "copies", "vector"]
    # a block of a cell meets itself, the cell's other ones, and the guests' blocks
    own = F.col("own")
    mine = F.transform(step(nh), lambda b: F.when(b < own, place(b, own, 2)).when(b > own, place(own, b, 1)).otherwise(place(own, own, 0)))
    theirs = F.when(ng == 0, none).otherwise(F.transform(step(ng), lambda g: place(own, -1 - g, 1)))
    at_home = classes.join(large, key, "left").withColumn("own", block(2, nh).cast("int")).select(*columns, F.inline(F.concat(mine, theirs)))
    visiting = classes.drop("cell").withColumn("cell", F.explode("visits")).join(large, key, "left").where(nh > 0).withColumn("own", block(3, ng).cast("int"))
    visiting = visiting.select(*columns, F.inline(F.transform(step(nh), lambda h: place(h, -1 - own, 2))))
    tiles = at_home.unionByName(visiting).withColumn("tile", F.xxhash64("label", "dim", "cell", "a", "b"))
    grouped = tiles.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups))).select("group", "tile", "side", "node", "copies", "vector")
    found = staged(grouped.groupBy("group").applyInArrow(_tiles(least), "node long, root long, links long"), "found")

    linked_to = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.select("node", "one", "two", "least", "copies").join(linked_to, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = staged(named, "named")
    least_of = staged(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of"), "least")
    answer = staged(named.join(least_of, "component", "left").select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("ok")), "answer")
    out = base.select("vec_id", "one", "two", "ok").join(answer, ["one", "two", "ok"], "left")
    same = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), same.alias("component_id"), F.coalesce(F.col("vec_id") == same, F.lit(True)).alias("kept"))
