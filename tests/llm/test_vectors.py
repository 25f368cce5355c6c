"""Operators 11 and 12 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import vectors, whitening

DDL = "vec_id long, embedding array<float>, label int, row int"


def _cosines(rows, least=0.98):
    """vec_ids, links and components of good rows, by comparing all pairs."""
    x = np.array([np.asarray(v, float) for _, v, _, _ in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(hit, comp[None, :], 1 << 60).min(axis=1))
        if (new == comp).all():
            return ids, hit.sum(axis=1), comp
        comp = new


def _groups(rng, dim, sizes, label, noise=0.05, start=0):
    rows = []
    for n in sizes:
        c = rng.normal(size=dim)
        rows += [(start + len(rows) + i, (c + noise * rng.normal(size=dim)).astype(np.float32).tolist(), label, 0) for i in range(n)]
    return rows


@pytest.mark.parametrize("rows, numbers", [(64, 1 << 20), (2048, 1 << 20)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, rows, numbers):
    """Small blocks: labels have pivots, cells are split, and one group of near copies holds a third of the rows."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(3)
    data = _groups(rng, 16, [300, 40, 7, 2, *[1] * 250], 1)
    data += _groups(rng, 16, [1] * 90, 2, start=1000)
    data += [(5000 + i, data[0][1], 1, 0) for i in range(80)]  # exact copies
    data += [(6000 + i, (np.array(data[5][1]) * (i + 2)).tolist(), 1, 0) for i in range(5)]  # multiples
    data += [(7000 + i, data[i][1], 3, 0) for i in range(3)]  # another label
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(data, DDL).repartition(7)).collect()}
    ids, n, comp = _cosines(data)
    assert len(got) == len(ids)
    assert [got[i]["n_links"] for i in ids.tolist()] == n.tolist()
    assert [got[i]["component_id"] for i in ids.tolist()] == comp.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_bounds_hold_and_decide(monkeypatch):
    """No decision without recomputing is ever wrong, at many thresholds, and most pairs need none."""
    rng = np.random.default_rng(8)
    x = vectors.unit(rng.normal(size=(60, 24)) + 3 * rng.normal(size=24))
    for least in np.quantile(x @ x.T, np.linspace(0.02, 0.98, 25)):
        assert (vectors.linked(x, x, least) == (x @ x.T >= least)).all()
    q, s, e = vectors.quantised(x)
    off = np.abs((q * s[:, None]) @ (q * s[:, None]).T - x @ x.T)
    assert (off <= e[:, None] + e[None, :] + np.outer(e, e)).all()


def test_odd_vectors_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    v = [1.0, 2.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, v, None), (None, v, 1), (8, v, 1), (8, v, 1), (9, [-0.0, 2.0], 1), (10, [0.0, 2.0], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1e30, 2e30], 1), (13, [1e-40, 2e-40], 1), (8, [5.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id AS n_links", "label AS cell", "'x' AS vector", "1 AS node")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vectors.near_duplicates(df).collect())
    single = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11)]
    # two rows of 8 are copies; 12 and 13 point the same way; the third row of 8 and the null id are alone
    want = single + [(0, 0, 0, True), (8, 3, 8, True), (8, 3, 8, True), (12, 3, 8, False), (13, 3, 8, False), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False)]
    assert got == sorted(want)


def test_wide_and_double_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=1500)
    rows = [(i, (base + 0.03 * i * rng.normal(size=1500)).tolist(), "a") for i in range(20)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    ids, n, comp = _cosines([(*r, 0) for r in rows])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == list(zip(ids.tolist(), n.tolist(), comp.tolist()))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(empty).collect() == []
    none = whitening.whiten(empty)
    assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _whitened(x):
    """By an eigendecomposition of the covariance, and exact sums."""
    n = len(x)
    s = x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return c @ v / np.sqrt(e), e / e.sum(), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]


@pytest.mark.parametrize("dim, n", [(3, 50), (12, 400), (33, 40)])
def test_whitening_against_eigenvectors(spark, monkeypatch, dim, n):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(dim)
    data = (rng.normal(size=(n, dim)) * np.geomspace(0.3, 40, dim) + rng.normal(size=dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    data = data.astype(np.float32)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, DDL).repartition(9)
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    k = min(8, dim)
    assert len(got) == n * k
    want, share, deviation = _whitened(np.floor(1024 * data.astype(float)).astype(np.int64) + 100000)
    w = np.array([r["whitened"] for r in got]).reshape(n, k)
    sign = np.sign((w * want[:, :k]).sum(axis=0))
    assert np.abs(w - sign * want[:, :k]).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:k]], share[:k], rtol=1e-10, atol=0)
    assert [r["deviation"] for r in got[::k]] == deviation
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10


def test_small_deviations_keep_their_digits():
    """Columns that differ by 1e-9 in size: the covariance's eigenvalues have no digit of the small one, the rotations have."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(200, 3)))[0]
    v, norm = whitening.rotations(q * [1.0, 1e-5, 1e-10])
    assert np.allclose(norm, [1.0, 1e-5, 1e-10], rtol=1e-12) and np.allclose(np.abs(v), np.eye(3), atol=1e-9)
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-14)


def test_whitening_of_odd_tables(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (None, [0.0, 9.0]), (2, [3.0, 4.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS component", "'x' AS vector", "2.0 AS whitened")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)] and {r["n"] for r in got} == {4}
    assert got[0]["identity_error"] < 1e-12
    # one direction only, and no variance at all
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and len(got) == 27 and got[0]["identity_error"] < 1e-12
    one = whitening.whiten(line.where("vec_id = 3")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 3
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 2.5])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in huge if r["vec_id"] == 3) == [(3, 1, 4194304), (3, 2, 4194304)]
    assert {r["deviation"] for r in huge if r["vec_id"] < 3} == {None} and len(huge) == 6


def test_queries_read_whole_tables(spark):
    from readloom.llm import queries

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    got = queries.QUERIES["op12_whitening"](spark, d)
    assert got.count() == 8 * n and got.agg(F.max("identity_error")).first()[0] <= 1e-4
    assert queries.QUERIES["op11_vectors"](spark, d).count() == n
