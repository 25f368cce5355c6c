"""The candidate pool against pools made from nothing by plain walks."""

import math
import random
from collections import Counter

import pytest

from readloom.operators import pool as po
from readloom.operators.evidence import multiplicity
from readloom.schema import Config

SCHEMA = "cluster_id string, design_length int, read_sequence string"
CFG = Config(k=5, beam=4)


def batches():
    r = random.Random(3)
    out = []
    for b in range(3):
        rows = []
        for c in range(4):
            truth = "".join(random.Random(c).choice("ACGT") for _ in range(24))
            for _ in range(0 if c == b else 7):  # each batch leaves one cluster alone
                s = list(truth)
                for _ in range(2):
                    i = r.randrange(len(s))
                    s[i : i + 1] = r.choice(["", "A", "C", "G", "T", "N", "GT"])
                rows.append((str(c), 24, "".join(s)))
        out.append(rows + [("tiny", 5, "ACGTA"), ("tiny", 5, "AC"), ("tiny", 5, "ACGTA" if b else "TTTTT"), ("masked", 8, "ACGNTACG")])
    return out


class Plain:
    """All counters of one cluster, made anew from its reads."""

    def __init__(self, reads):
        k, self.edge, self.start, self.end, self.reads = CFG.k, Counter(), Counter(), Counter(), reads
        for s in reads:
            grams = [g for g in (s[i : i + k] for i in range(len(s) - k + 1)) if "N" not in g]
            self.start.update(grams[:1])
            self.end.update(grams[-1:])
            self.edge.update(g for g in (s[i : i + k + 1] for i in range(len(s) - k)) if "N" not in g)

    def points(self, gram):
        n, total = self.edge[gram], sum(self.edge[gram[:-1] + b] for b in "ACGT")
        return round((math.log((n + 1) / (total + 4)) + 0.15 * math.log1p(n)) * 1e12)

    def score(self, s):
        k = CFG.k
        steps = [s[i : i + k + 1] for i in range(len(s) - k)]
        if len(s) < k or "N" in s or any(not self.edge[x] for x in steps):
            return None
        logs = [math.log(max(1, len(x))) for x in self.reads]
        mu = sum(logs) / len(logs)
        sigma = max(0.08, math.sqrt(max(0.0, sum(x * x for x in logs) / len(logs) - mu * mu)))
        n = self.start[s[:k]]
        first = math.log((n + 1) / (max(1, sum(self.start.values())) + max(1, len(self.start)))) + 0.15 * math.log1p(n)
        return (first + sum(map(self.points, steps)) * 1e-12) / (len(s) - k + 1) - 0.375 * ((math.log(len(s)) - mu) / sigma) ** 2 + 0.05 * math.log1p(self.end[s[-k:]])

    def repair(self, s, changed):
        k, ways = CFG.k, []
        for i in range(len(s) - k):
            if s[i : i + k] in changed:
                own = self.points(s[i : i + k + 1])
                ways += [(own - self.points(s[i : i + k] + b), b, i) for b in "ACGT" if self.edge[s[i : i + k] + b] and self.points(s[i : i + k] + b) > own]
        if ways:
            _, b, i = min(ways)
            yield s[: i + k] + b + s[i + k + 1 :]


def plain_pools():
    """The last pool of each cluster, with scores."""
    reads, pools = {}, {}
    for rows in batches():
        for c in {r[0] for r in rows}:
            new = [r[2] for r in rows if r[0] == c]
            reads.setdefault(c, []).extend(new)
            p, own = Plain(reads[c]), pools.get(c, [])
            changed = {g[:-1] for g in Plain(new).edge}
            found = {*own, *new, *(x for s in own for x in p.repair(s, changed))}
            scored = [(-round(p.score(s) * 1e12), s) for s in found if p.score(s) is not None]
            pools[c] = {s: p.score(s) for _, s in sorted(scored)[: CFG.beam]}
    return pools


def test_pools_of_batches_equal_those_from_nothing(spark, tmp_path):
    pool, before = None, None
    for i, rows in enumerate(batches()):
        batch = multiplicity(spark.createDataFrame(rows, SCHEMA))
        pool = po.advance(pool, before, batch, f"file://{tmp_path}/{i}", CFG)
        before = batch if before is None else po._merged(before, batch)
    want = plain_pools()
    got = {}
    for r in pool.collect():
        got.setdefault(r.cluster_id, {})[r.sequence] = r.score
    assert {c: set(x) for c, x in got.items()} == {c: set(x) for c, x in want.items() if x}
    assert all(s == pytest.approx(want[c][p], abs=1e-9) for c, x in got.items() for p, s in x.items())
    assert set(got["tiny"]) == {"ACGTA", "TTTTT"} and "masked" not in got
    seen = {r[2] for rows in batches() for r in rows}
    assert any(s not in seen for x in got.values() for s in x)  # some candidates are no reads


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    first = multiplicity(spark.createDataFrame(batches()[0], SCHEMA))
    pool = po.advance(None, None, first, f"file://{tmp_path}/0", CFG)
    again = po.advance(pool, first, first.where("false"), f"file://{tmp_path}/1", CFG)
    assert sorted(again.collect()) == sorted(pool.collect())


def test_large_tables_are_not_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([r for b in batches() for r in b], SCHEMA)
    mult = multiplicity(rows)
    found = po._from_nothing(mult.selectExpr("cluster_id", "seq AS sequence").distinct(), po._points(mult, CFG.k), CFG.k)
    plan = po._scored(found, mult, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def advanced(spark, folder, rows, **options):
    """The pool after all batches of ``rows``."""
    pool, before = None, None
    for i, x in enumerate(rows):
        batch = multiplicity(spark.createDataFrame(x, SCHEMA))
        pool = po.advance(pool, before, batch, f"file://{folder}/{i}", CFG, **options)
        before = batch if before is None else po._merged(before, batch)
    return sorted(tuple(r) for r in pool.collect())


def test_disk_grows_with_reads_not_with_their_steps(spark, tmp_path):
    r, reads = random.Random(5), [[], []]
    for c in range(20):
        truth = [r.choice("ACGT") for _ in range(200)]
        for i in range(60):
            s = list(truth)
            s[r.randrange(200)] = r.choice("ACGT")
            reads[i % 2].append((str(c), 200, "".join(s)))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {f.getPath(): f.length() for f in (found.apply(i) for i in range(found.size()))}

    before = files()
    advanced(spark, tmp_path, reads)
    written = sum(n for f, n in files().items() if f not in before) + sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert written < 6 * sum(len(x[2]) for b in reads for x in b)


def test_gathered_and_joined_clusters_have_equal_pools(spark, tmp_path):
    rows = batches()
    gathered = advanced(spark, tmp_path / "gathered", rows)
    want = [(c, s, p, pytest.approx(x, abs=1e-12)) for c, s, p, x in gathered]
    assert advanced(spark, tmp_path / "joined", rows, most=0) == want
    # clusters grow beyond the limit with the second or third batch; "2", which has, is left alone by the third
    bases = [Counter(), Counter(), Counter()]
    for i in range(3):
        for x in {(x[0], x[2].upper()) for x in rows[i]}:
            for later in bases[i:]:
                later[x[0]] += len(x[1])
    most = 200
    assert max(bases[0].values()) <= most < bases[1]["2"] == bases[2]["2"] and bases[1]["1"] <= most < bases[2]["1"] and bases[2]["tiny"] <= most
    assert advanced(spark, tmp_path / "both", rows, most=most) == want


@pytest.mark.parametrize("most", [po.GATHERED, 0])
def test_rows_without_cluster_or_sequence_say_nothing(spark, tmp_path, most):
    mult = "cluster_id string, design_length int, seq string, n long"
    first = spark.createDataFrame([("a", 8, "ACGTACGG", 2), ("b", 8, "ACGTACGG", 1), ("a", 8, "", 1), (None, 8, "ACGTACGG", 1), ("a", 8, None, 3)], mult)
    second = spark.createDataFrame([("a", 8, "ACGTACGT", 1), ("b", 8, None, 4), (None, 8, "ACGTACGT", 1)], mult)
    pool = po.advance(None, None, first, f"file://{tmp_path}/0", CFG, most)
    after = {(r[0], r[1]): tuple(r) for r in po.advance(pool, first, second, f"file://{tmp_path}/1", CFG, most).collect()}
    assert set(after) == {("a", "ACGTACGG"), ("a", "ACGTACGT"), ("b", "ACGTACGG")}
    assert after["b", "ACGTACGG"] in [tuple(r) for r in pool.collect()]
