import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import columns as C
from readloom.functions.distance import distances
from readloom.operators import decode as de
from readloom.operators import evaluate as ev
from readloom.operators import evidence as e
from readloom.operators import order as od
from readloom.operators import prefix
from readloom.operators import validate as va
from readloom.operators.clustered import decode_in_place
from readloom.operators.decode import buckets, decode, frontier
from readloom.plans.session import run
from readloom.schema import PREDICTION, READS, Config, parse_threads
from readloom.sources import tsv
from readloom.streaming import reads as streams
from readloom.streaming.maps import CLOSED, Clusters, state_store, stream_clusters
from readloom.streaming.reads import WHOLE

SCHEMA = "cluster_id string, design_length int, read_sequence string"


def clusters(n=12, reads=9, length=40, seed=1):
    r = random.Random(seed)
    out, truth = [], {}
    for c in range(n):
        t = "".join(r.choice("ACGT") for _ in range(length))
        truth[str(c)] = t
        for _ in range(reads):
            s = list(t)
            for _ in range(2):
                i = r.randrange(len(s))
                s[i : i + 1] = r.choice(["", "A", "C", "G", "T", "N", "GT"])
            out.append((str(c), length, "".join(s)))
    return out, truth


def sequences(spark, rows, **kw):
    return {r.cluster_id: (r.sequence, r.family) for r in decode(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_canonical(spark):
    df = spark.createDataFrame([("acgtnACGT-",), ("ä",), ("",)], "s string").select(C.canonical("s").alias("s"))
    assert [r.s for r in df.collect()] == ["ACGTNACGTN", "NN", ""]


def test_reconstructs_noisy_clusters(spark):
    rows, truth = clusters()
    got = sequences(spark, rows)
    assert sum(got[c][0] == t for c, t in truth.items()) >= 10


def test_read_order_partitions_and_ledgers_do_not_matter(spark):
    rows, _ = clusters(6)
    want = sequences(spark, rows)
    assert sequences(spark, rows[::-1]) == want
    assert sequences(spark, rows, split=0) == want
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {r.cluster_id: (r.sequence, r.family) for r in decode(df, split=3).collect()} == want


def test_ties_go_to_the_least_sequence(spark):
    rows = [("t", 12, b * 12) for b in "TGCA"] * 2
    assert sequences(spark, rows)["t"] == ("A" * 12, 1)


def test_families(spark):
    rows = [("short", 20, "ACGTA"), ("short", 20, "ACGTA"), ("short", 20, "ACGTC")]
    rows += [("masked", 12, "ACGTNACGTNAC"), ("masked", 12, "ACGTNACGTNACC")]
    near = "ACGTTGCAGGCATTACGATC"
    rows += [("near", 22, near)] * 3 + [("far", 60, near)] * 3
    got = sequences(spark, rows)
    assert got["short"] == ("ACGTA", 5)
    assert got["masked"] == ("ACGTNACGTNAC", 2)
    assert got["near"] == (near, 3)
    assert got["far"] == (near, 4)


def plain_band(reads, design, k, width, beam):
    """Limits of all steps, by walking one cluster as dictionaries."""
    edge, start = Counter(), Counter()
    for r in reads:
        good = [r[i : i + k] for i in range(len(r) - k + 1) if set(r[i : i + k]) <= set("ACGT")]
        start.update(good[:1])
        edge.update(x for x in (r[i : i + k + 1] for i in range(len(r) - k)) if set(x) <= set("ACGT"))
    steps, at, weakest, least = max(0, design - k), min(start, key=lambda x: (-start[x], x), default=None), 0, None
    for t in range(steps if at else 0):
        ways = sorted((-edge[at + b], b) for b in "ACGT" if edge[at + b])
        if not ways:
            break
        if len(ways) > 1:
            lead = Fraction(1 - ways[0][0], 1 - ways[1][0])
            if least is None or lead < least:
                least, weakest = lead, t
        at = at[1:] + ways[0][1]
    stop = min(steps, max(0, weakest - width // 2) + width)
    return start, edge, lambda t: beam if max(0, stop - width) <= t < stop else 1


def plain_frontier(reads, design, cfg, most):
    start, edge, limit = plain_band(reads, design, cfg.k, cfg.band, cfg.beam)
    total = sum(start.values())
    score = lambda n, all_, kinds: math.log((n + 1) / (all_ + kinds)) + 0.15 * math.log1p(n)
    paths = [(s, score(start[s], total, len(start))) for s in sorted(start, key=lambda s: (-start[s], s))[: limit(0)]]
    out = set()
    for t in range(most - cfg.k):
        ahead = [(p + b, c + score(edge[p[-cfg.k :] + b], sum(edge[p[-cfg.k :] + x] for x in "ACGT"), 4)) for p, c in paths for b in "ACGT" if edge[p[-cfg.k :] + b]]
        paths = sorted(ahead, key=lambda x: (-round(x[1] * 1e12), x[0]))[: limit(t)]
        out |= {p for p, _ in paths}
    return out


@pytest.mark.parametrize("band", [1, 4, 11, 100])
def test_bands_against_plain_walks(spark, band):
    rows = [(f"{n}-{c}", n - n % 3, s) for n in (7, 23, 40) for c, _, s in clusters(8, length=n, seed=n)[0]]
    rows += [("none", 12, "ACGTNACGTNAC"), ("short", 4, "ACGTACGTAC"), ("one", 30, "A" * 30)]
    cfg = Config(k=5, beam=4, band=band)
    found = {}
    for r in frontier(spark.createDataFrame(rows, SCHEMA), cfg).collect():
        found.setdefault(r.cluster_id, set()).add(r.sequence)
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        most = max(map(len, found.get(c, {"": 0})), default=0)
        assert found.get(c, set()) == plain_frontier([r[2] for r in own], own[0][1], cfg, max(most, cfg.k)), c
    assert sequences(spark, rows, cfg=cfg, split=0) == sequences(spark, rows, cfg=cfg)


def test_a_band_over_all_steps_is_the_whole_beam(spark):
    rows, _ = clusters(12)
    whole, banded = sequences(spark, rows), sequences(spark, rows, cfg=Config(band=40))
    assert {c: x for c, x in whole.items() if x[1] < 3} == {c: x for c, x in banded.items() if x[1] < 3} and len(whole) == len(banded)
    assert Config.parse("kmc_k9_b8_lognormal_band12") == Config(beam=8, band=12) and Config(beam=8, band=12).name == "kmc_k9_b8_lognormal_band12"


@pytest.mark.parametrize("k", [5, 12, 15])
def test_context_sizes(spark, k):
    rows, truth = clusters(4, reads=15)
    got = sequences(spark, rows, cfg=Config(k=k))
    assert set(got) == set(truth) and all(s for s, _ in got.values())


def test_empty_table(spark):
    assert decode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ledger_merge(spark):
    rows, _ = clusters(3)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", i long")
    whole = {tuple(r) for r in e.ledger(e.multiplicity(df), 9).collect()}
    parts = [e.ledger(e.multiplicity(df.where(F.col("i") % 3 == j)), 9) for j in range(3)]
    assert {tuple(r) for r in e.merge(*parts).collect()} == whole


def test_buckets():
    assert len(set(buckets(np.array([0.0, -0.0, 0.49e-12, -0.49e-12])))) == 1
    assert list(buckets(np.array([0.51e-12, -0.51e-12]))) == [1, -1]
    for bad in (np.nan, np.inf, -np.inf):
        with pytest.raises(ValueError):
            buckets(np.array([bad]))


def test_edit_distances(spark):
    pairs = [("a", "", ""), ("b", "AN", "AA"), ("c", "acgt", "ACGT"), ("d", "A" * 65, "A" * 64), ("e", "A" * 64, "T" * 64)]
    got = {r.key: r.edit_distance for r in ev.edit_distances(spark.createDataFrame(pairs, "key string, a string, b string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 4, "d": 1, "e": 64}
    with pytest.raises(Exception, match="expected a key"):
        ev.edit_distances(spark.createDataFrame([("", "A", "A")], "key string, a string, b string")).collect()


def test_accuracy_may_be_negative(spark):
    pred = spark.createDataFrame([("1", "ACGTACGT")], "cluster_id string, reconstructed_sequence string")
    truth = spark.createDataFrame([("1", "A")], "cluster_id string, sequence string")
    assert ev.evaluate(pred, truth).first().normalized_accuracy == -6.0


def test_configuration_names():
    assert Config.parse("kmc_k9_b16_lognormal") == Config() and Config().name == "kmc_k9_b16_lognormal"
    for bad in ("kmc_k9x_b16_lognormal", "kmc_k9_b16x_lognormal", "kmc_k4_b16_lognormal", "kmc_k16_b4_median_band", ""):
        with pytest.raises(ValueError):
            Config.parse(bad)
    assert parse_threads("4,1,4") == [4, 1]
    with pytest.raises(ValueError):
        parse_threads(",")


def test_safe_name(spark):
    got = spark.createDataFrame([("a b/c",), ("..",), ("_x-1.",)], "s string").select(C.safe_name(F.col("s")).alias("s"))
    assert [r.s for r in got.collect()] == ["a_b_c", "run", "x-1"]


def test_orders_are_pythons_permutations(spark):
    rows = spark.createDataFrame([("a",)] * 7 + [("b",)] * 3, "cluster_id string")
    order = od.orders(rows, "seed", "ds")
    for r in order.collect():
        want = list(range(7 if r.cluster_id == "a" else 3))
        random.Random(int(r.entropy_bits, 16)).shuffle(want)
        assert r.permutation == want
    assert od.broken(order, rows).count() == 0
    assert od.broken(order, rows.limit(6)).count() >= 1
    placed = od.replay(rows.withColumn("i", F.monotonically_increasing_id()), order, "i")
    assert sorted(r.arrival for r in placed.where("cluster_id = 'a'").collect()) == list(range(1, 8))


def write_session(folder: Path, rows, truth):
    folder.mkdir(parents=True, exist_ok=True)
    lines = ["\t".join(READS.fieldNames())] + [f"ds\t{c}\tr{i}\t{s}\tx\t!\t{n}" for i, (c, n, s) in enumerate(rows) if s]
    (folder / "reads.tsv").write_text("\n".join(lines) + "\n")
    if truth:
        (folder / "truth.tsv").write_text("row_key\tdataset_id\treference_sequence\n" + "".join(f"ds|{c}|9\tds\t{s}\n" for c, s in truth.items()))


def test_session(spark, tmp_path):
    rows, truth = clusters(5)
    write_session(tmp_path / "data", rows, truth)
    out = Path(run(spark, str(tmp_path / "data"), str(tmp_path / "out"), aim=True, threads=[1, 2], seeds=["a", "b"]))
    table = [x.split("\t") for x in (out / "SUMMARY.tsv").read_text().splitlines()]
    at = {c: i for i, c in enumerate(table[0])}
    assert sorted(r[at["round"]] for r in table[1:]) == ["1", "1", "2", "2", "MEAN", "MEAN"]
    means = [r for r in table[1:] if r[at["round"]] == "MEAN"]
    assert all((r[at["seed"]], r[at["pred"]], r[at["metric_closure"]]) == ("NA", "NA", "PASS_ALL_ROUNDS") for r in means)
    for r in means:
        of = [float(x[at["accuracy"]]) for x in table[1:] if x[at["threads"]] == r[at["threads"]] and x[at["round"]] != "MEAN"]
        assert r[at["accuracy"]] == f"{sum(of) / len(of):.12g}" and r[at["exact_count"]] == table[1][at["exact_count"]]
    preds = {(out / r[at["pred"]]).read_text() for r in table[1:] if r[at["round"]] != "MEAN"}
    assert len(preds) == 1 and (out / "RUN_MANIFEST.json").exists()
    assert tsv.read_predictions(spark, str(out / "threads_1_round_1" / "pred.tsv")).count() == 5
    assert len((out / "threads_1_round_1" / "evaluation.tsv").read_text().splitlines()) == 6
    assert len((out / "threads_1_round_1" / "STOP_POINT_WALL.tsv").read_text().splitlines()) == 6
    total = [x.split("\t") for x in (out / "threads_1_round_1" / "RUN_METRICS.tsv").read_text().splitlines()]
    assert dict(zip(*total))["status"] == "PASS" and dict(zip(*total))["consumed_reads"] == str(len(rows))
    assert float(dict(zip(*total))["task_wall_seconds"]) > 0 and dict(zip(*total))["clusters"] == "5"
    head, *tasks = [x.split("\t") for x in (out / "threads_2_round_1" / "WORKER_LEDGER.tsv").read_text().splitlines()]
    assert head == ["worker_id", "clusters", "reads_consumed", "seconds"] and len({x[0] for x in tasks}) == len(tasks)
    assert sum(int(x[1]) for x in tasks) == 5 and sum(int(x[2]) for x in tasks) == len(rows) and all(float(x[3]) > 0 for x in tasks)
    lines = sorted((out / "threads_1_round_1" / "pred.tsv").read_text().splitlines()[1:])
    ids = {x.split("\t")[2]: x.split("\t")[7] for x in lines}
    pred = tsv.read_predictions(spark, str(out / "threads_1_round_1" / "pred.tsv"))
    assert ev.canonical_digest(pred) == hashlib.sha256("".join(f"{k}\t{ids[k]}\n" for k in sorted(ids)).encode()).hexdigest()
    # truth, quality and provenance play no part in predictions
    write_session(tmp_path / "other", rows, {c: "T" * 40 for c in truth})
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    again = Path(run(spark, str(tmp_path / "other"), str(tmp_path / "out"), seeds=["z"], digest=True))
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    assert not [p for p in again.rglob(".*") if p.name not in (".orders",) and not p.name.endswith(".crc")]
    assert (again / f"threads_{spark.sparkContext.defaultParallelism}_round_1" / "pred.tsv").read_text() in preds


def test_failed_sessions_are_marked(spark, tmp_path):
    rows, truth = clusters(3)
    truth.pop("0")
    write_session(tmp_path / "data", rows, truth)
    with pytest.raises(ValueError, match="truth and input differ"):
        run(spark, str(tmp_path / "data"), str(tmp_path / "out"))
    write_session(tmp_path / "none", rows, None)
    with pytest.raises(ValueError, match="needs truth"):
        run(spark, str(tmp_path / "none"), str(tmp_path / "out"), aim=True)
    assert len(list((tmp_path / "out").glob("*.failed"))) == 2


def test_malformed_rows(spark, tmp_path):
    head = "\t".join(READS.fieldNames())
    good = "ds\tc\tr1\tACGTACGTACGT\t\t\t12"
    for bad, rule in (("ds\tc\tr2\tACGT", "malformed_row"), ("ds\tc\tr1\tACGTACGTACGT\t\t\t12", "duplicate_read_id"), ("ds\tc\tr2\tACGTACGTACGT\t\t\tx", "length_not_integer"), ("d2\tc\tr2\tACGTACGTACGT\t\t\t12", "not_one_dataset"), ("ds\tc\tr2\tACGTACGTACGT\t\t\t13", "length_varies")):
        with gzip.open(tmp_path / "reads.tsv.gz", "wt") as f:
            f.write("\n".join([head, good, bad]) + "\n")
        found = {r.rule for r in va.violations(tsv.read_reads(spark, str(tmp_path / "reads.tsv.gz"))).collect()}
        assert rule in found, (bad, found)
    (tmp_path / "head.tsv").write_text("cluster_id\tx\n")
    with pytest.raises(ValueError, match="header"):
        tsv.read_reads(spark, str(tmp_path / "head.tsv"))
    (tmp_path / "crlf.tsv").write_bytes(head.encode() + b"\r\n")
    with pytest.raises(ValueError):
        tsv.read_reads(spark, str(tmp_path / "crlf.tsv"))


def test_clusters_that_come_twice_fail_a_session(spark, tmp_path):
    rows, _ = clusters(3)
    write_session(tmp_path / "data", rows + [rows[0]], None)
    with pytest.raises(ValueError, match="not contiguous"):
        run(spark, str(tmp_path / "data"), str(tmp_path / "out"))


def test_blocks_over_partitions(spark):
    ids = list("aaabbbbbbbbbbbcaadd") + [None, None, "a"]
    want = {}
    for i, x in enumerate(ids):
        want[x] = want.get(x, 0) + (i == 0 or ids[i - 1] != x)
    for parts in (1, 3, 7, 22):
        df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "cluster_id string, at long").repartition(parts)
        assert {r.cluster_id: r.n_blocks for r in va.blocks(df, "at").collect()} == want


def test_prediction_files_are_checked(spark, tmp_path):
    head = "\t".join(PREDICTION.fieldNames())
    good = "d|c|1\td\tc\t1\t1\t1\t1\tACGT\tcompleted_nonempty"
    path = tmp_path / "pred.tsv"
    path.write_text(f"{head}\n{good}\n")
    assert tsv.read_predictions(spark, str(path)).count() == 1
    for text, why in (("", "empty_predictions"), (good + "\n" + good + "\n", "duplicate_cluster_id"), (good + "\nx\ty\n", "malformed_row"), (good + "\n" + good.replace("\tc\t", "\t\t") + "\n", "empty_cluster_id")):
        path.write_text(f"{head}\n{text}")
        with pytest.raises(ValueError, match=why):
            tsv.read_predictions(spark, str(path))


def test_header_as_data_and_keyed_truth(spark, tmp_path):
    path = tmp_path / "truth.tsv"
    path.write_text("row_key\tdataset_id\treference_sequence\nds|a|1\tds\tACGT\nshort\tds\tA\nrow_key\tdataset_id\treference_sequence\n")
    rows = tsv.read_truth(spark, str(path)).collect()
    assert [(r.cluster_id, r.sequence) for r in rows] == [("a", "ACGT"), (None, "A"), (None, "reference_sequence")]
    assert {r.rule for r in va.truth_violations(tsv.read_truth(spark, str(path))).collect()} == {"empty_cluster_id", "duplicate_cluster_id"}


def test_pairs(spark, tmp_path):
    path = tmp_path / "pairs.tsv"
    path.write_bytes("k\t\t\n\nm\tAN\tAA\nu\tä\ta\n".encode())
    got = {r.key: (r.a_length, r.b_length, r.edit_distance) for r in ev.edit_distances(tsv.read_pairs(spark, str(path))).collect()}
    assert got == {"k": (0, 0, 0), "m": (2, 2, 1), "u": (2, 1, 2)}  # bytes
    for bad in (b"k\ta\tb\r\n", b"k\ta\n", b"k\ta\tb\tc\n", b"\ta\tb\n"):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="expected a key"):
            tsv.read_pairs(spark, str(path)).collect()


def test_equal_starts_contexts_and_symmetric_ends(spark):
    """Ties of every place go to the least sequence (fixed expectations)."""
    rows = [("starts", 12, b * 12) for b in "ACGT"] * 2
    rows += [("ends", 12, "ACGTACGTACG" + b) for b in "TGCA"] * 2
    got = sequences(spark, rows)
    assert (got["starts"][0], got["ends"][0]) == ("AAAAAAAAAAAA", "ACGTACGTACGA")
    for threads in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(threads))
        assert sequences(spark, rows[::-1]) == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_matrix(spark):
    a = spark.createDataFrame([("d1", 1, 3), ("d1", 2, 4), ("d2", 1, 5), ("d9", 1, 0)], "dataset string, threads int, n int")
    b = spark.createDataFrame([("d1", 1, 30), ("d2", 1, 50)], "dataset string, threads int, n int")
    assert {tuple(r) for r in ev.matrix({"old": a, "new": b}, ["dataset", "threads"]).collect()} == {("d1", 1, 3, 30), ("d2", 1, 5, 50)}
    axes = [spark.createDataFrame([("d1",), ("d2",)], "dataset string"), spark.createDataFrame([(1,), (2,)], "threads int")]
    assert {tuple(r) for r in ev.matrix_differences(a, axes).collect()} == {("d2", 2, "missing"), ("d9", 1, "extra")}


def test_differences_and_fingerprint(spark):
    a = spark.createDataFrame([("1", "A"), ("2", "C"), ("3", "G")], "cluster_id string, reconstructed_sequence string")
    b = spark.createDataFrame([("3", "T"), ("2", "C"), ("4", "G")], "cluster_id string, reconstructed_sequence string")
    assert {tuple(r) for r in ev.differences(a, b).collect()} == {("1", "missing"), ("3", "changed"), ("4", "extra")}
    assert ev.fingerprint(a).first() == ev.fingerprint(a.orderBy(F.desc("cluster_id"))).first() != ev.fingerprint(b).first()


def _full_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_against_full_tables():
    """Random pairs about the words' borders, near and far ones, with and without limits."""
    rng = random.Random(11)
    some = lambda n: bytes(rng.choice(b"ACGT\xff\x00") for _ in range(n))
    pairs = [(b"", b""), (b"", b"A"), (b"A" * 65, b"A" * 64), (b"A" * 64, b"T" * 64), (b"AN", b"AA"), (b"acgt", b"ACGT")]
    for _ in range(256):
        a = some(rng.choice([0, 1, 2, 30, 63, 64, 65, 127, 128, 129, 200, 260]))
        b = bytearray(a)
        for _ in range(rng.choice([0, 1, 3, 20])):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = some(rng.randint(0, 2))
        pairs.append((a, bytes(b)) if rng.random() < 0.7 else (a, some(rng.choice([0, 1, 64, 100, 190]))))
    left, right = zip(*pairs)
    want = [_full_table(a, b) for a, b in pairs]
    assert distances(left, right) == want == distances(right, left)
    for most in (0, 1, 2, 7, 40, 64, 65, 150, 400):
        assert distances(left, right, most) == [d if d <= most else -1 for d in want]
    assert distances([None, b"a", None], [b"a", None, None]) == [None] * 3 and distances([], []) == []


def test_distance_of_long_sequences():
    """Two of 100,000 bases with known edits, alone and among short ones: seconds, where a full table has 10^10 cells."""
    rng = random.Random(5)
    a = bytes(rng.choice(b"ACGT") for _ in range(100_000))
    b = a[:1000] + b"NN" + a[1000:50_000] + a[50_003:99_000] + b"N" + a[99_001:]
    assert distances([a, b"AC"], [b, b"AG"], 50) == [6, 1] and distances([a], [b], 5) == [-1]
    assert distances([a], [b]) == [6]


def test_packed_counters_equal_single_ones(spark):
    """Reads about the packs' length, with N anywhere, for the least and the largest context."""
    rng = random.Random(7)
    reads = [("c%d" % (i % 3), 40, "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.choice([1, 4, 5, 6, 14, 15, 16, 30, 31, 32, 33, 47, 62, 63, 90])))) for i in range(400)] + [("n", 40, "N" * 70), ("n", 40, "ACG")]
    mult = e.multiplicity(spark.createDataFrame(reads, "cluster_id string, design_length int, read_sequence string"))
    for k in (5, 9, 15):
        want = Counter()
        for cluster, _, seq in reads:
            whole = [i for i in range(len(seq) - k + 1) if "N" not in seq[i : i + k]]
            value = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
            for i in whole:
                want[cluster, 0, value(seq[i : i + k])] += 1
                if i + k < len(seq) and seq[i + k] != "N":
                    want[cluster, 1, value(seq[i : i + k + 1])] += 1
                    want[cluster, 2, value(seq[i : i + k])] += 1
            if whole:
                want[cluster, 3, value(seq[whole[0] : whole[0] + k])] += 1
                want[cluster, 4, value(seq[whole[-1] : whole[-1] + k])] += 1
        assert {(r.cluster_id, r.kind, r.code): r.support for r in e.ledger(mult, k).collect()} == want
        own = e.counters(mult, k, ("edge",), reads=True).where("kind = 5").collect()
        assert {(r.cluster_id, r.seq): r.support for r in own} == Counter((c, s) for c, _, s in reads)


def _reads_file(path, rows):
    """A file of reads of ``(cluster, length, sequence)`` in their order."""
    lines = ["\t".join(READS.fieldNames())] + ["\t".join(["d", c, str(i), s, "", "", str(n)]) for i, (c, n, s) in enumerate(rows)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def cut(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def test_decoding_in_place_gives_the_same_for_any_cuts(spark, tmp_path, cut):
    rows, _ = clusters(n=30, reads=8)
    rows += [("hot", 40, s) for _, _, s in clusters(n=1, reads=400, seed=3)[0]] + [("one", 40, "ACGTACGTAC")]
    path = _reads_file(tmp_path / "reads.tsv", rows)
    want = sequences(spark, rows)
    got = lambda **kw: {r.cluster_id: (r.sequence, r.family) for r in decode_in_place(spark, path, **kw).collect()}
    size = (tmp_path / "reads.tsv").stat().st_size
    for parts in (1, 3, 50):
        cut(size // parts + 1)
        assert got() == want
    assert got(split=20) == want  # the hot cluster goes over many blocks and is decoded from its ledger
    cut(1 << 27)
    shuffled = decode_in_place(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert shuffled.split("Union")[1].split("\n")[1].strip().startswith(":- MapInArrow") and "Exchange" not in shuffled.split("\n+- ")[0]


def test_clusters_that_are_not_one_run_are_found(spark, tmp_path, cut):
    rows, _ = clusters(n=12, reads=6)
    bad = {
        "twice in a block": rows + rows[:2],
        "twice, far apart": rows[:6] + rows[6:] * 1 + [rows[0]],
        "two lengths": rows[:6] + [(rows[6][0], 41, rows[6][2])] + rows[7:],
    }
    for name, x in bad.items():
        for parts in (1, 5, 20):
            path = _reads_file(tmp_path / f"{name}{parts}.tsv", x)
            cut((tmp_path / f"{name}{parts}.tsv").stat().st_size // parts + 1)
            with pytest.raises(Exception, match="comes twice|not one run|several design"):
                decode_in_place(spark, path).collect()
    for line in ("d\tc\t1\tACGT\t\t\tx", "d\tc\t1\tACGT\t\t", "d\tc\t1\t\t\t\t40"):
        (tmp_path / "bad.tsv").write_text("\t".join(READS.fieldNames()) + "\n" + line + "\n")
        with pytest.raises(Exception, match="not a read"):
            decode_in_place(spark, str(tmp_path / "bad.tsv")).collect()


@pytest.mark.parametrize("chunk", [4, 2048])
def test_prefixes_equal_their_reads_alone(spark, monkeypatch, chunk):
    """Chunks and blocks smaller than a cluster, repeated reads, reads without grams, exact and other lengths."""
    monkeypatch.setattr(prefix, "BLOCK", 3)
    rows, _ = clusters(n=4, reads=11)
    rows += [("odd", 12, s) for s in ("ACG", "NNNNNNNNNNNN", "ACGTACGTACGT", "ACGTACGTACGA", "ACGTACGTACGA", "acgtacgtacgt", "ACG", "TTTTTTTTTTTTTTTT", "TTTTTTTTTTTTTTTT", "TTTTTTTTTTTTTTTT")]
    df = spark.createDataFrame([(c, n, s, i) for i, (c, n, s) in enumerate(rows)], SCHEMA + ", at int").withColumn("read_id", F.col("at").cast("string"))
    got = {(r.cluster_id, r.arrival): (r.sequence, r.family) for r in prefix.prefix_decode(df.repartition(3), "at", chunk=chunk).collect()}
    heads, seen = [], Counter()
    by = {}
    for c, n, s in rows:
        seen[c] += 1
        by.setdefault(c, []).append(s)
        heads += [(f"{c}/{seen[c]}", n, x) for x in by[c]]
    want = sequences(spark, heads)
    assert {f"{c}/{i}": x for (c, i), x in got.items()} == want


def test_prefixes_of_clusters_share_blocks(monkeypatch):
    """Only prefixes without a path of the design length are decoded as clusters of their own; all as their reads alone."""
    rows, _ = clusters(n=5, reads=30)
    rows += [("odd", 12, s) for s in ("ACG", "ACGTACGTAC", "ACGTNCGTACGTA", "ACGTACGTACGTAC", "", "ACGTACGTACGT", "ACGTACGTACGA", "ACGAACGTACGT")]
    by: dict = {}
    for c, n, s in rows:
        by.setdefault((c, n), []).append(re.sub("[^ACGT]", "N", s.upper()))
    lists = lambda: [[{"arrival": i, "seq": s} for i, s in enumerate(x, 1)] for x in by.values()]
    grams = pa.list_(pa.struct([("kind", pa.int32()), ("code", pa.int64()), ("support", pa.int64())]))
    reads = pa.array(lists(), pa.list_(pa.struct([("arrival", pa.int32()), ("seq", pa.string())])))
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in by]), pa.array([n for _, n in by], pa.int32()), reads, pa.array([None] * len(by), grams), pa.array([None] * len(by), grams)], names=["cluster_id", "design_length", "reads", "grams", "lengths"])
    alone = []

    class Counted(prefix.Beams):
        def __init__(self, e, *more):
            alone.append(e.clusters)
            super().__init__(e, *more)

    for cfg in (Config(), Config(k=5, beam=4, prior="median_band"), Config(band=6)):
        monkeypatch.setattr(prefix, "Beams", Counted)
        alone.clear()
        got = [r for b in prefix._chunks(cfg)(iter([batch])) for r in b.to_pylist()]
        if not cfg.band:
            assert sum(alone) < len(rows) / 4 and len(alone) == 1
        monkeypatch.undo()
        heads = [(c, n, i, x[:i]) for (c, n), x in by.items() for i in range(1, len(x) + 1)]
        counted = [Counter(x) for *_, x in heads]
        want = de.decode_lists([c for c, *_ in heads], [n for _, n, *_ in heads], [[s.encode() for s in x] for x in counted], [list(x.values()) for x in counted], cfg).to_pylist()
        assert [(r["cluster_id"], r["arrival"], r["sequence"], r["family"]) for r in got] == [(r["cluster_id"], h[2], r["sequence"], r["family"]) for r, h in zip(want, heads)]


@pytest.fixture
def remote(spark, tmp_path):
    """A path that only Hadoop's file systems resolve, and the local folder behind it."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    conf.set("fs.viewfs.impl.disable.cache", "true")
    return "viewfs://kept/in", tmp_path


def test_sessions_on_another_file_system(spark, remote):
    """Truth is found there, results are published there, and nothing of it is written elsewhere."""
    url, local = remote
    rows, truth = clusters(4)
    write_session(local / "data", rows, truth)
    out = run(spark, f"{url}/data", f"{url}/out", aim=True, threads=[2], seeds=["a"])
    folder = local / "out" / out.rsplit("/", 1)[1]
    table = [x.split("\t") for x in (folder / "SUMMARY.tsv").read_text().splitlines()]
    assert dict(zip(*table))["evaluated_clusters"] == "4" and out.startswith(url)
    assert '"COMPLETED"' in (folder / "RUN_STATUS.json").read_text()
    pred = [x.split("\t")[2] for x in (folder / "threads_2_round_1" / "pred.tsv").read_text().splitlines()]
    assert pred == ["cluster_id", "0", "1", "2", "3"]


def test_input_that_changes_fails_a_session(spark, remote, monkeypatch):
    url, local = remote
    rows, _ = clusters(3)
    write_session(local / "data", rows, None)
    whole = ev.totals

    def changed(pred):
        write_session(local / "data", rows[::-1], None)
        return whole(pred)

    monkeypatch.setattr(ev, "totals", changed)
    with pytest.raises(ValueError, match="changed while"):
        run(spark, f"{url}/data", f"{url}/out", seeds=["a"], digest=True)
    assert [p.name.rsplit(".", 1)[1] for p in (local / "out").iterdir() if not p.name.startswith(".")] == ["failed"]


def test_nothing_is_visible_before_the_rename(spark, tmp_path, monkeypatch):
    from readloom.sources import files

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(files, "move", broken)
    with pytest.raises(OSError, match="lost"):
        tsv.write_rows(spark.range(3), str(tmp_path / "x.tsv"))
    assert all(p.name.startswith(".") for p in tmp_path.iterdir())
    monkeypatch.undo()
    tsv.write_rows(spark.range(3).selectExpr("3 - id AS n", "IF(id = 1, NULL, 0.1 * id) AS x"), str(tmp_path / "x.tsv"), "n")
    assert (tmp_path / "x.tsv").read_text() == "n\tx\n1\t0.2\n2\tNA\n3\t0.0\n"


def _into(spark, source, rows, name):
    spark.createDataFrame(rows, SCHEMA + ", total_reads long").coalesce(1).write.parquet(f"{source}/{name}")


def _streamed(spark, source, out):
    """Runs the stream over what is new, a file a batch; its progress."""
    stream = spark.readStream.schema(SCHEMA + ", total_reads long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*/*.parquet")
    with state_store(spark):
        query = stream_clusters(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"] or p["stateOperators"]]


def test_state_in_maps_over_restarts(spark, tmp_path):
    rows, _ = clusters(n=6, reads=10)
    total = [(*r, 10) for r in rows]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = sequences(spark, rows)
    got = lambda: sorted((r.cluster_id, r.sequence, r.family, r.total_reads, r.complete) for r in spark.read.parquet(out).collect())
    _into(spark, source, [r for i, r in enumerate(total) if i % 10 < 8], "a")  # eight of ten reads of each
    _streamed(spark, source, out)
    assert got() == []
    _into(spark, source, [r for i, r in enumerate(total) if r[0] == "0" and i % 10 >= 8], "b")
    progress = _streamed(spark, source, out)  # another query, from the checkpoint
    assert [x[0] for x in got()] == ["0"]
    # what a batch writes is its own: two reads and the cluster's value, and not the eight of five other clusters
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress) <= 8
    _into(spark, source, [r for i, r in enumerate(total) if r[0] != "0" and i % 10 >= 8] + total[:3], "c")  # late reads of a closed cluster
    _streamed(spark, source, out)
    assert got() == sorted((c, s, f, 10, True) for c, (s, f) in want.items())


class _State:
    """A map or a value of the state, which counts what is written."""

    def __init__(self):
        self.rows, self.last, self.written = {}, None, 0

    def updateValue(self, key, value):
        self.rows[key], self.written = value, self.written + 1

    def getValue(self, key):
        return self.rows.get(key)

    def iterator(self):
        return iter(list(self.rows.items()))

    def clear(self):
        self.rows.clear()

    def get(self):
        return self.last

    def update(self, value):
        self.last = value


def test_a_cluster_that_comes_whole_is_not_written_to_its_map():
    """Nor are the reads that close it; what goes out are its reads, which are decoded with other clusters'."""
    from types import SimpleNamespace

    for batches, written in (([["AC", "AC", "GT"]], 0), ([["AC", "GT"], ["AC"]], 2)):
        one, about = _State(), _State()
        state = Clusters(None)
        state.init(SimpleNamespace(getMapState=lambda *_: one, getValueState=lambda *_: about))
        out = [x for b in batches for x in state.handleInputRows(("c",), iter([pd.DataFrame({"design_length": 2, "total_reads": 3, "seq": b})]), None)]
        assert [x.to_dict("records") for x in out] == [[{"cluster_id": "c", "design_length": 2, "total_reads": 3, "seqs": ["AC", "GT"], "counts": [2, 1], "complete": True}]]
        assert one.written == written and not one.rows and about.last[3]


def test_tasks_for_grams_grow_with_the_reads(spark, monkeypatch):
    """With many reads their number decides, not their bytes; one large cluster is dealt to several tasks too."""
    monkeypatch.setattr(e, "A_TASK", 10)
    rows, _ = clusters(n=2, reads=250)
    df = spark.createDataFrame(rows, SCHEMA)
    many, mult = e.tasks(df), e.multiplicity(df)
    assert many == 50
    place = e._together(mult, many).select("cluster_id", "seq", F.spark_partition_id().alias("p")).collect()
    assert max(Counter(r.p for r in place).values()) < 40 and len({r.p for r in place}) > 20
    counted = lambda x: sorted(map(tuple, x.collect()))
    assert counted(e.edges(mult, 9, many)) == counted(e.edges(mult, 9))
    assert counted(e.ledger(mult, 9, many)) == counted(e.ledger(mult, 9))
    assert sequences(spark, rows, split=0) == sequences(spark, rows)


def test_clusters_of_a_batch_are_decoded_together(spark, monkeypatch):
    rows, _ = clusters(n=6, reads=10)
    want = sequences(spark, rows)
    by: dict = {}
    for c, n, s in rows:
        by.setdefault(c, Counter())[re.sub("[^ACGT]", "N", s)] += 1
    whole = spark.createDataFrame([(c, 40, 10, list(x), list(x.values()), c != "3") for c, x in by.items()], WHOLE).coalesce(1)
    for most in (5, 25, 20_000):
        monkeypatch.setattr(streams, "TOGETHER", most)
        got = streams.decode_whole(whole, Config()).collect()
        assert sorted((r.cluster_id, r.sequence, r.family, r.total_reads, r.complete) for r in got) == sorted((c, *x, 10, c != "3") for c, x in want.items())


def test_clusters_that_never_end_are_sent_out_once(spark, tmp_path):
    rows, _ = clusters(n=2, reads=6)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _into(spark, source, [(*r, 99 if r[0] == "1" else 6) for r in rows], "a")
    found = lambda: sorted((r.cluster_id, r.total_reads, r.complete) for r in spark.read.schema(CLOSED).parquet(out).collect())
    stream = spark.readStream.schema(SCHEMA + ", total_reads long").parquet(f"{source}/*/*.parquet")
    for wait in (60, 3):  # from the checkpoint a second time, when nothing is left to send out
        with state_store(spark):  # timers keep a stream at work, so this one is stopped
            query = stream_clusters(stream, patience_ms=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(processingTime="200 milliseconds").start()
        end = time.time() + wait
        while time.time() < end and (wait == 3 or not Path(out).exists() or len(found()) < 2):
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None and found() == [("0", 6, True), ("1", 6, False)]


def test_order_of_clusters(spark, tmp_path):
    reads = spark.createDataFrame([(c, i) for i, c in enumerate("aabbbcdde")], "cluster_id string, at long").repartition(5)
    pack = lambda s: spark.createDataFrame([(c, 10 * i - 7) for i, c in enumerate(s)], "cluster_id string, at long").repartition(3)
    found = lambda s, i: {(r.cluster_id, r.read_ordinal, r.order_ordinal, r.state) for r in od.misplaced(pack(s), reads, "at", str(tmp_path / str(i))).collect()}
    assert found("abcde", 0) == set()
    assert found("abdce", 1) == {("c", 2, 3, "moved"), ("d", 3, 2, "moved")}
    assert found("abcd", 2) == {("e", 4, None, "missing")}
    assert found("abcdex", 3) == {("x", None, 5, "extra")}
    assert found("abcdea", 4) == {("a", 0, 5, "repeated")}
    many = spark.range(10_000).selectExpr("id * id AS at", "id").repartition(7)
    rows = od.numbered(many, "at", str(tmp_path / "many"))
    assert rows.where("ordinal = id").count() == 10_000
    assert od.numbered(many.limit(0), "at", str(tmp_path / "none")).count() == 0


def test_scores_are_those_of_sql():
    """Bit by bit: the last one decides between paths of equal scores."""
    import duckdb

    from readloom.operators import decode as de

    r = np.random.default_rng(5)
    n, total = r.integers(1, 500, 4000), r.integers(500, 5000, 4000)
    got = de._ln((n + 1.0) / (total + 4.0)) + 0.15 * de._ln(1.0 + n)
    sql = "SELECT ln((n + 1.0) / (t + 4.0)) + 0.15 * ln(1.0 + n) FROM (SELECT unnest($1::BIGINT[]) AS n, unnest($2::BIGINT[]) AS t)"
    assert got.tolist() == [x for (x,) in duckdb.execute(sql, [n.tolist(), total.tolist()]).fetchall()]
    sums = np.concatenate([got, 16 * got, -50 * got])
    rounded = duckdb.execute("SELECT CAST(round(x * 1e12) AS BIGINT) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [sums.tolist()]).fetchall()
    assert buckets(sums).tolist() == [x for (x,) in rounded]


def test_grams_are_taken_by_cluster(spark):
    """Reads are dealt by cluster below the explosion, and by no column that the grouping above could take for its own."""
    from readloom.operators import evidence as e

    reads = spark.createDataFrame([(str(c), 8, "ACGTACGT" if i % 3 else "ACGNTACG") for c in range(5) for i in range(40)], "cluster_id string, design_length int, read_sequence string")
    for rows in (e.nodes(e.multiplicity(reads), 5), e.ledger(e.multiplicity(reads), 5)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("RebalancePartitions") and "RebalancePartitions [cluster_id" not in plan
    assert {(r["cluster_id"], r["context"]): r["support"] for r in e.nodes(e.multiplicity(reads), 5).collect()} == {(str(c), g): 26 for c in range(5) for g in ("ACGTA", "CGTAC", "GTACG", "TACGT")}
