"""Both jobs: registered queries against their SQL, runs over growing input, repeated and failed runs."""

import json
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, incremental_reconstruction, turn_drift
from jobs.queries import ORACLE_SQL, QUERIES
from readloom.operators import store
from readloom.operators.decode import decode
from readloom.sources.derived import event_reads


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = QUERIES[name](spark, sf)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    columns = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")


def _want(events):
    return sorted((r.cluster_id, r.total_reads, r.sequence) for r in decode(event_reads(events)).collect())


def _got(df):
    return sorted((r.cluster_id, r.total_reads, r.sequence) for r in df.collect())


def test_growing_input_is_taken_once(spark, sf, tmp_path):
    events, source, out = _events(spark, sf), tmp_path / "events", str(tmp_path / "out")
    young = (F.col("user_id") % 3 == 0) & (F.col("event_id") % 2 == 1)
    events.where(~young).repartition(3).write.parquet(str(source))
    pattern = f"{source}/*.parquet"
    first = incremental_reconstruction.run(spark, pattern, out, parts=4, files_a_batch=2)
    assert _got(first) == _want(events.where(~young)) and {r.batch for r in first.collect()} <= {0, 1}
    files = lambda: sorted(str(p.relative_to(out)) for p in (tmp_path / "out").rglob("*.parquet"))
    before = files()
    # nothing new: nothing is written
    assert _got(incremental_reconstruction.run(spark, pattern, out, parts=4, files_a_batch=2)) == _want(events.where(~young)) and files() == before

    events.where(young).coalesce(1).write.mode("append").parquet(str(source))
    second = incremental_reconstruction.run(spark, pattern, out, parts=4, files_a_batch=2)
    assert _got(second) == _want(events)
    assert set(before) <= set(files())  # what was there stands
    touched = {str(r.user_id) for r in events.where(young).select("user_id").distinct().collect()}
    assert {r.cluster_id for r in second.where("batch = 2").collect()} == touched  # no other cluster was decoded
    stored = store.stored(spark, f"{out}/ledger").where("batch = 2 and kind = 5").agg(F.sum("support")).first()[0]
    assert stored == events.where(young).count()


def test_a_failed_batch_is_taken_again(spark, sf, tmp_path, monkeypatch):
    events, source, out = _events(spark, sf), tmp_path / "events", str(tmp_path / "out")
    events.repartition(2).write.parquet(str(source))
    whole = store.decode_stored

    def broken(*a, **b):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "decode_stored", broken)  # counters are stored, predictions aren't
    with pytest.raises(Exception, match="lost"):
        incremental_reconstruction.run(spark, f"{source}/*.parquet", out, parts=2)
    monkeypatch.setattr(store, "decode_stored", whole)
    assert _got(incremental_reconstruction.run(spark, f"{source}/*.parquet", out, parts=2)) == _want(events)


def test_store_reads_touched_parts_only(spark, sf, tmp_path):
    events, path = _events(spark, sf), str(tmp_path / "ledger")
    reads = event_reads(events)
    half = F.col("read_id").cast("long") % 2
    store.append(reads.where(half == 0), path, 0)
    store.append(reads.where(half == 1), path, 1)
    store.append(reads.where(half == 1), path, 1)  # again
    assert _got(store.decode_stored(spark, path)) == _want(events)
    one = reads.select("cluster_id").limit(1)
    got = store.decode_stored(spark, path, one)
    assert _got(got) == _want(events.where(F.col("user_id") == int(one.first()[0])))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)
    part = store.stored(spark, path, parts=[one.select(store.part_of("cluster_id")).first()[0]])
    assert part.select(F.input_file_name()).distinct().count() == 2  # of both batches
    assert _got(store.decode_stored(spark, path, upto=0)) == _want(events.where(F.col("event_id") % 2 == 0))


def _drift(rows):
    """By a full table of distances."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    first, out = {}, []
    for c, t, r, x in sorted((x for x in rows if None not in (x[0], x[1], x[3])), key=lambda x: (x[1], x[3])):
        if (c, r or None) in first:
            t0, x0 = first[c, r or None]
            if (t, x) != (t0, x0):
                out.append((str(r or None), c, t, t0, distance(x.encode(), x0.encode())))
        else:
            first[c, r or None] = (t, x)
    return sorted(out)


def test_turn_drift_on_odd_and_hot_tables(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé漢 ") for _ in range(rng.randint(0, 90)))
    rows = [(i % 5 and 7 or i, i % 11, rng.choice(["user", "assistant", None, "", "a/b=c"]), word()) for i in range(300)]
    rows += [(None, 1, "user", "x"), (1, None, "user", "x"), (1, 1, "user", None), rows[0], rows[0], (900, 0, "user", "")]
    source, out = str(tmp_path / "c"), str(tmp_path / "out")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS reference", "1 AS first_turn").repartition(4).write.parquet(source)
    for _ in range(2):
        tables = turn_drift.run(spark, source, out)
        assert sorted((str(r.role), r.conv_id, r.turn, r.first_turn, r.edit_distance) for r in tables["turns"].collect()) == _drift(rows)
    assert {str(r.role): r.evaluated_clusters for r in tables["summary"].collect()} == Counter(x[0] for x in _drift(rows))
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(empty)
    assert all(t.isEmpty() for t in turn_drift.run(spark, empty, str(tmp_path / "nothing")).values())


def test_settings_come_from_options_file_and_defaults(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": "file", "n": 3}))
    assert common.settings(["--config", str(path), "--a", "said"], "", {"a": None, "n": 1, "b": "own"}) == {"a": "said", "n": 3, "b": "own"}
    with pytest.raises(ValueError, match="missing"):
        common.settings([], "", {"a": None})
    path.write_text(json.dumps({"z": 1}))
    with pytest.raises(ValueError, match="unknown"):
        common.settings(["--config", str(path)], "", {"a": "x"})
    for name in ("turn_drift", "incremental_reconstruction"):
        module = {"turn_drift": turn_drift, "incremental_reconstruction": incremental_reconstruction}[name]
        assert set(common.settings(["--config", f"jobs/{name}.json"], "", module.DEFAULTS)) == set(module.DEFAULTS)
