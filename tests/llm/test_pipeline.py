"""The pipeline's stages take effect, keep clean documents and the columns of documents."""

import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from readloom.llm import decontaminate, language, minhash, packing, pii


@pytest.fixture(scope="module")
def docs(spark, sf):
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !!", "en", "s", 8), (10**6 + 2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra).withColumn("accepted", F.lit("clash")).withColumn("masked", F.lit("clash"))


def ids(df):
    got = [r.doc_id for r in df.select("doc_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_names():
    assert [f for _, f in cp.STAGES] == [cp.language_id, cp.near_dedup, cp.decontamination, cp.hide_pii, cp.pack]


def test_language_stage(spark, sf, docs):
    got = cp.language_id(spark, docs, sf)
    assert got.columns == docs.columns
    kept = ids(got)
    ok = {r.doc_id for r in language.accepted(docs).where("accepted").collect()}
    assert kept == ok and not kept & {10**6, 10**6 + 1, 10**6 + 2} and len(kept) >= 0.97 * (docs.count() - 3)


@pytest.mark.parametrize("hot", [False, True])
def test_language_stage_rejects_junk_and_an_unlearned_language(spark, sf, hot):
    """A third of the rows are random letters, or all rows of one language are in letters that mean something else."""
    r = random.Random(7)
    own = spark.read.parquet(f"{sf}/documents.parquet")
    n = own.count()
    if hot:
        words = lambda: " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 9))) for _ in range(r.randint(10, 80)))
        texts = [words() for _ in range(n // 2)]
    else:
        other = str.maketrans(string.ascii_lowercase, "".join(r.sample(string.ascii_lowercase, 26)))
        texts = [x.text.lower().translate(other) for x in own.where("lang = 'de' and length(text) > 50").collect()]
    rows = [(10**7 + i, t, None, "hot", len(t)) for i, t in enumerate(texts)]
    both = own.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = ids(cp.language_id(spark, both, sf))
    assert len([i for i in kept if i >= 10**7]) <= 0.02 * len(rows)
    assert len([i for i in kept if i < 10**7]) >= 0.97 * n


def test_near_dedup_stage(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: sh(t) for i, t in texts.items()}
    kept = ids(cp.near_dedup(spark, docs, sf))
    group = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert kept == {i for i, g in group.items() if i == g}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b:
                n = len(a & b)
                assert (group[i] == group[j]) or 100 * n < 80 * (len(a) + len(b) - n)


def sh(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_decontamination_stage(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.first().text
    dirty = spark.createDataFrame([(2 * 10**6, "and so " + item.upper() + " it went", "en", "s", 0, "a", "b")], docs.schema)
    kept = ids(cp.decontamination(spark, docs.unionByName(dirty), sf))
    hit = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    assert kept == {r.doc_id for r in docs.collect()} - hit


def test_pii_stage(spark, sf, docs):
    one = spark.createDataFrame([(3 * 10**6, "write to joe.bloggs@mail.example.com or 10.20.30.40 now", "en", "s", 55, "a", "b")], docs.schema)
    all_ = docs.unionByName(one)
    got = {r.doc_id: r for r in cp.hide_pii(spark, all_, sf).collect()}
    before = {r.doc_id: r for r in all_.collect()}
    assert set(got) == set(before)
    assert got[3 * 10**6].text == "write to <email> or <ip> now" and got[3 * 10**6].n_chars == len(got[3 * 10**6].text)
    assert not any(pii.base_spans(r.text or "") for r in got.values())
    clean = [i for i, r in before.items() if not any(c in "0123456789@" for c in r.text or "")]
    assert all(tuple(got[i]) == tuple(before[i]) for i in clean)


def test_null_and_repeated_ids(spark, sf, docs):
    """Rows are told apart by their texts where ids don't do so."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first().text
    secret = "write to joe.bloggs@mail.example.com now"
    good = [r.text for r in docs.where("lang = 'en' and length(text) > 200").orderBy("doc_id").limit(4).collect()]
    i = 4 * 10**6
    more = [(None, good[0]), (None, "12 34 !!"), (None, item), (None, secret), (i, good[1]), (i, "56 78"), (i + 1, item), (i + 1, good[2]), (i + 2, secret), (i + 2, good[3])]
    odd = spark.createDataFrame([(d, t, None, "s", len(t), "a", "b") for d, t in more], docs.schema)
    both = docs.unionByName(odd)
    pick = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.where(f"doc_id is null or doc_id >= {i}").collect()))
    of = lambda keep: sorted((d or 0, t) for d, t in more if keep(t))
    kept = pick(cp.language_id(spark, both, sf))
    assert all((d, t) not in kept for d, t in ((0, "12 34 !!"), (i, "56 78"))) and {(0, good[0]), (i, good[1]), (i + 1, good[2]), (i + 2, good[3])} <= set(kept)
    assert pick(cp.decontamination(spark, both, sf)) == of(lambda t: t != item)
    shown = {t: cp.pii.masked(t, cp.pii.base_spans(t)) for _, t in more if "@" in t}
    got = pick(cp.hide_pii(spark, both, sf))
    assert [x for x in got if x[1] in shown.values()] == sorted((d or 0, shown[t]) for d, t in more if t in shown) and len(got) == len(more)
    twice = odd.where("doc_id is null").unionByName(odd.where("doc_id is null"))
    assert pick(cp.near_dedup(spark, twice, sf)) == sorted((0, t) for d, t in more if d is None)


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, sf), "step")
    want = packing.pack(docs, cp.tokenizer_path())
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, out.collect()))


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
