"""Language identification with interpolated Kneser-Ney character models (operator 4).

Letters are lower-cased and split to words; each word is a sequence of characters between boundary marks, so a word's
log-probability never depends on its neighbours and is computed once for each different word.  Character 4-grams are
counted over all training documents where they lie and summed by language and gram; every gram takes part, whatever its
count.  Continuation counts and discounts are sums over the whole table.  The model for all languages has for each order
a sorted array of gram hashes with one row of interpolated probabilities, and of context hashes with back-off weights.
It is made and sent out in parts of about ``CELLS`` numbers, by a hash of a gram's two middle characters: all that a
4-gram backs off to is in its part, with the orders 1 and 2 in each.  The driver makes one part after the other, and a
worker holds one at a time, so neither needs room for the whole table.  A table of one part is kept in memory.

A text gets the language of the lowest length-normalised cross-entropy; ties go to the language first in order.  ``und``
with score 0 where the text is null or has no letter, or nothing was learned.  Rows with a null language aren't learned
from.  ``accepted`` rejects documents whose cross-entropy is far beyond their language's own, as measured over the labelled
rows that weren't learned from; what else there is to judge, junk and foreign text, has no part in the limits.  Scores
fall with what a text is beyond its limit.  Characters beyond the basic plane share 6,400 codes of the private area.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow, staged
from readloom.llm.textnp import U, mix

ORDER = 4
#: Numbers (grams times languages) of the highest order in one part of the model.
CELLS = 6_000_000
#: Different words that a worker holds before it sums their grams, and whose scores it remembers.
WORDS = 150_000
#: Held-out labelled rows from which a language has a limit of its own.
LEAST_ROWS = 20
_LETTERS = re.compile(r"[^\W\d_]+")
_MASK = (1 << 64) - 1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (16 bits a character) of words with boundary marks, and how many each word has."""
    code = np.frombuffer("".join(f"   {x} " for x in words).encode("utf-32-le", "replace"), np.uint32)
    code = np.where(code > 0xFFFF, 0xE000 + code % 0x1900, code).astype(U)  # rare planes share the private area
    mark = code == U(32)
    at = np.flatnonzero(~mark[3:] | ~mark[2:-1]) + 3 if len(code) > 3 else np.empty(0, np.int64)
    g = (code[at - 3] << U(48)) | (code[at - 2] << U(32)) | (code[at - 1] << U(16)) | code[at]
    return g, np.array([len(x) + 1 for x in words], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, chunks in held.items():
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for x in _LETTERS.findall(chunk.lower()):
                    words[x] += n
            if words:
                g, many = grams(list(words))
                u, inverse = np.unique(g, return_inverse=True)
                n = np.bincount(inverse, np.repeat(np.array(list(words.values()), float), many)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if text.is_valid:
                held.setdefault(lang, Counter()).update(text.as_py().split())
                if len(held[lang]) > WORDS:
                    yield from flush()
    yield from flush()


def part_of(g: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram of order 3 or 4, by the two characters before its last."""
    return (mix((g >> U(16)) & U(0xFFFFFFFF)) % U(parts)).astype(np.int64)


def _dense(gram: np.ndarray, lang: np.ndarray, n: np.ndarray, L: int) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(gram, return_inverse=True)
    count = np.zeros((len(u), L))
    np.add.at(count, (inverse, lang), n)
    return u, count


def _discount(one, two):
    return np.where(one > 0, one / np.maximum(one + 2 * two, 1), 0.5).clip(0.1, 0.9)


class Model:
    """Per order k: ``keys[k]`` sorted gram hashes, ``prob[k]`` (grams x languages), ``ctx[k]`` and ``back[k]`` for contexts.

    Without ``level`` and ``discounts``, which a part of a larger model needs, both come from the 4-grams given.
    """

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, n: np.ndarray, level: dict | None = None, discounts: dict | None = None):
        self.langs = langs
        L = len(langs)
        self.keys, self.prob, self.ctx, self.back = {}, {}, {}, {}
        level = {**(level or {}), ORDER: _dense(gram, lang, n, L)}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: different characters to the left
            if k not in level:
                above, c = level[k + 1]
                u, inverse = np.unique(above & U((1 << (16 * k)) - 1), return_inverse=True)
                count = np.zeros((len(u), L))
                np.add.at(count, inverse, (c > 0).astype(float))
                level[k] = (u, count)
        letters = len(level[1][0]) + 1
        lower = np.full((1, L), 1.0 / letters)
        self.floor = lower[0]
        for k in range(1, ORDER + 1):
            u, c = level[k]
            discount = discounts[k] if discounts else _discount((c == 1).sum(axis=0), (c == 2).sum(axis=0))
            ctx, of = np.unique(u >> U(16), return_inverse=True) if k > 1 else (np.zeros(1, U), np.zeros(len(u), int))
            total, kinds = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
            np.add.at(total, of, c)
            np.add.at(kinds, of, (c > 0).astype(float))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if k > 1:
                below = level[k - 1][0]
                lower = level_prob[np.searchsorted(below, u & U((1 << (16 * (k - 1))) - 1))]
            level_prob = np.maximum(c - discount, 0) / np.maximum(total[of], 1) + back[of] * lower
            self._store(k, u, level_prob, ctx, back)

    def _store(self, k: int, u: np.ndarray, prob: np.ndarray, ctx: np.ndarray, back: np.ndarray) -> None:
        for keys, rows, x, y in ((self.keys, self.prob, u, prob), (self.ctx, self.back, ctx, back)):
            h = mix(x + U(k))
            order = np.argsort(h)
            keys[k], rows[k] = h[order], y[order]

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return i, keys[i] == x

    def probability(self, g: np.ndarray, k: int = ORDER) -> np.ndarray:
        """(grams x languages) of the last character after the others."""
        if not k:
            return np.broadcast_to(self.floor, (len(g), len(self.langs)))
        i, ok = self._find(self.keys[k], mix(g + U(k)))
        out = self.prob[k][i]
        if not ok.all():
            x = g[~ok]
            j, known = self._find(self.ctx[k], mix((x >> U(16)) + U(k))) if k > 1 else (np.zeros(len(x), int), np.ones(len(x), bool))
            back = np.where(known[:, None], self.back[k][j], 1.0)
            out[~ok] = back * self.probability(x & U((1 << (16 * (k - 1))) - 1), k - 1)
        return out

    def logs(self, u: np.ndarray) -> np.ndarray:
        return np.log(self.probability(u))


class Parts:
    """A model in parts: ``part(i)`` gets the i-th; what was got last is dropped before the next."""

    def __init__(self, langs: list[str], parts: list):
        self.langs, self.parts = langs, parts

    def part(self, i: int) -> Model:
        shared = self.parts[i]
        model = shared.value
        if len(self.parts) > 1 and getattr(shared, "_path", None):  # read again from the worker's disk when it is needed
            shared.__dict__.pop("_value", None)
        return model

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities (words x languages) and number of characters, the end mark included."""
        g, many = grams(words)
        u, inverse = np.unique(g, return_inverse=True)
        logs, of = np.zeros((len(u), len(self.langs))), part_of(u, len(self.parts))
        for i in np.unique(of).tolist():
            logs[of == i] = self.part(i).logs(u[of == i])
        at = np.concatenate([[0], np.cumsum(many)[:-1]])
        return np.add.reduceat(logs[inverse], at, axis=0), many


class Scorer:
    """Sums over the words of whole texts; remembers white-space chunks."""

    def __init__(self, model: Parts):
        self.model, L = model, len(model.langs)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, L + 1))

    def _learn(self, chunks: list[str]) -> None:
        parts = [_LETTERS.findall(c.lower()) for c in chunks]
        flat = sorted({x for p in parts for x in p})
        add = np.zeros((len(chunks), len(self.model.langs) + 1))
        if flat:
            logs, many = self.model.words(flat)
            of = {x: i for i, x in enumerate(flat)}
            i = [k for k, p in enumerate(parts) for _ in p]
            j = [of[x] for p in parts for x in p]
            np.add.at(add, i, np.column_stack([logs, many])[j])
        base = len(self.place)
        for k, c in enumerate(chunks):
            self.place[c] = base + k
        self.rows = np.vstack([self.rows, add])

    def __call__(self, texts: list[str]) -> np.ndarray:
        """(texts x languages + 1): log-probabilities and number of characters."""
        counts = [Counter(t.split()) for t in texts]
        new = sorted({c for n in counts for c in n if c not in self.place})
        if len(self.place) + len(new) > WORDS and self.place:
            self.place, self.rows = {}, self.rows[:0]
            new = sorted({c for n in counts for c in n})
        if new:
            self._learn(new)
        get = self.place.__getitem__
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, n in enumerate(counts):
            if n:
                out[i] = np.fromiter(n.values(), float, len(n)) @ self.rows[np.fromiter(map(get, n), np.int64, len(n))]
        return out


SCORED = "doc_id long, held_out boolean, lang string, lang_pred string, score double, cross_entropy double, n_letters long, text_key long"


def _score(model: Parts | None):
    rows = 256 if not model or len(model.parts) == 1 else 1 << 30  # whole batches: fewer reads of parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        names = np.array([*model.langs, "und"]) if model else np.array(["und"])
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                n, und = part.num_rows, len(names) - 1
                best, score, xent, many = np.full(n, und), np.zeros(n), np.full(n, np.nan), np.zeros(n)
                if scorer:
                    got = scorer([x or "" for x in part.column("text").to_pylist()])
                    many = got[:, -1]
                    some = np.flatnonzero(many > 0)
                    each = -got[some, :-1] / many[some, None]
                    best[some] = each.argmin(axis=1)
                    xent[some] = each.min(axis=1)
                    gap = np.partition(each, 1, axis=1)[:, 1] - each.min(axis=1) if each.shape[1] > 1 else np.full(len(some), np.inf)
                    score[some] = 1 - 0.5 * np.exp(-gap * np.sqrt(many[some]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("lang"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(xent, from_pandas=True), pa.array(many.astype(np.int64)), part.column("text_key")],
                    names=[c.split()[0] for c in SCORED.split(", ")],
                )

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _fold(doc_id: Column) -> Column:
    """A fifth of the rows that may be learned from; the model doesn't see it, and limits are learned from it alone."""
    return ~F.coalesce(held_out(doc_id), F.lit(True)) & (F.floor(F.crc32(doc_id.cast("string")) / 3) % 5 == 0)


def learn(docs: DataFrame) -> Parts | None:
    """The model of all rows of ``docs(lang, text)`` with a language."""
    counted = map_arrow(docs.where("lang is not null and text is not null").select("lang", "text"), _count, "lang string, gram long, n long")
    summed = staged(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    many = {r["lang"]: r["n"] for r in summed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not many:
        return None
    names = sorted(many)
    share = summed.sparkSession.sparkContext.broadcast
    parts = -(-sum(many.values()) * len(names) // CELLS)
    if parts == 1:
        return Parts(names, [share(Model(names, *_arrays(summed, names)))])
    level, discounts = {ORDER: summed}, {}
    for k in range(ORDER - 1, 0, -1):
        lower = level[k + 1].select("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram"))
        level[k] = staged(lower.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"grams{k}")
    for k, of in level.items():
        ones = {r["lang"]: (r["one"], r["two"]) for r in of.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        discounts[k] = _discount(*np.array([ones[x] for x in names]).T)
    low = {k: _dense(*_arrays(level[k], names), len(names)) for k in (1, 2)}  # pairs of characters
    # a part's rows lie together
    split = {k: staged(map_arrow(level[k], _with_part(parts), "lang string, gram long, n long, part long").repartition("part").sortWithinPartitions("part"), f"parts{k}") for k in (3, 4)}
    shared = []
    for i in range(parts):
        third, fourth = (_arrays(split[k].where(F.col("part") == i), names) for k in (3, 4))
        shared.append(share(Model(names, *fourth, {**low, 3: _dense(*third, len(names))}, discounts)))
    return Parts(names, shared)


def _with_part(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(part_of(batch.column("gram").to_numpy().view(U), parts)))

    return run


def _arrays(table: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = table.select("lang", "gram", "n").toArrow()
    lang = np.searchsorted(names, np.array(got.column("lang").to_pylist(), dtype=str)) if got.num_rows else np.empty(0, np.int64)
    return got.column("gram").to_numpy().view(U), lang, got.column("n").to_numpy()


def _scored(docs: DataFrame) -> DataFrame:
    """``predict`` with the label ``lang``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.coalesce(held_out(F.col("doc_id").cast("long")), F.lit(True)).alias("held_out"))
    model = learn(rows.where(~F.col("held_out") & ~_fold(F.col("doc_id"))))
    return map_arrow(rows.select("doc_id", "text", "lang", "held_out", F.xxhash64("text").alias("text_key")), _score(model), SCORED)


def predict(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``(doc_id, held_out, lang_pred, score, cross_entropy, n_letters)`` for every row."""
    return _scored(docs).drop("lang", "text_key")


def accepted(docs: DataFrame, width: float = 6.0) -> DataFrame:
    """``predict`` with ``accepted`` and a calibrated score: has letters, and a cross-entropy within ``width`` times its language's own spread.

    A language's limit is calibrated on a fifth of the rows that aren't held out, which the model hasn't learned from: those
    labelled with it and predicted as it.  It is their median plus
    ``width`` times the distance from the 10th percentile up to it, plus an allowance for short texts that falls with the
    root of their length.  Rows without a label never move a limit, however many they are.  Of labelled junk, which lies
    above the median as long as it is less than half of a language's rows, the spread below it feels little.  A language
    with fewer than ``LEAST_ROWS`` such rows has the widest limit of the others; where none has that many, the limit of
    all such rows together, and without any of them, none.  No held-out row's label is read.

    ``text_key`` is xxhash64 of the text: with doc_id it tells which row an answer is for, also where ids are null or repeated.
    """
    scored = staged(_scored(docs), "languages")
    at = F.percentile_approx("cross_entropy", F.array(F.lit(0.1), F.lit(0.5)), 10000)
    own = scored.where(_fold(F.col("doc_id")) & F.expr("lang = lang_pred and cross_entropy is not null"))
    limits = own.groupBy("lang_pred").agg(at.alias("at"), F.count(F.lit(1)).alias("n"))  # a row for each language
    limits = limits.select("lang_pred", "n", (F.col("at")[1] + width * (F.col("at")[1] - F.col("at")[0])).alias("limit"))
    known = {r["lang_pred"]: r["limit"] for r in limits.where(F.col("n") >= LEAST_ROWS).collect()}
    together = own.agg(at.alias("at")).first()["at"]
    other = max(known.values()) if known else together[1] + width * (together[1] - together[0]) if together else float("inf")
    limit = F.lit(other)
    for lang, value in known.items():
        limit = F.when(F.col("lang_pred") == lang, value).otherwise(limit)
    beyond = F.col("cross_entropy") - limit - 6 / F.sqrt("n_letters")
    score = F.when(beyond > 0, F.col("score") * F.exp(-F.least(beyond * F.sqrt("n_letters"), F.lit(700.0)))).otherwise(F.col("score"))
    return scored.drop("lang").withColumn("accepted", F.coalesce(beyond <= 0, F.lit(False))).withColumn("score", score)
