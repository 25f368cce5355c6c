"""Edit distances of many pairs at a time, 64 cells in one machine word.

A pair's longer side stands in words of 64 rows (Myers' vertical differences of +1 and -1 as bits); the shorter side is
read byte by byte.  A word's step needs what the word above made of the same byte, so words work as a wave: at time t word
b reads byte t - b, and all words of all pairs of a group step together as arrays.  With a limit only words within the
limit of the diagonal step at all (Ukkonen's band); what lies outside counts as further away, never as nearer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

W = np.uint64
#: Words of a group of pairs, and pairs of it: bounds the tables of which rows hold which byte (2 KB a word).
GROUP_WORDS, GROUP_PAIRS = 1 << 13, 4096


def _trimmed(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Both without what they begin and end with in common; the longer one first."""
    if len(a) < len(b):
        a, b = b, a
    if a.startswith(b):
        return a[len(b) :], b""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differs = np.flatnonzero(x[: len(y)] != y)
    head = int(differs[0])
    room = len(y) - head
    differs = np.flatnonzero(x[len(x) - room :] != y[head:])
    tail = room - 1 - int(differs[-1]) if len(differs) else room
    return a[head : len(a) - tail], b[head : len(b) - tail]


def _group(longer: list[bytes], shorter: list[bytes], most: int | None) -> np.ndarray:
    """Distances of a group; beyond ``most`` they are only known to be beyond."""
    pairs = len(longer)
    m, n = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    words, steps = int(-(-m.max() // 64)), int(n.max())
    rows = np.zeros((pairs, words * 64), np.uint8)
    text = np.zeros((pairs, steps + words), np.uint8)
    for i, (x, y) in enumerate(zip(longer, shorter)):
        rows[i, : len(x)] = np.frombuffer(x, np.uint8)
        text[i, : len(y)] = np.frombuffer(y, np.uint8)
    used, coded = np.unique(np.concatenate([rows.ravel(), text.ravel()]), return_inverse=True)
    rows, text = coded[: rows.size].reshape(pairs, words, 64), coded[rows.size :].reshape(text.shape)
    table = np.zeros((pairs, len(used), words), W)  # which rows of a word hold a byte
    p, b = np.indices((pairs, words))
    for bit in range(64):
        table[p, rows[:, :, bit], b] |= W(1 << bit)
    plus, minus = np.full((pairs, words), ~W(0)), np.zeros((pairs, words), W)
    carry = np.zeros((pairs, words + 1), np.int8)  # what each word hands down; at 0 the row above all
    carry[:, 0] = 1
    last, top = (m - 1) // 64, ((m - 1) % 64).astype(W)
    shift = np.full((pairs, words), W(63))
    shift[np.arange(pairs), last] = top
    # of each word's lowest row; at first nothing is read, and all rows are to be deleted
    score = np.minimum(64 * (np.arange(words) + 1)[None, :], m[:, None]).astype(np.int64)
    found, each, one = m.astype(np.int64), np.arange(pairs), W(1)
    for t in range(steps + words - 1):
        lo, hi = max(0, t - steps + 1), min(words - 1, t)
        if most is not None:
            first = lo
            lo, hi = max(lo, -(-(t - most - 63) // 65)), min(hi, (t + most) // 65)
            if lo > hi:
                continue
            if lo > first:
                carry[:, lo] = 1
            if 0 < hi < t and t + most == 65 * hi:  # a word that the band reaches now
                score[:, hi] = score[:, hi - 1] - carry[:, hi] + np.minimum(64, np.maximum(0, m - 64 * hi))
        here = slice(lo, hi + 1)
        at = np.arange(lo, hi + 1)
        eq = table[each[:, None], text[:, t - at], at[None, :]]
        down = carry[:, here]
        pv, mv = plus[:, here], minus[:, here]
        less, more = (down < 0).astype(W), (down > 0).astype(W)
        xv = eq | mv
        eq = eq | less
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        s = shift[:, here]
        made = ((ph >> s) & one).astype(np.int8) - ((mh >> s) & one).astype(np.int8)
        ph = (ph << one) | more
        mh = (mh << one) | less
        plus[:, here] = mh | ~(xv | ph)
        minus[:, here] = ph & xv
        score[:, here] += made
        carry[:, lo + 1 : hi + 2] = made
        ends = each[t - last == n - 1]
        found[ends] = score[ends, last[ends]]
    return found


def distances(a: list[bytes | None], b: list[bytes | None], most: int | None = None) -> list[int | None]:
    """Edit distances; -1 beyond ``most``, None where a side is None."""
    out: list[int | None] = [None] * len(a)
    left: list[tuple[int, int, int, bytes, bytes]] = []
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        if most is not None and abs(len(x) - len(y)) > most:
            out[i] = -1
            continue
        long, short = _trimmed(x, y)
        if not short:
            out[i] = len(long) if most is None or len(long) <= most else -1
        else:
            left.append((-(-len(long) // 64), len(short), i, long, short))
    left.sort()
    lo = 0
    while lo < len(left):
        hi = lo + 1
        while hi < len(left) and hi - lo < GROUP_PAIRS and left[hi][0] * (hi - lo + 1) <= GROUP_WORDS and left[hi][0] <= 2 * left[lo][0] and left[hi][1] <= 2 * left[lo][1] + 64:
            hi += 1
        part = left[lo:hi]
        found = _group([x[3] for x in part], [x[4] for x in part], most)
        for x, d in zip(part, found.tolist()):
            out[x[2]] = d if most is None or d <= most else -1
        lo = hi
    return out


def edit_distance(a: str | Column, b: str | Column, most: int | None = None) -> Column:
    """The edit distance in bytes of two texts (int); -1 where it is beyond ``most``; null where a side is null."""
    if most is not None and most < 0:
        raise ValueError("a limit is 0 or more")

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(distances(x.cast(pa.large_binary()).to_pylist(), y.cast(pa.large_binary()).to_pylist(), most), pa.int32())

    return run(a, b)
