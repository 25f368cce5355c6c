"""Personal data: base patterns, and a semi-Markov conditional random field for whole spans (operator 1).

Base spans come from four fixed patterns with validators and always stay.  The field adds spans of the same kinds and of
``secret`` (keys, passwords, tokens) where they don't overlap a base span.

Field: a text is cut into words and single marks.  A segment of at most ``MAX_TOKENS`` tokens and ``MAX_CHARS``
characters, holding a digit or @, may be an entity; any token may be outside.  Features look at the whole segment (its
shape with and without lengths, digits, checksum, marks) and at its neighbours, as arrays over all segments.  Dynamic
programming over segment ends picks boundaries and kinds together.  Only tokens near a digit or @ can be in a segment, so
text between such places is outside for certain and leaves the program unchanged: it runs over windows, which is exact
for the whole text.  It goes through a long window in pieces and keeps what a later segment can reach, so a text of
numbers alone needs little more memory than the text.

Weights maximise the conditional likelihood (forward-backward over segments) on made-up examples of every kind
(``examples``) and on windows of at most ``TRAIN_DOCS`` documents, labelled by the patterns and by two patterns for
secrets; windows of over ``TRAIN_CHARS`` characters aren't learned from.

Null texts count as empty: no spans.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow
from readloom.llm.textnp import U, mix

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TOKENS, MAX_CHARS = 16, 200
#: Bounds of the training sample (documents, windows of theirs, characters of a window), and rows of the weights.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_CHARS, EPOCHS, BUCKETS = 2000, 1500, 400, 4, 1 << 15
#: Tokens of one piece of a text, ends of segments taken together, and tokens before them that their features reach.
PIECE, STEP, KEPT = 16384, 4096, 32

Span = tuple[int, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _card_ok(s: str) -> bool:
    digits = _NON_DIGIT.sub("", s)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _ip_ok(s: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in s.split(".")))


def _phone_ok(s: str) -> bool:
    return 9 <= len(_NON_DIGIT.sub("", s)) <= 15


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            i = m.start()
            while i > end and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append((0, i, m.end()))
                end = m.end()
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if _ip_ok(m.group())]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if _card_ok(m.group())]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if _phone_ok(m.group())]
    return out


_SECRETS = (re.compile(r"(?i)(?:password|passwd|token|secret|api[_-]?key)[ ]?[=:][ ]?\"?([A-Za-z0-9_\-]{12,64})"), re.compile(r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"))


def _labels(text: str) -> list[Span]:
    """What the field learns from in documents: disjoint base spans and patterns of secrets."""
    found = base_spans(text) + [(4, *m.span(1)) for p in _SECRETS for m in p.finditer(text) if re.search(r"\d", m[1])]
    kept: list[Span] = []
    for s in sorted(found, key=lambda s: (s[1], s[0])):
        if not kept or s[1] >= kept[-1][2]:
            kept.append(s)
    return kept


_TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
_MARK = re.compile(r"[0-9@]+")


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint ranges around every digit and @: whole white-space chunks with the two chunks before and one behind."""
    lo = hi = -1
    for m in _MARK.finditer(text):
        if m.end() <= hi:
            continue
        a, b = m.start(), m.end()
        for _ in range(3):
            while a and text[a - 1].isspace():
                a -= 1
            stop = max(0, a - MAX_CHARS)
            while a > stop and not text[a - 1].isspace():
                a -= 1
        for _ in range(2):
            while b < len(text) and text[b].isspace():
                b += 1
            stop = min(len(text), b + MAX_CHARS)
            while b < stop and not text[b].isspace():
                b += 1
        if a <= hi:
            hi = max(hi, b)
        else:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
    if hi >= 0:
        yield lo, hi


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_A, _B, _N = re.compile(r"[A-Z]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def _shape(word: str) -> str:
    """Runs of capitals, other letters and digits; words of many runs are told apart by their alphabet only."""
    s = _A.sub("A", _B.sub("a", _N.sub("9", word)))
    return s if len(s) < 5 else "hex" if _HEX.fullmatch(word) else "mix" + "".join(c for c in "Aa9" if c in s)


#: Marks whose numbers segments ask for.
_AT, _DOT, _PLUS, _DASH, _BRACKET, _WORD = 1, 2, 3, 4, 5, 0
_MARKS = {"@": _AT, ".": _DOT, "+": _PLUS, "-": _DASH, "(": _BRACKET, ")": _BRACKET}
_words: dict[str, tuple[int, ...]] = {}


def _word(w: str) -> tuple[int, ...]:
    """A token by itself: hashes of its shape, of shape and length, of its letters and first character, and its properties."""
    got = _words.get(w)
    if got is None:
        if len(_words) > 100_000:
            _words.clear()
        digits, shape = sum(c in "0123456789" for c in w), _shape(w)
        number = digits == len(w)
        marked = digits > 0 or w == "@"
        outside = "out:" + ("9" if marked else "a" if w.isalpha() else w) + (str(min(len(w), 9)) if marked else "")
        kind = _MARKS.get(w, _WORD if w.isalnum() else 6)
        got = _words[w] = (_hash("shape:" + shape), _hash(f"long:{shape}:{min(len(w), 24)}"), _hash("word:" + w.lower()[:12]), _hash("first:" + w[0]), _hash(outside) % BUCKETS, digits, int(number), int(marked), kind, int(number and len(w) < 4 and int(w) < 256), int(w.isalpha()))
    return got


#: Keeps equal values of different features apart.
_SEEDS = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, 32, dtype=U)


class Tokens:
    """Tokens of one or more windows, one window behind the other, as arrays.

    ``head`` marks a window's first token.  No segment crosses it, a line's end, or white space of more than one character.
    """

    def __init__(self, words: list[str], start: list[int], end: list[int], head: list[bool]):
        self.n = n = len(words)
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        rows = np.array([_word(w) for w in words], dtype=object).reshape(n, 11)
        self.shape, self.long, self.word, self.initial = (rows[:, c].astype(np.uint64) for c in range(4))
        self.outside, digits, self.number, marked, self.kind, self.octet, alpha = (rows[:, c].astype(np.int64) for c in range(4, 11))
        head = np.array(head, bool)
        gap = np.zeros(n, np.int64)  # before each token
        gap[1:] = self.start[1:] - self.end[:-1]
        self.head, self.gap = head, gap
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.c_marked, self.c_digits, self.c_number = total(marked), total(digits), total(self.number)
        self.c_mark = {k: total(self.kind == k) for k in (_AT, _DOT, _DASH, _BRACKET, _PLUS)}
        self.c_space, self.c_word = total(gap > 0), total(self.kind == _WORD)
        # Luhn sums of any range of digits, from sums over even and odd places of digits as they are and doubled
        flat = np.frombuffer("".join(w if w.isdecimal() and w.isascii() else "".join(c for c in w if c in "0123456789") for w in words).encode(), np.uint8).astype(np.int64) - 48
        twice = 2 * flat - 9 * (flat > 4)
        even = np.arange(len(flat)) % 2 == 0
        self.luhn = [total(np.where(even, x, y)) for x, y in ((flat, twice), (twice, flat))]
        at = np.arange(n)
        self.last_at = np.maximum.accumulate(np.where(self.kind == _AT, at, -1)) if n else at
        # the nearest word to the left, at most four tokens away
        near = np.maximum.accumulate(np.where(alpha > 0, at, -9)) if n else at
        first = np.maximum.accumulate(np.where(head, at, 0)) if n else at
        before = np.concatenate([[-9], near[:-1]]) if n else near
        ok = (before >= first) & (at - before <= 4)
        self.cue = np.where(ok, self.word[np.maximum(before, 0)], U(1)) if n else self.word
        self.left = np.where(head, U(2), np.concatenate([[U(0)], self.word[:-1]])) if n else self.word
        ends = np.concatenate([head[1:], [True]]) if n else head
        self.right = np.where(ends, U(3), np.concatenate([self.initial[1:], [U(0)]])) if n else self.word
        self.tied_left, self.tied_right = (gap == 0) & ~head, np.concatenate([gap[1:] == 0, [False]]) & ~ends if n else head

    def segments(self, lo: int, hi: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidate segments (tokens i to j - 1) with lo < j <= hi, by j: ``i``, ``j`` and their features (segments x FEATURES)."""
        j = np.arange(lo + 1, hi + 1)
        i, shape, long = j.copy(), np.zeros(len(j), U), np.zeros(len(j), U)
        found = []
        for m in range(1, MAX_TOKENS + 1):
            ok = (i > 0) & (True if m == 1 else ~breaks[np.minimum(i, self.n - 1)])
            i, j, shape, long = i[ok] - 1, j[ok], shape[ok], long[ok]
            ok = self.end[j - 1] - self.start[i] <= MAX_CHARS
            i, j, shape, long = i[ok], j[ok], shape[ok], long[ok]
            space = (self.gap[i + 1 - (m == 1)] * (m > 1)).astype(U)
            shape, long = mix(shape * U(31) + space + self.shape[i]), mix(long * U(31) + space + self.long[i])
            take = self.c_marked[j] > self.c_marked[i]
            found.append((i[take], j[take], shape[take], long[take]))
        i, j, shape, long = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(j, kind="stable")
        i, j, shape, long = i[order], j[order], shape[order], long[order]
        return i, j, self._features(i, j, shape, long)

    def _features(self, i: np.ndarray, j: np.ndarray, shape: np.ndarray, long: np.ndarray) -> np.ndarray:
        n, size, z = self.c_digits[j] - self.c_digits[i], self.end[j - 1] - self.start[i], j - 1
        count = {k: c[j] - c[i] for k, c in self.c_mark.items()}
        space = (self.c_space[j] - self.c_space[np.minimum(i + 1, j)]) > 0
        alnum, plus = (j - i == 1) & (self.c_word[j] > self.c_word[i]), self.kind[i] == _PLUS
        numbers = self.c_number[j] - self.c_number[i]
        of = lambda *parts: sum(p.astype(np.int64) * w for p, w in zip(parts, (1, 8, 64, 512, 4096)))
        d0, d1 = self.c_digits[i], self.c_digits[j]
        odd = (d1 - 1) % 2
        luhn_ok = np.where(odd == 0, self.luhn[0][d1] - self.luhn[0][d0], self.luhn[1][d1] - self.luhn[1][d0]) % 10 == 0
        card, dots = j - i == numbers + count[_DASH], j - i == numbers + count[_DOT]
        phone = j - i == numbers + count[_DASH] + count[_DOT] + count[_BRACKET] + count[_PLUS]
        octets = np.ones(len(i), bool)
        for k in range(7):
            t = np.minimum(i + k, self.n - 1)
            octets &= (self.octet[t] > 0) if k % 2 == 0 else (self.kind[t] == _DOT)
        at = self.last_at[z]
        tail = np.where(at >= i, self.c_mark[_DOT][j] - self.c_mark[_DOT][np.minimum(at + 1, j)], 0)
        none = np.full(len(i), -1)
        columns = [
            np.zeros(len(i), np.int64),
            shape,
            long,
            np.minimum(n, 20),
            np.minimum(size // 4, 12),
            of(np.minimum(count[_AT], 3), np.minimum(count[_DOT], 5), space, plus, alnum),
            self.shape[i],
            self.shape[z],
            of(self.tied_left[i], self.tied_right[z]),
            self.left[i],
            self.right[z],
            self.cue[i],
            np.where(alnum, of(n > 0, n < size, np.minimum(size // 6, 6)), none),
            np.where((n >= 13) & (n <= 19), of(luhn_ok, card), none),
            np.where((count[_DOT] == 3) & dots & ~space, of((j - i == 7) & octets), none),
            np.where(plus & (self.number[z] > 0), of((n >= 9) & (n <= 15), phone), none),
            np.where(at >= i, of(at > i, at < z - 1, tail > 0, space, self.kind[z] == _WORD), none),
            np.where(phone & (n >= 7) & (n <= 15), of(np.minimum(numbers, 7), plus, space), none),
        ]
        out = np.empty((len(i), len(columns)), np.int64)
        for c, x in enumerate(columns):
            number = (mix((x if x.dtype == U else x.view(U)) + _SEEDS[c]) % U(BUCKETS)).astype(np.int64)
            out[:, c] = number if x.dtype == U else np.where(x < 0, BUCKETS, number)
        return out


def _stream(parts: list[tuple[str, int, int]]) -> Iterator[tuple[Tokens, np.ndarray, list[int], int, int, int]]:
    """Tokens of windows ``(text, lo, hi)`` in pieces of at most ``PIECE`` new ones, however long a window is.

    Yields ``(tokens, breaks, parts' numbers, first new, past the last new, base)``: a piece also holds the tokens before its
    new ones that a segment or its neighbours can reach, and one behind; ``base`` is the number of tokens before the piece.
    """
    words, start, end, head, line, of = [], [], [], [], [], []
    first = base = 0

    def piece(stop: int):
        t = Tokens(words, start, end, head)
        return t, t.head | (t.gap > 1) | np.array(line, bool), list(of), first, stop, base

    for k, (text, lo, hi) in enumerate(parts):
        last = lo
        for m in _TOKEN.finditer(text, lo, hi):
            a, b = m.span()
            head.append(last == lo and (not of or of[-1] != k))
            words.append(m.group())
            start.append(a)
            end.append(b)
            line.append(a - last == 1 and text[last] == "\n")
            of.append(k)
            last = b
            if len(words) - first > PIECE:
                yield piece(len(words) - 1)
                cut = max(0, len(words) - 1 - KEPT)
                for x in (words, start, end, head, line, of):
                    del x[:cut]
                first, base = len(words) - 1, base + cut
    if words:
        yield piece(len(words))


def decode(parts: list[tuple[str, int, int]], w: np.ndarray) -> list[list[Span]]:
    """The best joint choice of boundaries and kinds in each window ``(text, lo, hi)``, as spans of the text.

    Scores are taken against all tokens being outside, so segments that gain nothing over that are left out at once and a
    token's best score never falls.  What is held for a text is a record for each place where it rises.
    """
    rises: list[tuple[int, int, int, int, int, int]] = []  # j, i, kind, part, start, end
    at, value = [-1], [0.0]  # the rises' ends, and the best score from there on
    for t, breaks, of, first, stop, base in _stream(parts):
        out = np.concatenate([[0.0], np.cumsum(w[t.outside, -1])])
        for lo in range(first, stop, STEP):
            i, j, f = t.segments(lo, min(lo + STEP, stop), breaks)
            e = np.zeros((len(i), len(KINDS)))
            for c in range(f.shape[1]):
                e += w[f[:, c], : len(KINDS)]
            kind = e.argmax(axis=1)
            gain = e[np.arange(len(i)), kind] - (out[j] - out[i])
            for s in np.flatnonzero(gain > 0).tolist():
                a, b = int(i[s]) + base, int(j[s]) + base
                v = value[bisect.bisect_right(at, a) - 1] + float(gain[s])
                if v > value[-1]:
                    if at[-1] == b:
                        at.pop(), value.pop(), rises.pop()
                    at.append(b)
                    value.append(v)
                    rises.append((b, a, int(kind[s]), of[int(i[s])], int(t.start[i[s]]), int(t.end[j[s] - 1])))
    spans: list[list[Span]] = [[] for _ in parts]
    j = 1 << 62
    for b, a, kind, part, lo, hi in reversed(rises):
        if b <= j:
            spans[part].append((kind, lo, hi))
            j = a
    return [x[::-1] for x in spans]


class Example:
    """A window to learn from: its segments, by end and by start, their features, and the gold ones' kinds."""

    def __init__(self, text: str, gold: list[Span]):
        (t, breaks, *_), *rest = _stream([(text, 0, len(text))])
        self.n, self.outside = t.n, t.outside
        self.i, self.j, self.f = t.segments(0, t.n, breaks)
        self.used, self.of = np.unique(self.f, return_inverse=True)
        self.of = self.of.ravel()
        first, last = {a: k for k, a in enumerate(t.start.tolist())}, {b: k + 1 for k, b in enumerate(t.end.tolist())}
        self.gold = {(first.get(a, -1), last.get(b, -1)): k for k, a, b in gold}
        have = {s: k for k, s in enumerate(zip(self.i.tolist(), self.j.tolist()))}
        self.whole = not rest and all(s in have for s in self.gold)
        self.want = [(have[s], k) for s, k in self.gold.items()] if self.whole else []
        self.ends = [np.flatnonzero(self.j == x).tolist() for x in range(self.n + 1)]
        self.starts = [np.flatnonzero(self.i == x).tolist() for x in range(self.n + 1)]

    def scores(self, w: np.ndarray) -> np.ndarray:
        """(segments x kinds)"""
        return w[self.f, : len(KINDS)].sum(axis=1)

    def learn(self, w: np.ndarray, rate: float) -> None:
        """One step up the conditional log-likelihood of the gold segmentation, by forward and backward sums."""
        e = self.scores(w)
        most = e.max(axis=1) if len(e) else np.zeros(0)
        either = (most + np.log(np.exp(e - most[:, None]).sum(axis=1))).tolist()  # over kinds
        out, n = w[self.outside, -1].tolist(), self.n
        i, j = self.i.tolist(), self.j.tolist()
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for x in range(1, n + 1):
            terms = [alpha[x - 1] + out[x - 1]] + [alpha[i[k]] + either[k] for k in self.ends[x]]
            top = max(terms)
            alpha[x] = top + math.log(sum(math.exp(t - top) for t in terms))
        for x in range(n - 1, -1, -1):
            terms = [beta[x + 1] + out[x]] + [beta[j[k]] + either[k] for k in self.starts[x]]
            top = max(terms)
            beta[x] = top + math.log(sum(math.exp(t - top) for t in terms))
        z = alpha[n]
        if len(e):
            step = -np.exp(np.minimum(np.array(alpha)[self.i][:, None] + e + np.array(beta)[self.j][:, None] - z, 0))
            for k, kind in self.want:
                step[k, kind] += 1
            for k in range(len(KINDS)):
                w[self.used, k] += rate * np.bincount(self.of, np.repeat(step[:, k], self.f.shape[1]), len(self.used))
            w[BUCKETS] = 0  # of features that a segment hasn't
        inside = {t for a, b in self.gold for t in range(a, b)}
        for t in range(n):
            p = math.exp(min(alpha[t] + out[t] + beta[t + 1] - z, 0))
            w[self.outside[t], -1] += rate * ((t not in inside) - p)


def examples(n: int = 40, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Made-up windows by rule, ``n`` of each form: kinds with their spans, and harmless numbers."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick("abdeghilmnoprstu", r.randint(2, 8))
    num = lambda k: pick(dig, k)
    both = lambda k: pick(low + up + dig, k - 1) + num(1)

    def card() -> str:
        body = r.choice(["4", "5", "37"])
        body += num(15 - len(body))
        return next(body + c for c in dig if luhn(body + c))

    def grouped(c: str, mark: str) -> str:
        return mark.join(c[i : i + 4] for i in range(0, 16, 4))

    named = lambda: r.choice(["password", "passwd", "pwd", "pass", "token", "secret", "api_key", "apikey", "API-KEY", "access_key", "auth_token", "client_secret"])
    sign = lambda: r.choice(["=", " = ", ": ", ":", " is "])
    quote = lambda s: r.choice(["{}", '"{}"', "'{}'"]).format("\x01" + s + "\x02")
    call = lambda: r.choice(["call", "phone", "tel", "tel.", "mobile", "fax", "ring", word()])
    mark = lambda s: "\x01" + s + "\x02"
    forms = [
        (0, lambda: mark(f"{word()}.{num(2)}@{word()}.example.com")),
        (0, lambda: mark(f"{word()}@{word()}.org")),
        (0, lambda: mark(f"{word()}_{word()}+{word()}@{word()}-{word()}.co.uk")),
        (1, lambda: mark(".".join(str(r.randint(0, 255)) for _ in range(4)))),
        (1, lambda: r.choice(["host ", "ip ", "from ", ""]) + mark(":".join(pick("0123456789abcdef", r.randint(1, 4)) for _ in range(8)))),
        (2, lambda: mark(card())),
        (2, lambda: mark(grouped(card(), " "))),
        (2, lambda: mark(grouped(card(), "-"))),
        (2, lambda: mark(grouped(card(), "."))),
        (3, lambda: mark(f"+1 ({num(3)}) {num(3)}-{num(4)}")),
        (3, lambda: mark(f"+{r.randint(20, 60)} {num(3)} {num(6)}")),
        (3, lambda: call() + r.choice([" ", ": "]) + mark(f"{r.randint(2, 9)}{num(2)}-{num(3)}-{num(4)}")),
        (3, lambda: call() + r.choice([" ", ": "]) + mark(f"({r.randint(2, 9)}{num(2)}) {num(3)}-{num(4)}")),
        (3, lambda: call() + r.choice([" ", ": "]) + mark(f"{r.randint(2, 9)}{num(2)}.{num(3)}.{num(4)}")),
        (4, lambda: named() + sign() + quote(pick("0123456789abcdef", r.choice([16, 18, 24, 32, 40])))),
        (4, lambda: named() + sign() + quote(both(r.randint(10, 40)))),
        (4, lambda: named() + sign() + quote("-".join(both(r.randint(3, 6)) for _ in range(r.randint(2, 4))))),
        (4, lambda: mark("AKIA" + pick(up + "234567", 15) + r.choice("234567"))),
        (4, lambda: r.choice(["Bearer ", "token ", "jwt=", ""]) + mark("eyJ" + both(r.randint(12, 30)) + ".eyJ" + both(r.randint(20, 60)) + "." + both(r.randint(20, 43)))),
        (4, lambda: mark(r.choice(["sk_live_", "ghp_", "xoxb-", "pk_test_"]) + both(r.randint(20, 36)))),
        (-1, lambda: num(r.randint(1, 8))),
        (-1, lambda: f"{num(1)}.{num(1)}"),
        (-1, lambda: f"{num(2)}.{num(2)}.{num(4)}"),
        (-1, lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"),
        (-1, lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}:{r.randint(0, 59):02}"),
        (-1, lambda: f"{word()}{num(1)}"),
        (-1, lambda: f"version {num(1)}.{num(2)}.{num(1)}"),
        (-1, lambda: "1" + num(11)),
        (-1, lambda: f"${num(2)}.{num(2)}, pages {num(3)}-{num(3)}"),
        (-1, lambda: f"commit {pick('0123456789abcdef', 12)}"),
        (-1, lambda: f"sha1 {pick('0123456789abcdef', 40)}"),
        (-1, lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),
        (-1, lambda: f"{r.choice(['the', 'a', 'one'])} {r.choice(['token', 'password', 'key'])} of {num(4)}"),
        (-1, lambda: f"@{word()} and #{num(3)}"),
    ]
    out = []
    for _ in range(n):
        for kind, form in forms:
            before = " ".join(word() for _ in range(r.randint(1, 3)))
            text = f"{before} {form()}{r.choice(['', '', '.', ',', '###'])} {word()}"
            a, b = text.find("\x01"), text.find("\x02")
            out.append((text.replace("\x01", "").replace("\x02", ""), [] if kind < 0 else [(kind, a, b - 1)]))
    return out


def train(rows: list[tuple[str, list[Span]]]) -> np.ndarray:
    """Weights (features x kinds and outside) from windows of text and their gold spans."""
    w = np.zeros((BUCKETS + 1, len(KINDS) + 1))
    w[:BUCKETS, -1] = 0.2
    held = [x for x in (Example(*row) for row in rows if _TOKEN.search(row[0])) if x.whole]
    order = random.Random(5)
    for epoch in range(EPOCHS):
        order.shuffle(held)
        for x in held:
            x.learn(w, 0.1 / (1 + epoch))
    return w


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [t[a:b] for t in batch.column("text").to_pylist() if t for a, b in windows(t) if b - a <= TRAIN_CHARS]
        yield pa.RecordBatch.from_pydict({"part": pa.array(out, pa.string())})


def fit(docs: DataFrame) -> np.ndarray:
    """Train on the windows of ``TRAIN_DOCS`` documents, chosen by a hash of their id, and on made-up ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    chosen = map_arrow(rows.join(F.broadcast(ids), "doc_id", "left_semi"), _sample, "part string")
    parts = [r["part"] for r in chosen.orderBy(F.xxhash64("part"), "part").limit(TRAIN_WINDOWS).collect()]
    return train(examples() + [(t, _labels(t)) for t in parts])


def _all_spans(texts: list[str], w: np.ndarray) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans with those that the field adds, of each text."""
    parts, of = [], []
    for k, text in enumerate(texts):
        for lo, hi in windows(text):
            parts.append((text, lo, hi))
            of.append(k)
    added: list[list[Span]] = [[] for _ in texts]
    for k, found in zip(of, decode(parts, w)):
        added[k] += found
    out = []
    for text, more in zip(texts, added):
        base = base_spans(text)
        starts, reach = [], []  # of base spans in order: their starts, and the furthest end up to each
        for a, b in sorted((a, b) for _, a, b in base):
            starts.append(a)
            reach.append(max(b, reach[-1] if reach else 0))
        kept = []
        for k, a, b in more:
            before = bisect.bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                kept.append((k, a, b))
        out.append((base, sorted(base + kept)))
    return out


def spans_of(text: str, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    return _all_spans([text], w)[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, masked string, text_key long"


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the outermost area goes."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                texts = part.column("text").to_pylist()
                for text, (base, all_) in zip(texts, _all_spans([t or "" for t in texts], w)):
                    n = [sum(k == x for k, _, _ in base) for x in range(4)]
                    hidden = text if text is None or not all_ else masked(text, all_)
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), sum(k == 4 for k, _, _ in all_), hidden))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, part.column("text_key")], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> counts, digests, spans and the masked text of every row.

    ``text_key`` is xxhash64 of the text: with doc_id it tells which row an answer is for, also where ids are null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if weights is None else weights)  # BUCKETS rows
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")), _find(shared), FOUND)
