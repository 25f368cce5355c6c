"""Word splitting and hashing of whole Arrow text columns with numpy, without a Python loop over words.

Texts are taken in blocks of a bounded number of bytes (one longer text is a block of its own).  A word's hash is a
prefix-sum polynomial over random 64-bit byte values, so a word costs two look-ups; very long ones are hashed byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20250701))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK_BYTES = 1 << 20

#: Byte classes: True is a word byte.  Bytes of multi-byte UTF-8 characters are 0x80 and above.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, 2 * BLOCK_BYTES)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, U), np.full(size, _BASE_INV, U)
            up[0] = down[0] = U(1)
            _powers.update(up=np.cumprod(up, dtype=U), down=np.cumprod(down, dtype=U))
    return _powers["up"], _powers["down"]


class Block:
    """Some consecutive texts: ``data`` bytes, ``offs`` (one more than texts), ``lo`` the first text's row."""

    def __init__(self, lo: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.data, self.offs, self.n = lo, data, offs, len(offs) - 1

    def words(self, word: np.ndarray, lower: bool = False) -> Words:
        return Words(self, word, lower)


#: Bytes from which a word's hash is taken from its bytes one by one.
LONG_WORD = 512


class Words:
    """``start``/``end`` bytes, ``doc`` (index within the block) and ``hash`` of each word; ``first``: each text's first word."""

    def __init__(self, b: Block, word: np.ndarray, lower: bool):
        data = LOWER[b.data] if lower else b.data
        m = word[data]
        n = len(m)
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, m[:-1]
            after[-1], after[:-1] = False, m[1:]
            at = b.offs[:-1]
            before[at[at < n]] = False
            at = b.offs[1:] - 1
            after[at[at >= 0]] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.doc = np.searchsorted(b.offs, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=b.n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        up, down = _power(n)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))
        # long words can be made that every polynomial modulo 2^64 takes as equal
        for i in np.flatnonzero(self.end - self.start >= LONG_WORD):
            self.hash[i] = xxhash.xxh3_64_intdigest(data[self.start[i] : self.end[i]].tobytes())

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        h = np.zeros(n, U)
        for j in range(k):
            h += self.hash[j : j + n] * _MULT[j % 64]
            if j % 64 == 63:
                h = mix(h)
        return at, mix(h[at] + U(k))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Block(lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def segments(doc: np.ndarray, n: int) -> np.ndarray:
    """Row bounds of each of n texts in a sorted array of text indices."""
    return np.searchsorted(doc, np.arange(n + 1))
