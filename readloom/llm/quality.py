"""Quality rules with compression bands (operator 9).

zstandard ratios (bytes before / bytes after) of the whole text and of fixed chunks must lie in a band that depends on the
length: above it a text repeats itself, below it it is incompressible (keys, encoded bytes).  A document falls when its
whole text is outside its band, or when more than ``CHUNK_SHARE`` of its chunks (by bytes) are outside the chunks' bands.

Null and empty texts, and texts without words, have n_words 0 and so fail the base rules.  Every row is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow
from readloom.llm.textnp import SPACED, blocks

#: (bytes below which the row holds, least ratio, largest ratio).  Ratios of prose rise with length, as a compressor learns.
BANDS = ((64, 0.50, 1.60), (256, 0.75, 2.60), (1024, 1.15, 3.00), (4096, 1.40, 3.60), (16384, 1.50, 4.20), (1 << 62, 1.60, 5.00))
CHUNK_BYTES, CHUNK_SHARE, LEVEL = 4096, 0.25, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunk_share double"


def in_band(size: int, ratio: float) -> bool:
    return next(lo <= ratio <= hi for below, lo, hi in BANDS if size < below)


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(w, n: int, k: int = 5) -> np.ndarray:
    """Words of each text inside k-word windows that the text holds twice or more."""
    at, h = w.grams(k)
    doc = w.doc[at]
    order = np.lexsort((h, doc))
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        d, g = doc[order], h[order]
        eq = (d[1:] == d[:-1]) & (g[1:] == g[:-1])
        same[1:] |= eq
        same[:-1] |= eq
    edge = np.zeros(len(w.hash) + k + 1, np.int64)
    twice = at[order[same]]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return _sums(np.cumsum(edge[: len(w.hash)]) > 0, w.first)


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for block in blocks(batch.column("text")):
            w = block.words(SPACED)
            data, offs = block.data, block.offs
            char = SPACED[data] & ((data & 0xC0) != 0x80)
            repeat = _repeated(w, block.n)
            dup, ratio, odd = np.zeros(block.n, np.int64), np.ones(block.n), np.zeros(block.n)
            whole = data.tobytes()
            fine = np.ones(block.n, bool)
            for d in range(block.n):
                text = whole[offs[d] : offs[d + 1]]
                if not text:
                    continue
                dup[d] = _dup_lines(text)
                ratio[d] = len(text) / len(z.compress(text))
                if len(text) > CHUNK_BYTES:
                    parts = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
                    odd[d] = sum(len(p) for p in parts if not in_band(len(p), len(p) / len(z.compress(p)))) / len(text)
                fine[d] = in_band(len(text), ratio[d]) and odd[d] <= CHUNK_SHARE
            failed = (w.count < 10) | (100 * repeat > 20 * w.count)
            columns = [batch.column("doc_id").slice(block.lo, block.n), w.count, _sums(char, offs), _sums(_SYMBOL[data], offs), dup, repeat, failed, ~failed & fine, ratio, odd]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in COLUMNS.split(", ")])


def quality(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row of counts, ratios and verdicts for each input row."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _rules, COLUMNS)
