"""Column expressions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(seq: str | Column) -> Column:
    """Upper-case A, C, G, T; every other byte is N, so one character of several bytes is as many N."""
    c = F.col(seq) if isinstance(seq, str) else seq
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))
    return F.regexp_replace(F.translate(plain, "acgt", "ACGT"), "[^ACGT]", "N")


def code(gram: Column) -> Column:
    """The 2-bit code of a gram of A, C, G, T, the first base most significant; base 4 read as a number."""
    return F.conv(F.translate(gram, "ACGT", "0123"), 4, 10).cast("long")


def edge_score(support: Column, total: Column) -> Column:
    return F.log((support + 1) / (total + 4)) + 0.15 * F.log1p(support)


def start_score(support: Column, total: Column, kinds: Column) -> Column:
    return F.log((support + 1) / (total + F.greatest(F.lit(1), kinds))) + 0.15 * F.log1p(support)


def sigma(n: Column, logs: Column, squares: Column) -> Column:
    mu = logs / n
    return F.greatest(F.lit(0.08), F.sqrt(F.greatest(F.lit(0.0), squares / n - mu * mu)))


def tolerance(median: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(0.15 * median + 0.5))


def length_score(length: Column, n: Column, logs: Column, squares: Column, median: Column, prior: str = "lognormal") -> Column:
    if prior == "median_band":
        return -0.75 * F.abs(length - median) / tolerance(median)
    z = (F.log(F.greatest(F.lit(1), length)) - logs / n) / sigma(n, logs, squares)
    return -0.375 * z * z


def window(k: int, n: Column, logs: Column, squares: Column, median: Column, prior: str = "lognormal") -> tuple[Column, Column]:
    """Lengths from which candidates of the reads' own lengths are taken."""
    if prior == "median_band":
        return F.greatest(F.lit(k), F.floor(median) - tolerance(median)), F.greatest(F.lit(k), F.ceil(median) + tolerance(median))
    mu, s = logs / n, sigma(n, logs, squares)
    low = F.greatest(F.lit(k), F.floor(F.exp(mu - 2 * s)), F.floor(0.60 * median))
    return low, F.greatest(low, F.least(F.ceil(F.exp(mu + 2 * s)), F.ceil(1.50 * median)))


def bucket(score: Column) -> Column:
    """Scores are compared as whole numbers of 1e-12; not finite or too large ones are errors."""
    x = score * 1e12
    bad = F.isnan(score) | (F.abs(x) >= 9.2e18)
    return F.when(bad, F.raise_error(F.lit("score is not finite"))).otherwise(F.round(x).cast("long"))


def safe_name(c: Column) -> Column:
    """A file name of letters, digits, ``_.-``; ``run`` where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("run"))
