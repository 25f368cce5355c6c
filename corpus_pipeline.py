"""Corpus pipeline: documents to packed training sequences, each stage by one training-data operator.

Stages but the last return the columns of ``documents``, for the rows that stay.  Wholly equal rows stay once after
near-dedup.  Rows with null or repeated doc_ids are judged as each stage says.  An empty table passes through as an empty one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontaminate, language, minhash, packing, pii
from readloom.llm.common import staged, table
from readloom.llm.queries import tokenizer_path

#: Words of a shingle and least similarity in percent, of near duplicates.
SHINGLE, SIMILAR = 5, 80
#: Words of a benchmark passage.
PASSAGE = 10


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _text_key() -> Column:
    return F.xxhash64("text")


def _same(docs: DataFrame, found: DataFrame, on: dict[str, Column], *more: str) -> tuple[DataFrame, Column]:
    """``found`` with its columns ``on`` renamed, once for each value of them, and the condition, true of nulls too, that joins it to ``docs``."""
    names = {c: _free(docs, f"_found_{c}") for c in on}
    right = found.select(*[F.col(c).alias(n) for c, n in names.items()], *more).dropDuplicates(list(names.values()))
    return right, reduce(lambda x, y: x & y, [e.eqNullSafe(F.col(names[c])) for c, e in on.items()])


def _without(docs: DataFrame, found: DataFrame, **on: Column) -> DataFrame:
    """Rows of ``docs`` whose values ``on`` no row of ``found`` has."""
    right, same = _same(docs, found, on)
    return docs.join(right, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the language models accept, each by itself, also where doc_ids are null or repeated."""
    rejected = language.accepted(docs).where("not accepted")
    return _without(docs, rejected, doc_id=F.col("doc_id").cast("long"), text_key=_text_key())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates.

    Rows that are equal but for columns of maps, which can't be compared, stay once.  Rows that share a doc_id are one
    document with several texts, which goes as a whole when one of them has a near duplicate of a smaller doc_id.  Rows
    without a doc_id can't be ranked and stay.
    """
    left = _without(docs, minhash.near_duplicates(docs, SHINGLE, SIMILAR).where("not kept"), doc_id=F.col("doc_id").cast("long"))
    return left.dropDuplicates([f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no passage of the benchmark; texts go by their xxhash64, so that null and repeated doc_ids matter nothing."""
    texts = docs.select(_text_key().alias("doc_id"), "text")
    hit = decontaminate.contamination(texts, table(spark, sf_dir, "benchmark"), PASSAGE).where("contaminated")
    return _without(docs, hit, doc_id=_text_key())


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; personal data in their texts gives way to its kind, and n_chars follows.  Null and repeated doc_ids are told apart by text."""
    new = _free(docs, "_masked")
    found = staged(pii.find(docs).where("spans <> ''").select("doc_id", "text_key", F.col("masked").alias(new)), "masked")
    right, same = _same(docs, found, {"doc_id": F.col("doc_id").cast("long"), "text_key": _text_key()}, new)
    hidden = docs.join(right, same, "left").withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return hidden.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", hide_pii), ("packing", pack)]

#: Language models and fields learned here, and a tokenizer's ids, are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
