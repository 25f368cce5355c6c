"""Licence scans (operator 3).  DataFrame functions only.

Texts that name a licence (``MARK``) are staged once each, without HTML tags, by their hash; everything below is asked of
these few, and a row gets the answer of its text.  Units of such a text have a kind, each kind its own templates and weights:

- Notices: lines and, within them, what ". " ends, that name a licence.  Notices that wrap are units too: two or three lines
  of which only the last may end a sentence.  A licence expression behind ``IDENTIFIER`` is a unit for each identifier in it,
  without "-only", "-or-later", "+" and exceptions; it counts if all of them do, and then is the licence as it is written.
- Paragraphs of two lines or more, without comment marks, that name a licence, against those of usual file headers.
- Blocks: what comment marks enclose, and runs of lines that all begin with one, of ``BLOCK_TERMS`` or more, against whole
  licence texts; so a licence at the head of code is found.
- The whole text against whole licence texts.

Each unit's sparse TF-IDF vector is compared with those of its kind's templates by cosine, through a join on terms; terms
that no template has count in a unit's length with the largest weight.  A unit has the best template's licence if that has
``LEAST`` or more, and ``MARGIN`` more than any other licence.  Whole texts and blocks need ``TEXT_LEAST``, as common words
alone bring much, but no margin (GPL-3.0 and AGPL-3.0 are close); ties go to the first licence by name.

A text with a whole licence text is a licence file, and that is its own licence, whatever headers it has.  Otherwise its
licence is that of its best block, else of its best header.  It also is a licence file if what matches holds at least half
of its terms.

A directory's licence is that of its licence files (best cosine, then smallest doc_id).  A document without a licence of
its own gets that of the nearest directory above it that has one: directories, each once, are joined with those above
them on the path, and documents with their directory's answer.

Null texts have no header and may inherit.  Null paths inherit nothing.  Rows that repeat a doc_id are judged each by its
own text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import staged
from readloom.llm.license_texts import TEXTS

#: Usual one-sentence notices of public licences.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Names that a README's usual sentence has.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0 License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0 License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0 License"),
    ("CC0-1.0", "CC0 1.0 License"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
)
IDENTIFIER = "SPDX-License-Identifier: "
#: A notice, the licence's identifier, and a README's sentence, of each.
TEMPLATES = NOTICES + tuple((name, IDENTIFIER + name) for name, _ in NOTICES) + tuple((name, f"This project is licensed under the {x} - see the LICENSE file for details.") for name, x in NAMES)
#: The paragraphs of file headers that name the licence, as these licences recommend them.
HEADERS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Marks that begin a line of a comment.
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|;+|--+|%+|<!--+)?[ \t]*"
#: What parts enclosed comments from the rest, and a line that isn't a comment from the one before.
ENCLOSED, UNMARKED = r'/\*|\*/|<!--|-->|"""', r"\n(?![ \t]*(?:#|//|;|--|%|\*))"
TAG = r"</?[A-Za-z][^<>\n]*>"
EXPRESSION = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+(?:[ \t()]+(?:OR|AND|WITH)[ \t()]+[A-Za-z0-9.+-]+)*+)"
MARK = "(?i)licen[sc]|copyright|spdx|public domain"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST, TEXT_LEAST, MARGIN, BLOCK_TERMS, SALTS = 0.7, 0.9, 0.005, 50, 16
NOTICE, PARAGRAPH, BLOCK, WHOLE = range(4)
#: Templates, least cosine and margin of each kind of unit.
KINDS = {NOTICE: (TEMPLATES, LEAST, MARGIN), PARAGRAPH: (HEADERS, LEAST, MARGIN), BLOCK: (TEXTS, TEXT_LEAST, 0.0), WHOLE: (TEXTS, TEXT_LEAST, 0.0)}


def _of_kind(values: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("kind")]


def _terms(column: str) -> Column:
    return F.expr(f"regexp_extract_all(lower({column}), '{TERM}', 0)")


def _marked(column: str) -> Column:
    return F.col(column).rlike(MARK)


def _weighted(units: DataFrame, key: list[str], idf: DataFrame) -> DataFrame:
    """Rows of ``(kind, key, term, w)`` with the unit's length ``norm``."""
    key = ["kind", *key]
    tf = units.select(*key, F.explode(_terms("unit")).alias("term")).where("term is not null").groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    unknown = _of_kind({kind: math.log(1 + len(t)) + 1 for kind, (t, _, _) in KINDS.items()})
    w = tf.join(F.broadcast(idf), ["kind", "term"], "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown))
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key)


def compared(units: DataFrame) -> DataFrame:
    """``units(text_key, kind, unit_no, part, parts, expression, n_terms, unit)`` -> ``(text_key, kind, unit_no, n_terms, license,
    score)`` for those that have a licence."""
    known = units.sparkSession.createDataFrame([(kind, i, *t) for kind, (ts, _, _) in KINDS.items() for i, t in enumerate(ts)], "kind int, template int, license string, unit string")
    df = known.select("kind", "template", F.explode(F.array_distinct(_terms("unit"))).alias("term")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df"))
    n = _of_kind({kind: len(ts) for kind, (ts, _, _) in KINDS.items()})
    idf = df.select("kind", "term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))  # terms of the templates
    t = _weighted(known, ["template", "license"], idf).select("kind", "template", "license", "term", F.col("w").alias("tw"), F.col("norm").alias("tnorm"))
    of = ["text_key", "unit_no", "part", "parts", "expression", "n_terms"]
    cos = _weighted(units, of, idf).join(F.broadcast(t), ["kind", "term"]).groupBy("kind", *of, "template", "license").agg((F.sum(F.col("w") * F.col("tw")) / F.first(F.col("norm") * F.col("tnorm"))).alias("score"))
    by = cos.groupBy("kind", *of, "license").agg(F.max(F.round("score", 4)).alias("score"))
    order = Window.partitionBy("text_key", "kind", "unit_no", "part").orderBy(F.col("score").desc(), "license")  # a row for each licence
    least, margin = _of_kind({kind: x for kind, (_, x, _) in KINDS.items()}), _of_kind({kind: round(x * 10000) for kind, (_, _, x) in KINDS.items()})
    gap = F.round((F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))) * 10000)
    best = by.withColumns({"r": F.row_number().over(order), "gap": gap}).where((F.col("r") == 1) & (F.col("score") >= least) & (F.col("gap") >= margin))
    whole = best.groupBy("text_key", "kind", "unit_no").agg(F.max("n_terms").alias("n_terms"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"), F.coalesce(F.nullif(F.max("expression"), F.lit("")), F.max("license")).alias("license"), F.min("score").alias("score"))
    return whole.where("n = parts").drop("n", "parts")


def notices(marked: DataFrame) -> DataFrame:
    """Units of one sentence, wrapped ones with negative numbers, and identifiers."""
    single = marked.select("text_key", F.posexplode(F.split(F.expr("replace(text, '. ', '.\\n')"), "\n")).alias("unit_no", "unit"))
    # the last sentence of a line that goes on, and the first of the line it ends in
    lines = marked.withColumn("l", F.split("text", "\r?\n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("l") - 1)))
    a, b, c = F.expr("element_at(split(l[i], '[.] '), -1)"), F.expr("get(l, i + 1)"), F.expr("get(l, i + 2)")
    ends, first = "[.!?]\\s*$|^\\W*$", lambda x: F.split(x, "(?<=[.]) ")[0]
    two = F.when(~a.rlike(ends) & ~b.rlike("^\\W*$"), F.concat_ws(" ", a, first(b)))
    three = F.when(~a.rlike(ends) & ~b.rlike(ends + "|[.] ") & ~c.rlike("^\\W*$"), F.concat_ws(" ", a, b, first(c)))
    wrapped = lines.select("text_key", F.explode(F.array(F.struct((-2 * F.col("i") - 1).alias("unit_no"), two.alias("unit")), F.struct((-2 * F.col("i") - 2).alias("unit_no"), three.alias("unit")))).alias("x")).select("text_key", "x.*")
    units = single.unionByName(wrapped).where(_marked("unit")).withColumn("n_terms", F.size(_terms("unit")))
    expression = F.regexp_replace(F.regexp_extract("unit", EXPRESSION, 1), r"(?i)[ \t()]+WITH[ \t()]+[A-Za-z0-9.+-]+", "")
    units = units.withColumn("expression", F.when(F.col("unit_no") >= 0, expression)).withColumn("ids", F.split("expression", r"(?i)[ \t()]+(?:OR|AND)[ \t()]+"))
    named = F.transform("ids", lambda x: F.concat(F.lit(IDENTIFIER), F.regexp_replace(x, r"(?i)(?:-only|-or-later|\+)$", "")))
    pieces = F.when(F.coalesce("expression", F.lit("")) != "", named).otherwise(F.array("unit"))
    return units.select("text_key", F.lit(NOTICE).alias("kind"), "unit_no", F.size(pieces).alias("parts"), F.when(F.size(pieces) > 1, F.col("expression")).otherwise("").alias("expression"), "n_terms", F.posexplode(pieces).alias("part", "unit"))


def paragraphs(marked: DataFrame) -> DataFrame:
    """Paragraphs without comment marks that name a licence."""
    bare = marked.select("text_key", F.regexp_replace("text", COMMENT, "").alias("text"))
    units = bare.select("text_key", F.lit(PARAGRAPH).alias("kind"), F.posexplode(F.split("text", "\\n\\s*\\n")).alias("unit_no", "unit"))
    return _one(units.where(_marked("unit") & F.col("unit").contains("\n")))


def blocks(marked: DataFrame) -> DataFrame:
    """Comments long enough for a licence text, and each whole text."""
    parts = lambda how, sign: marked.select("text_key", F.lit(BLOCK).alias("kind"), F.posexplode(F.split("text", how)).alias("unit_no", "unit"), F.lit(sign).alias("sign"))
    found = parts(ENCLOSED, 1).unionByName(parts(UNMARKED, -1)).where(_marked("unit")).withColumn("unit", F.regexp_replace("unit", COMMENT, ""))
    found = _one(found.withColumn("unit_no", F.col("sign") * (F.col("unit_no") + 1)).drop("sign")).where(F.col("n_terms") >= BLOCK_TERMS)
    return found.unionByName(_one(marked.select("text_key", F.lit(WHOLE).alias("kind"), F.lit(0).alias("unit_no"), F.col("text").alias("unit"))))


def _one(units: DataFrame) -> DataFrame:
    return units.withColumns({"part": F.lit(0), "parts": F.lit(1), "expression": F.lit(""), "n_terms": F.size(_terms("unit"))})


def scan(files: DataFrame) -> DataFrame:
    """``files(doc_id, path, text)`` -> ``(doc_id, path, own_license, own_score, license_file, license, license_dir)``."""
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), text_key)
    marked = staged(files.where(_marked("text")).select(text_key, F.regexp_replace("text", TAG, " ").alias("text")).dropDuplicates(["text_key"]), "marked")
    found = compared(notices(marked).unionByName(paragraphs(marked)).unionByName(blocks(marked)))
    header = F.col("kind") == NOTICE
    rank = F.struct(F.col("kind") == WHOLE, F.col("kind") == BLOCK, "score", header, F.col("unit_no") >= 0, -F.abs("unit_no"))
    own = found.groupBy("text_key").agg(
        F.max_by(F.struct("license", "score"), rank).alias("best"),
        F.greatest(F.sum(F.when(header & (F.col("unit_no") >= 0), F.col("n_terms"))), F.max(F.when(F.col("kind") != WHOLE, F.col("n_terms")))).alias("covered"),
        F.bool_or(F.col("kind") == WHOLE).alias("whole"),
    )
    terms = marked.select("text_key", F.size(_terms("text")).alias("terms"))
    own = own.join(terms, "text_key").select("text_key", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"), (F.col("whole") | F.coalesce(2 * F.col("covered") >= F.col("terms"), F.lit(False))).alias("license_file"))
    # one text may be that of very many rows: these are spread, and the few answers repeated
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = salted.join(own, ["text_key", "salt"], "left").drop("text_key", "salt").withColumn("license_file", F.coalesce("license_file", F.lit(False)))
    homes = judged.where("license_file and dir is not null").groupBy("dir").agg(F.max_by("own_license", F.struct("own_score", -F.col("doc_id"))).alias("dir_license"))
    dirs = rows.select("dir").where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("up", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    near = above.join(homes.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("dir_license", "up"), "depth").alias("near"))
    out = judged.join(near, "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "own_score", "license_file", F.coalesce("own_license", "near.dir_license").alias("license"), F.when(inherits, F.col("near.up")).alias("license_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: ``/source/<doc_id div 100>/<doc_id>``."""
    return docs.select("doc_id", F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
