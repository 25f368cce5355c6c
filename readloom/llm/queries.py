"""One query for each operator, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontaminate, language, licenses, minhash, packing, pii, quality, sharding, substring, vectors, warc, whitening
from readloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("masked", "text_key")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.accepted(table(spark, sf_dir, "documents")).drop("text_key")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(table(spark, sf_dir, "documents"), window=13).drop("kept_text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive(table(spark, sf_dir, "pages"))
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    response = F.col("record_type") == "response"
    return got.where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"),
        # of what was read back; a revisit has no payload and keeps the response's header fields
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_minhash, op3_licenses, op4_language, op5_substring, op6_warc, op7_decontaminate, op8_sharding, op9_quality, op10_packing, op11_vectors, op12_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^ \t\n\v\f\r]+'"

_OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

_OP5 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low ON low.t = win.t AND low.d < win.doc_id)),
pos AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos ANTI JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to FROM r
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, len(ws[i:i + 9]) AS n, array_to_string(ws[i:i + 9], ' ') AS t
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, size)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON win.n = dw.n AND win.t = dw.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items.t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_TEMPLATES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(licenses.TEMPLATES))
_TERM = licenses.TERM
_OP3 = rf"""
WITH f AS (SELECT doc_id, '/' || source || '/' || CAST(doc_id // 100 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS path,
             '/' || source || '/' || CAST(doc_id // 100 AS VARCHAR) AS dir, '/' || source AS top, regexp_replace(coalesce(text, ''), '{licenses.TAG}', ' ', 'g') AS text FROM documents),
t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS v(template, license, unit)),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(unit), '{_TERM}')) AS term FROM t) GROUP BY 1, 2, 3),
idf AS (SELECT term, ln({1 + len(licenses.TEMPLATES)}.0 / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
u0 AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS unit, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), 1) AS unit_no
       FROM f WHERE regexp_matches(text, '{licenses.MARK}')),
u AS (SELECT *, regexp_extract_all(lower(unit), '{_TERM}') AS terms FROM u0 WHERE regexp_matches(unit, '{licenses.MARK}')),
ht AS (SELECT doc_id, unit_no, term, count(*) AS tf FROM (SELECT doc_id, unit_no, unnest(terms) AS term FROM u) GROUP BY 1, 2, 3),
hw AS (SELECT doc_id, unit_no, term, tf * coalesce(idf, ln({1 + len(licenses.TEMPLATES)}.0) + 1) AS w FROM ht LEFT JOIN idf USING (term)),
hn AS (SELECT doc_id, unit_no, sqrt(sum(w * w)) AS norm FROM hw GROUP BY 1, 2),
cos AS (SELECT hw.doc_id, hw.unit_no, tw.template, tw.license, round(sum(hw.w * tw.w) / any_value(hn.norm * tn.norm), 4) AS score
        FROM hw JOIN tw USING (term) JOIN hn ON hn.doc_id = hw.doc_id AND hn.unit_no = hw.unit_no JOIN tn ON tn.template = tw.template GROUP BY 1, 2, 3, 4),
lic AS (SELECT doc_id, unit_no, license, max(score) AS score FROM cos GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER o AS r, coalesce(lead(score) OVER o, 0) AS second FROM lic WINDOW o AS (PARTITION BY doc_id, unit_no ORDER BY score DESC, license))
         WHERE r = 1 AND score >= {licenses.LEAST} AND round((score - second) * 10000) >= {round(licenses.MARGIN * 10000)}),
own AS (SELECT * FROM (SELECT doc_id, license AS own_license, score AS own_score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, unit_no) AS r FROM best) WHERE r = 1),
covered AS (SELECT best.doc_id, sum(len(u.terms)) AS c FROM best JOIN u ON u.doc_id = best.doc_id AND u.unit_no = best.unit_no GROUP BY 1),
j AS (SELECT f.*, own_license, own_score, coalesce(2 * c >= len(regexp_extract_all(lower(f.text), '{_TERM}')), FALSE) AS license_file
      FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN covered ON covered.doc_id = f.doc_id),
home AS (SELECT dir, own_license AS dir_license FROM (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, doc_id) AS r FROM j WHERE license_file) WHERE r = 1)
SELECT j.doc_id, j.path, own_license, own_score, license_file, coalesce(own_license, a.dir_license, b.dir_license) AS license,
       CASE WHEN own_license IS NULL THEN coalesce(a.dir, b.dir) END AS license_dir
FROM j LEFT JOIN home a ON a.dir = j.dir LEFT JOIN home b ON b.dir = j.top
"""

_OP11 = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, node) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.node),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM e JOIN (SELECT vec_id, min(node) AS c FROM r GROUP BY vec_id) m ON m.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""

ORACLE_SQL = {"op2_minhash": _OP2, "op3_licenses": _OP3, "op5_substring": _OP5, "op6_warc": _OP6, "op7_decontaminate": _OP7, "op11_vectors": _OP11}
