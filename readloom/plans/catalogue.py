"""Named queries over reads derived from the events table, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom.functions import columns as C
from readloom.operators import decode as de
from readloom.operators import evaluate as ev
from readloom.operators import evidence as e
from readloom.operators import order as od
from readloom.operators import pool as po
from readloom.operators import prefix, store
from readloom.operators import validate as va
from readloom.operators.clustered import decode_in_place
from readloom.plans.staging import scratch
from readloom.schema import READS, Config
from readloom.sources import tsv
from readloom.sources.derived import LENGTH, event_reads
from readloom.streaming.maps import state_store, stream_clusters
from readloom.streaming.reads import stream_decode, stream_multiplicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 9

_READS = f"""
ev AS (SELECT event_id AS e, user_id AS u, ts, 1 + (7 * event_id) % {LENGTH} AS p,
         translate(md5('t0:' || CAST(user_id AS VARCHAR)) || md5('t1:' || CAST(user_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS t FROM events),
s1 AS (SELECT *, CASE e % 5 WHEN 2 THEN substr(t, 1, p - 1) || translate(substr(t, p, 1), 'ACGT', 'CGTA') || substr(t, p + 1)
         WHEN 3 THEN substr(t, 1, p - 1) || substr(t, p + 1) WHEN 4 THEN substr(t, 1, p) || 'G' || substr(t, p + 1) ELSE t END AS a FROM ev),
s2 AS (SELECT *, CASE WHEN e % 13 = 0 THEN substr(a, 1, p - 1) || 'N' || substr(a, p + 1) ELSE a END AS b FROM s1),
reads AS (SELECT CAST(u AS VARCHAR) AS cluster_id, CAST(e AS VARCHAR) AS read_id, e, ts, t AS truth, {LENGTH} AS design_length,
            CASE WHEN e % 11 = 0 THEN lower(b) ELSE b END AS read_sequence FROM s2),
c AS (SELECT *, regexp_replace(translate(read_sequence, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM reads),
m AS (SELECT cluster_id, design_length, seq, count(*) AS n FROM c GROUP BY ALL)"""


def _grams(name: str, size: int) -> str:
    return f"""
{name} AS (SELECT cluster_id, seq, n, i AS pos, substr(seq, i, {size}) AS gram FROM (SELECT *, unnest(range(1, length(seq) - {size} + 2)) AS i FROM m)
  WHERE substr(seq, i, {size}) NOT LIKE '%N%')"""


def _evidence(k: int) -> str:
    return f"""{_READS},{_grams("gk", k)},{_grams("gk1", k + 1)},
node AS (SELECT cluster_id, gram AS context, CAST(sum(n) AS BIGINT) AS support FROM gk GROUP BY ALL),
edge AS (SELECT cluster_id, substr(gram, 1, {k}) AS context, substr(gram, {k + 1}, 1) AS base, CAST(sum(n) AS BIGINT) AS support FROM gk1 GROUP BY ALL),
outg AS (SELECT cluster_id, context, CAST(sum(support) AS BIGINT) AS support FROM edge GROUP BY ALL),
term AS (SELECT cluster_id, seq, max(n) AS n, arg_min(gram, pos) AS a, arg_max(gram, pos) AS z FROM gk GROUP BY ALL),
start_ AS (SELECT cluster_id, a AS context, CAST(sum(n) AS BIGINT) AS support FROM term GROUP BY ALL),
end_ AS (SELECT cluster_id, z AS context, CAST(sum(n) AS BIGINT) AS support FROM term GROUP BY ALL),
stat AS (SELECT cluster_id, CAST(count(*) AS BIGINT) AS reads, CAST(count(*) FILTER (WHERE length(seq) = design_length) AS BIGINT) AS exact_reads,
           sum(ln(length(seq))) AS ls, sum(ln(length(seq)) * ln(length(seq))) AS lq, median(length(seq)) AS med FROM c GROUP BY cluster_id)"""


def _code(c: str, k: int) -> str:
    return f"list_sum(list_transform(range(1, {k + 1}), lambda i: CAST(instr('ACGT', substr({c}, i, 1)) - 1 AS BIGINT) * CAST(pow(4, {k} - i) AS BIGINT)))"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_reads(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + sql
        return f

    return add


@_query(f"{_READS} SELECT cluster_id, read_id, seq FROM c")
def canonical_reads(spark, d):
    return reads(spark, d).select("cluster_id", "read_id", C.canonical("read_sequence").alias("seq"))


@_query(f"{_READS} SELECT cluster_id, design_length, seq, n FROM m")
def read_multiplicity(spark, d):
    return e.multiplicity(reads(spark, d))


@_query(f"{_evidence(K)} SELECT * FROM node")
def node_counts(spark, d):
    r = reads(spark, d)
    return e.nodes(e.multiplicity(r), K, e.tasks(r))


@_query(f"{_evidence(K)} SELECT * FROM edge")
def edge_counts(spark, d):
    r = reads(spark, d)
    return e.edges(e.multiplicity(r), K, e.tasks(r))


@_query(f"{_evidence(K)} SELECT * FROM outg")
def outgoing_counts(spark, d):
    r = reads(spark, d)
    return e.outgoing(e.edges(e.multiplicity(r), K, e.tasks(r)))


@_query(f"{_evidence(K)} SELECT cluster_id, 'start' AS side, context, support FROM start_ UNION ALL SELECT cluster_id, 'end', context, support FROM end_")
def start_end_support(spark, d):
    m = e.multiplicity(reads(spark, d))
    return e.starts(m, K).withColumn("side", F.lit("start")).unionByName(e.ends(m, K).withColumn("side", F.lit("end")))


_LEDGER = " UNION ALL ".join(f"SELECT cluster_id, {i} AS kind, {_code(g, n)} AS code, support FROM {t}" for i, t, g, n in ((0, "node", "context", K), (1, "edge", "context || base", K + 1), (2, "outg", "context", K), (3, "start_", "context", K), (4, "end_", "context", K)))


@_query(f"{_evidence(K)} SELECT cluster_id, kind, CAST(code AS BIGINT) AS code, support FROM ({_LEDGER})")
def ledger_long(spark, d):
    r = reads(spark, d)
    return e.ledger(e.multiplicity(r), K, e.tasks(r))


@_query(f"{_evidence(K)} SELECT cluster_id, kind, CAST(code AS BIGINT) AS code, support FROM ({_LEDGER})")
def merge_equals_serial(spark, d):
    r = reads(spark, d)
    block = F.pmod(F.xxhash64("read_id"), F.lit(2))
    return e.merge(*[e.ledger(e.multiplicity(r.where(block == i)), K, e.tasks(r)) for i in range(2)])


@_query(f"{_evidence(K)} SELECT cluster_id, reads, exact_reads, round(ls, 6) AS log_sum, round(lq, 6) AS log_sq_sum, CAST(med AS DOUBLE) AS median_length FROM stat")
def length_stats(spark, d):
    s = e.length_stats(reads(spark, d))
    return s.withColumn("log_sum", F.round("log_sum", 6)).withColumn("log_sq_sum", F.round("log_sq_sum", 6))


def _window_sql(prior: str) -> str:
    if prior == "median_band":
        tol = "greatest(3, floor(0.15 * med + 0.5))"
        return f"win AS (SELECT cluster_id, CAST(greatest({K}, floor(med) - {tol}) AS BIGINT) AS lo, CAST(greatest({K}, ceil(med) + {tol}) AS BIGINT) AS hi FROM stat)"
    return f"""prior AS (SELECT *, ls / reads AS mu, greatest(0.08, sqrt(greatest(0.0, lq / reads - (ls / reads) * (ls / reads)))) AS sg FROM stat),
low AS (SELECT *, greatest({K}, floor(exp(mu - 2 * sg)), floor(0.60 * med)) AS lo0 FROM prior),
win AS (SELECT cluster_id, CAST(lo0 AS BIGINT) AS lo, CAST(greatest(lo0, least(ceil(exp(mu + 2 * sg)), ceil(1.50 * med))) AS BIGINT) AS hi FROM low)"""


def _window_query(prior: str) -> Query:
    def run(spark, d):
        s = e.length_stats(reads(spark, d))
        lo, hi = C.window(K, F.col("reads"), F.col("log_sum"), F.col("log_sq_sum"), F.col("median_length"), prior)
        return s.select("cluster_id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    run.__name__ = "length_window" + ("_median_band" if prior == "median_band" else "")
    return run


for _p in ("lognormal", "median_band"):
    _query(f"{_evidence(K)}, {_window_sql(_p)} SELECT * FROM win")(_window_query(_p))


@_query(f"{_evidence(K)} SELECT edge.cluster_id, edge.context, base, round(ln((edge.support + 1.0) / (outg.support + 4.0)) + 0.15 * ln(1.0 + edge.support), 9) AS score FROM edge JOIN outg ON outg.cluster_id = edge.cluster_id AND outg.context = edge.context")
def edge_scores(spark, d):
    edge = e.edges(e.multiplicity(reads(spark, d)), K)
    total = e.outgoing(edge).withColumnRenamed("support", "total")
    return edge.join(total, ["cluster_id", "context"]).select("cluster_id", "context", "base", F.round(C.edge_score(F.col("support"), F.col("total")), 9).alias("score"))


_STARTS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY support DESC, context) AS place,
   sum(support) OVER (PARTITION BY cluster_id) AS total, count(*) OVER (PARTITION BY cluster_id) AS kinds FROM start_)"""


@_query(f"{_evidence(K)}, {_STARTS} SELECT cluster_id, context, support, CAST(place AS INT) AS place, round(ln((support + 1.0) / (total + greatest(1, kinds))) + 0.15 * ln(1.0 + support), 9) AS score FROM ranked WHERE place <= 16")
def start_topk(spark, d):
    s = e.top_starts(e.multiplicity(reads(spark, d)), K)
    return s.select("cluster_id", "context", "support", "place", F.round(C.start_score(F.col("support"), F.col("total"), F.col("kinds")), 9).alias("score"))


def _favourite_sql(where: str) -> str:
    return f"SELECT cluster_id, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, seq) AS r FROM m {where}) WHERE r = 1"


@_query(f"{_READS} {_favourite_sql('')}")
def fallback_read(spark, d):
    return e.most_frequent_read(e.multiplicity(reads(spark, d)))


@_query(f"{_READS} {_favourite_sql('WHERE length(seq) = design_length')}")
def exact_length_read(spark, d):
    return e.most_frequent_read(e.multiplicity(reads(spark, d)), exact=True)


def _band_sql(cfg: Config) -> str:
    """Walks along the most frequent bases; ``band``: steps ``lo`` to ``hi - 1`` have the whole beam."""
    k, w, steps = cfg.k, cfg.band, LENGTH - cfg.k
    return f"""
succ AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, context ORDER BY support DESC, base) AS r FROM edge),
ahead AS (SELECT cluster_id, context, max(base) FILTER (WHERE r = 1) AS base,
   CAST(1 + max(support) FILTER (WHERE r = 1) AS DOUBLE) / CAST(1 + max(support) FILTER (WHERE r = 2) AS DOUBLE) AS lead FROM succ GROUP BY ALL),
walk(cluster_id, t, context, base, lead) AS (
  SELECT s.cluster_id, 0, s.context, a.base, a.lead FROM ranked s JOIN ahead a ON a.cluster_id = s.cluster_id AND a.context = s.context WHERE s.place = 1
  UNION ALL
  SELECT w.cluster_id, w.t + 1, a.context, a.base, a.lead FROM walk w JOIN ahead a ON a.cluster_id = w.cluster_id AND a.context = substr(w.context, 2) || w.base WHERE w.t + 1 < {steps}),
weak AS (SELECT r.cluster_id, coalesce(min(x.t), 0) AS t FROM (SELECT DISTINCT cluster_id FROM ranked) r LEFT JOIN
  (SELECT cluster_id, t, row_number() OVER (PARTITION BY cluster_id ORDER BY lead, t) AS p FROM walk WHERE lead IS NOT NULL) x ON x.cluster_id = r.cluster_id AND x.p = 1 GROUP BY ALL),
band AS (SELECT cluster_id, greatest(0, least({steps}, greatest(0, t - {w // 2}) + {w}) - {w}) AS lo, least({steps}, greatest(0, t - {w // 2}) + {w}) AS hi FROM weak),"""


def _beam_sql(cfg: Config) -> str:
    k, L = cfg.k, LENGTH
    bands, join, width = "", "", lambda t: str(cfg.beam)
    if cfg.band:
        bands, join = _band_sql(cfg), "JOIN band ON band.cluster_id = {}.cluster_id"
        width = lambda t: f"CASE WHEN {t} >= lo AND {t} < hi THEN {cfg.beam} ELSE 1 END"
    if cfg.prior == "median_band":
        score = "-0.75 * abs(b.len - stat.med) / greatest(3, floor(0.15 * stat.med + 0.5))"
        window = _window_sql("median_band")
    else:
        score = "-0.375 * ((ln(b.len) - prior.mu) / prior.sg) * ((ln(b.len) - prior.mu) / prior.sg)"
        window = _window_sql("lognormal")
    window = window.replace(f"greatest({K},", f"greatest({k},")
    prior = "" if cfg.prior == "median_band" else "JOIN prior ON prior.cluster_id = b.cluster_id"
    return f"""{_evidence(k)}, {_STARTS}, {window},{bands}
gain AS (SELECT edge.cluster_id, edge.context, base, ln((edge.support + 1.0) / (outg.support + 4.0)) + 0.15 * ln(1.0 + edge.support) AS g FROM edge JOIN outg ON outg.cluster_id = edge.cluster_id AND outg.context = edge.context),
beam(cluster_id, len, path, cum) AS (
  SELECT ranked.cluster_id, {k}, context, ln((support + 1.0) / (total + greatest(1, kinds))) + 0.15 * ln(1.0 + support) FROM ranked {join.format("ranked")} WHERE place <= {width("0")}
  UNION ALL
  SELECT cluster_id, len, path, cum FROM (
    SELECT b.cluster_id, b.len + 1 AS len, b.path || gain.base AS path, b.cum + gain.g AS cum,{" band.lo, band.hi," if cfg.band else ""}
           row_number() OVER (PARTITION BY b.cluster_id ORDER BY CAST(round((b.cum + gain.g) * 1e12) AS BIGINT) DESC, b.path || gain.base) AS r
    FROM beam b JOIN gain ON gain.cluster_id = b.cluster_id AND gain.context = right(b.path, {k}) JOIN win ON win.cluster_id = b.cluster_id {join.format("b")}
    WHERE b.len < greatest(win.hi, {L + 5})) WHERE r <= {width(f"(len - {k + 1})")}),
cand AS (SELECT b.cluster_id, b.len, b.path, b.cum / greatest(1, b.len - {k} + 1) + ({score}) + 0.05 * ln(1.0 + coalesce(end_.support, 0)) AS score,
           b.len BETWEEN {L - 5} AND {L + 5} AS soft, b.len BETWEEN win.lo AND win.hi AS win
         FROM beam b JOIN win ON win.cluster_id = b.cluster_id JOIN stat ON stat.cluster_id = b.cluster_id {prior}
         LEFT JOIN end_ ON end_.cluster_id = b.cluster_id AND end_.context = right(b.path, {k})),
family AS (
  SELECT cluster_id, path, score, CASE WHEN len = {L} THEN 1 ELSE 3 + abs(len - {L}) / 10.0 END AS f FROM cand WHERE soft
  UNION ALL SELECT cluster_id, path, score, 4.0 FROM cand WHERE win
  UNION ALL SELECT cluster_id, seq, CAST(n AS DOUBLE), 2.0 FROM m WHERE length(seq) = design_length
  UNION ALL SELECT cluster_id, seq, CAST(n AS DOUBLE), 5.0 FROM m),
chosen AS (SELECT cluster_id, path AS sequence, CAST(floor(f) AS INT) AS family FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY f, CAST(round(score * 1e12) AS HUGEINT) DESC, path) AS r FROM family) WHERE r = 1)"""


def _reconstruct(name: str, cfg: Config) -> None:
    def run(spark, d):
        return de.decode(reads(spark, d), cfg).select("cluster_id", "sequence", "family")

    run.__name__ = name
    _query(f"{_beam_sql(cfg)} SELECT * FROM chosen")(run)


for _name, _cfg in {"reconstruct": Config(), "reconstruct_k5": Config(k=5), "reconstruct_k12": Config(k=12), "reconstruct_k15": Config(k=15), "reconstruct_b4": Config(beam=4), "reconstruct_b8": Config(beam=8), "reconstruct_median_band": Config(prior="median_band"), "reconstruct_banded": Config(band=8), "reconstruct_full_band": Config(band=LENGTH)}.items():
    _reconstruct(_name, _cfg)


@_query(f"{_beam_sql(Config())} SELECT cluster_id, sequence, family FROM chosen")
def reconstruct_from_ledger(spark, d):
    """Every cluster by the way of those with very many different reads."""
    return de.decode(reads(spark, d), split=0).select("cluster_id", "sequence", "family")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, sequence, family FROM chosen")
def reconstruct_from_store(spark, d):
    """Both halves of the reads stored one after the other, then decoded from what is stored."""
    r, path = reads(spark, d), scratch(spark, "ledger")
    half = F.pmod(F.xxhash64("read_id"), F.lit(2))
    for i in range(2):
        store.append(r.where(half == i), path, i, parts=8)
    return store.decode_stored(spark, path).select("cluster_id", "sequence", "family")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, sequence, family FROM chosen")
def reconstruct_in_place(spark, d):
    """Reads written as lines, each cluster a run of them, and decoded by the tasks that read them."""
    path = scratch(spark, "runs")
    tsv.write_tsv(reads(spark, d).select(*READS.fieldNames()).repartitionByRange("cluster_id").sortWithinPartitions("cluster_id"), path)
    return decode_in_place(spark, path).select("cluster_id", "sequence", "family")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, len AS length, path AS sequence FROM beam WHERE len > {K}")
def beam_frontier(spark, d):
    return de.frontier(reads(spark, d)).select("cluster_id", "length", "sequence")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, len AS length, path AS sequence, round(score, 9) AS score FROM cand WHERE soft")
def candidates_by_length(spark, d):
    return de.candidates(reads(spark, d)).where("soft").select("cluster_id", "length", "sequence", F.round("score", 9).alias("score"))


@_query(f"{_beam_sql(Config())} SELECT cluster_id, path AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CAST(round(score * 1e12) AS HUGEINT) DESC, path) AS r FROM cand WHERE win) WHERE r <= 16")
def window_candidates(spark, d):
    """The best 16 paths of the reads' own lengths."""
    from pyspark.sql import Window

    by = Window.partitionBy("cluster_id").orderBy(C.bucket(F.col("score")).desc(), "sequence")
    return de.candidates(reads(spark, d)).where(F.col("window")).withColumn("r", F.row_number().over(by)).where("r <= 16").select("cluster_id", "sequence")


@_query(f"{_beam_sql(Config())} SELECT family, count(*) AS clusters FROM chosen GROUP BY family")
def selection_family(spark, d):
    return de.decode(reads(spark, d)).groupBy("family").agg(F.count(F.lit(1)).alias("clusters"))


_PRED = f"""{_beam_sql(Config())}, pred AS (SELECT 'events|' || cluster_id || '|' || CAST(least(20, reads) AS VARCHAR) AS row_key, 'events' AS dataset_id, cluster_id, CAST(least(20, reads) AS INT) AS legacy_prefix_alias,
  reads AS stop_index, reads AS consumed_reads, reads AS total_reads, sequence AS reconstructed_sequence, CASE WHEN sequence <> '' THEN 'completed_nonempty' ELSE 'completed_empty' END AS status FROM chosen JOIN stat USING (cluster_id)),
tr AS (SELECT cluster_id, any_value(truth) AS sequence FROM reads GROUP BY cluster_id),
ed AS (SELECT pred.cluster_id, CAST(length(reconstructed_sequence) AS INT) AS pred_length, CAST(length(sequence) AS INT) AS truth_length, CAST(levenshtein(reconstructed_sequence, sequence) AS INT) AS edit_distance FROM pred JOIN tr ON tr.cluster_id = pred.cluster_id),
evl AS (SELECT *, CAST(edit_distance = 0 AS INT) AS exact, 1.0 - CAST(edit_distance AS DOUBLE) / greatest(1, truth_length) AS normalized_accuracy FROM ed)"""


#: Reconstructed clusters with the names of their families, for the jobs.
RECONSTRUCTED = f"""WITH RECURSIVE {_beam_sql(Config())} SELECT cluster_id, {LENGTH} AS design_length, reads AS total_reads, sequence,
  CASE family {" ".join(f"WHEN {i} THEN '{x}'" for i, x in de.FAMILIES.items())} END AS family FROM chosen JOIN stat USING (cluster_id)"""


def _pred(spark, d) -> DataFrame:
    return de.predictions(de.decode(reads(spark, d)), "events")


def _truth(spark, d) -> DataFrame:
    return reads(spark, d).groupBy("cluster_id").agg(F.first("truth").alias("sequence"))


@_query(f"{_PRED} SELECT * FROM pred")
def prediction_rows(spark, d):
    return _pred(spark, d)


@_query(f"{_PRED} SELECT dataset_id AS dataset, '1' AS round_id, cluster_id, stop_index, total_reads, total_reads - consumed_reads AS unused_reads, CAST(consumed_reads < total_reads AS INT) AS stopped_early, status AS output_status FROM pred")
def stop_points(spark, d):
    return de.stop_points(_pred(spark, d))


@_query(f"{_PRED} SELECT cluster_id, pred_length, truth_length, edit_distance, exact, round(normalized_accuracy, 9) AS normalized_accuracy FROM evl")
def evaluation(spark, d):
    return ev.evaluate(_pred(spark, d), _truth(spark, d)).withColumn("normalized_accuracy", F.round("normalized_accuracy", 9))


@_query(f"""{_PRED} SELECT round(avg(exact), 9) AS exact, round(avg(normalized_accuracy), 9) AS accuracy, round(avg(edit_distance), 9) AS mean_ed, count(*) AS evaluated_clusters,
  CAST(sum(exact) AS BIGINT) AS exact_count, CAST(sum(edit_distance) AS BIGINT) AS total_ed, CAST(sum(truth_length) AS BIGINT) AS total_truth_bases FROM evl""")
def eval_summary(spark, d):
    s = ev.summary(ev.evaluate(_pred(spark, d), _truth(spark, d)))
    return s.withColumns({c: F.round(c, 9) for c in ("exact", "accuracy", "mean_ed")})


@_query(f"{_READS} SELECT read_id AS key, CAST(length(seq) AS INT) AS a_length, CAST(length(truth) AS INT) AS b_length, CAST(levenshtein(seq, truth) AS INT) AS edit_distance FROM c")
def edit_distance(spark, d):
    return ev.edit_distances(reads(spark, d).select(F.col("read_id").alias("key"), C.canonical("read_sequence").alias("a"), F.col("truth").alias("b")))


@_query(f"{_READS}, x AS (SELECT read_id, CAST(length(seq) AS INT) AS a_length, CAST(length(truth) AS INT) AS b_length, CAST(levenshtein(seq, truth) AS INT) AS x FROM c) SELECT read_id AS key, a_length, b_length, CASE WHEN x <= 1 THEN x ELSE -1 END AS edit_distance FROM x")
def edit_distance_limited(spark, d):
    """Reads within one edit of their template; -1 for others."""
    return ev.edit_distances(reads(spark, d).select(F.col("read_id").alias("key"), C.canonical("read_sequence").alias("a"), F.col("truth").alias("b")), 1)


_DROPPED = "CAST(cluster_id AS BIGINT) % 7"


@_query(f"{_READS}, a AS (SELECT DISTINCT cluster_id FROM c WHERE {_DROPPED} <> 1), b AS (SELECT DISTINCT cluster_id FROM c WHERE {_DROPPED} <> 2) SELECT cluster_id, 'missing' AS side FROM a WHERE cluster_id NOT IN (SELECT cluster_id FROM b) UNION ALL SELECT cluster_id, 'extra' FROM b WHERE cluster_id NOT IN (SELECT cluster_id FROM a)")
def closure_differences(spark, d):
    r, key = reads(spark, d), F.col("cluster_id").cast("long") % 7
    return va.id_differences(r.where(key != 1), r.where(key != 2))


@_query(f"{_READS}, tr AS (SELECT cluster_id, any_value(truth) AS sequence FROM reads GROUP BY cluster_id) SELECT cluster_id, sequence FROM tr WHERE cluster_id IN (SELECT cluster_id FROM c WHERE {_DROPPED} <> 1)")
def truth_semi(spark, d):
    r = reads(spark, d)
    return _truth(spark, d).join(r.where(F.col("cluster_id").cast("long") % 7 != 1).select("cluster_id"), "cluster_id", "left_semi")


@_query(f"""{_READS}, o AS ({_favourite_sql('WHERE CAST(cluster_id AS BIGINT) % 7 <> 1')}), w AS ({_favourite_sql('WHERE CAST(cluster_id AS BIGINT) % 7 <> 2 AND length(seq) > 63')})
SELECT coalesce(o.cluster_id, w.cluster_id) AS cluster_id, CASE WHEN w.cluster_id IS NULL THEN 'missing' WHEN o.cluster_id IS NULL THEN 'extra' ELSE 'changed' END AS state FROM o FULL JOIN w ON o.cluster_id = w.cluster_id WHERE o.seq IS DISTINCT FROM w.seq""")
def prediction_differences(spark, d):
    m, key = e.multiplicity(reads(spark, d)), F.col("cluster_id").cast("long") % 7
    name = lambda df: e.most_frequent_read(df).withColumnRenamed("seq", "reconstructed_sequence")
    return ev.differences(name(m.where(key != 1)), name(m.where((key != 2) & (F.length("seq") > 63))))


def _round_rows(spark, d) -> DataFrame:
    """Made-up detail rows: threads 1 to 3, as many rounds as threads."""
    r = reads(spark, d).withColumn("threads", (F.col("cluster_id").cast("long") % 3 + 1).cast("int"))
    r = r.withColumn("round", (F.col("read_id").cast("long") % F.col("threads") + 1).cast("int"))
    return r.groupBy("threads", "round").agg(F.avg(F.octet_length("read_sequence").cast("double")).alias("mean_length"), F.min("read_id").alias("seed"), F.count(F.lit(1)).alias("reads"))


@_query(f"""{_READS}, g AS (SELECT CAST(CAST(cluster_id AS BIGINT) % 3 + 1 AS INT) AS threads, e, read_id, read_sequence FROM reads),
h AS (SELECT threads, CAST(e % threads + 1 AS INT) AS round, avg(length(read_sequence)) AS mean_length, min(read_id) AS seed, count(*) AS reads FROM g GROUP BY ALL)
SELECT threads, CAST(round AS VARCHAR) AS round, round(mean_length, 9) AS mean_length, seed, reads, 'PASS' AS metric_closure FROM h
UNION ALL SELECT threads, 'MEAN', CAST(printf('%.11e', avg(mean_length)) AS DOUBLE), NULL, arg_min(reads, round), 'PASS_ALL_ROUNDS' FROM h GROUP BY threads HAVING count(*) > 1""")
def rounds_mean(spark, d):
    rows = _round_rows(spark, d).withColumn("metric_closure", F.lit("PASS"))
    detail = F.col("round") != "MEAN"
    return ev.with_means(rows, ["mean_length"]).withColumn("mean_length", F.when(detail, F.round("mean_length", 9)).otherwise(F.col("mean_length")))


@_query(f"{_READS} SELECT arg_min(len, (-n, f)) AS design_length FROM (SELECT length(seq) AS len, count(*) AS n, min(e) AS f FROM c GROUP BY 1)")
def modal_design_length(spark, d):
    r = reads(spark, d).withColumn("design_length", F.length("read_sequence")).withColumn("at", F.col("read_id").cast("long"))
    return ev.modal_length(r, "at").select(F.col("design_length").cast("long").alias("design_length"))


def _spoiled(spark, d) -> DataFrame:
    """Reads with one of every kind of fault."""
    i = F.col("read_id").cast("long")
    return (
        reads(spark, d)
        .withColumn("row_no", i)
        .withColumn("design_length", F.when(i == 100, "x").when(i == 101, "4").when(i == 102, "65").otherwise(F.col("design_length").cast("string")))
        .withColumn("read_sequence", F.when(i == 103, "").otherwise(F.col("read_sequence")))
        .withColumn("dataset_id", F.when(i == 104, "other").otherwise(F.col("dataset_id")))
        .withColumn("cluster_id", F.when(i.between(200, 299), "block").when(i.between(300, 301), "pair").when(i == 350, "block").otherwise(F.col("cluster_id")))
        .withColumn("read_id", F.when(i == 301, "300").otherwise(F.col("read_id")))
    )


@_query(f"""{_READS}, s AS (SELECT e AS row_no, CASE WHEN e BETWEEN 200 AND 299 OR e = 350 THEN 'block' WHEN e BETWEEN 300 AND 301 THEN 'pair' ELSE cluster_id END AS cluster_id,
  CASE WHEN e = 100 THEN 'x' WHEN e = 101 THEN '4' WHEN e = 102 THEN '65' ELSE '64' END AS design_length, CASE WHEN e = 103 THEN '' ELSE read_sequence END AS read_sequence,
  CASE WHEN e = 104 THEN 'other' ELSE 'events' END AS dataset_id, CASE WHEN e = 301 THEN '300' ELSE read_id END AS read_id FROM reads),
l AS (SELECT *, TRY_CAST(design_length AS INT) AS dl FROM s)
SELECT 'empty_read_sequence' AS rule, cluster_id, read_id AS detail FROM s WHERE read_sequence = ''
UNION ALL SELECT 'length_not_integer', cluster_id, design_length FROM l WHERE dl IS NULL
UNION ALL SELECT 'length_out_of_range', cluster_id, CAST(dl AS VARCHAR) FROM l WHERE dl NOT BETWEEN 5 AND 1000000
UNION ALL SELECT 'length_varies', cluster_id, min(dl) || '-' || max(dl) FROM l GROUP BY cluster_id HAVING min(dl) <> max(dl)
UNION ALL SELECT 'duplicate_read_id', cluster_id, read_id FROM s GROUP BY cluster_id, read_id HAVING count(*) > 1
UNION ALL SELECT 'not_one_dataset', NULL, CAST(count(DISTINCT dataset_id) AS VARCHAR) FROM s HAVING count(DISTINCT dataset_id) <> 1
UNION ALL SELECT 'cluster_not_contiguous', cluster_id, CAST(min(row_no) AS VARCHAR) FROM s GROUP BY cluster_id HAVING max(row_no) - min(row_no) + 1 <> count(*)""")
def validation_violations(spark, d):
    return va.violations(_spoiled(spark, d))


@_query(f"{_READS}, w AS (SELECT cluster_id, CASE WHEN lag(cluster_id) OVER (ORDER BY e) IS DISTINCT FROM cluster_id THEN 1 ELSE 0 END AS b FROM c) SELECT cluster_id, CAST(sum(b) AS BIGINT) AS n_blocks FROM w GROUP BY cluster_id")
def contiguous_blocks(spark, d):
    return va.blocks(reads(spark, d).withColumn("at", F.col("read_id").cast("long")), "at")


@_query(f"{_READS} SELECT DISTINCT cluster_id, substr(sha256('{od.PREFIX}|s1|events|' || cluster_id), 1, 32) AS entropy_bits FROM c")
def order_entropy(spark, d):
    return reads(spark, d).select("cluster_id").distinct().select("cluster_id", od.entropy("s1", "events").alias("entropy_bits"))


@_query()
def order_permutation(spark, d):
    """The Mersenne Twister's permutations aren't SQL; tests hold them against Python's own."""
    return od.orders(reads(spark, d), "s1", "events")


@_query(f"""{_READS}, f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, seq ORDER BY ts, read_id) = 1 AS new FROM c)
SELECT cluster_id, read_id, CAST(row_number() OVER w AS INT) AS arrival, CAST(sum(CAST(new AS INT)) OVER w AS BIGINT) AS distinct_reads, CAST(sum(CAST(length(seq) = design_length AS INT)) OVER w AS BIGINT) AS exact_reads
FROM f WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, read_id ROWS UNBOUNDED PRECEDING)""")
def prefix_evidence(spark, d):
    return e.prefix_support(reads(spark, d), "ts")


@_query(f"""{_READS} SELECT cluster_id, read_id, CAST(row_number() OVER w AS INT) AS arrival, median(length(seq)) OVER w AS median_length, round(sum(ln(length(seq))) OVER w, 6) AS log_sum, round(sum(ln(length(seq)) * ln(length(seq))) OVER w, 6) AS log_sq_sum
FROM c WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, read_id ROWS UNBOUNDED PRECEDING)""")
def prefix_lengths(spark, d):
    s = prefix.prefix_lengths(reads(spark, d), "ts")
    return s.withColumn("log_sum", F.round("log_sum", 6)).withColumn("log_sq_sum", F.round("log_sq_sum", 6))


@_query()
def prefix_reconstruct(spark, d):
    """Every prefix decoded; tests hold each against decoding its reads alone."""
    return prefix.prefix_decode(reads(spark, d), "ts")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, CAST(reads AS INT) AS arrival, sequence, family FROM chosen JOIN stat USING (cluster_id)")
def prefix_last(spark, d):
    """The last prefix is the whole cluster."""
    rows = prefix.prefix_decode(reads(spark, d), "ts")
    return rows.groupBy("cluster_id").agg(F.max(F.struct("arrival", "sequence", "family")).alias("x")).select("cluster_id", "x.arrival", "x.sequence", "x.family")


@_query()
def candidate_switches(spark, d):
    """How often a cluster's sequence changed as its reads came in; counted from tested prefixes."""
    return ev.switches(prefix.prefix_decode(reads(spark, d), "ts"), "arrival", "sequence")


@_query(f"""{_PRED}, ln_ AS (SELECT cluster_id || chr(9) || reconstructed_sequence AS l FROM pred), sl AS (SELECT substr(sha256(l), 1, 3) AS s, sha256(string_agg(l, chr(10) ORDER BY l)) AS dg, count(*) AS n FROM ln_ GROUP BY 1)
SELECT sha256(string_agg(s || dg, chr(10) ORDER BY s || dg)) AS sha256, CAST(sum(n) AS BIGINT) AS lines FROM sl""")
def prediction_fingerprint(spark, d):
    return ev.fingerprint(_pred(spark, d))


@_query(f"{_READS}, w AS (SELECT cluster_id, CAST(length(seq) <> lag(length(seq)) OVER (PARTITION BY cluster_id ORDER BY e) AS INT) AS x FROM c) SELECT cluster_id, CAST(sum(coalesce(x, 0)) AS BIGINT) AS switches FROM w GROUP BY cluster_id")
def length_switches(spark, d):
    r = reads(spark, d).select("cluster_id", F.col("read_id").cast("long").alias("at"), F.octet_length("read_sequence").alias("len"))
    return ev.switches(r, "at", "len")


@_query(f"""{_PRED} SELECT count(*) AS clusters, CAST(sum(total_reads) AS BIGINT) AS total_reads, CAST(sum(consumed_reads) AS BIGINT) AS consumed_reads, count(*) FILTER (WHERE consumed_reads < total_reads) AS early_clusters,
  count(*) FILTER (WHERE status = 'completed_empty') AS completed_empty, count(*) - count(DISTINCT cluster_id) AS duplicates, CASE WHEN count(*) FILTER (WHERE status = 'completed_empty') = 0 AND sum(consumed_reads) = sum(total_reads) THEN 'PASS' ELSE 'FAIL' END AS status FROM pred""")
def run_totals(spark, d):
    return ev.totals(_pred(spark, d))


@_query(f"{_PRED} SELECT count(*) AS clusters, CAST(sum(consumed_reads) AS BIGINT) AS reads_consumed FROM pred")
def worker_totals(spark, d):
    """What the tasks did, added up: how it was dealt is no one's business."""
    return ev.by_task(_pred(spark, d)).agg(F.sum("clusters").alias("clusters"), F.sum("reads_consumed").alias("reads_consumed"))


@_query(f"{_PRED} SELECT CAST(CAST(cluster_id AS BIGINT) % 8 AS INT) AS worker_id, count(*) AS clusters, CAST(sum(consumed_reads) AS BIGINT) AS reads_consumed FROM pred GROUP BY 1")
def worker_ledger(spark, d):
    """Clusters dealt to eight workers by their ids, and what each of them did."""
    return ev.by_task(_pred(spark, d).withColumn("task", (F.col("cluster_id").cast("long") % 8).cast("int")), "task")


def _pool_evidence(t: str, where: str) -> str:
    """Counters of the reads ``where``, all named with ``t``; ``p``: points of edges."""
    gram = lambda size: f"(SELECT *, substr(seq, i, {size}) AS gram FROM (SELECT *, unnest(range(1, length(seq) - {size} + 2)) AS i FROM m{t}) WHERE substr(seq, i, {size}) NOT LIKE '%N%')"
    return f"""
m{t} AS (SELECT cluster_id, seq, count(*) AS n FROM c WHERE {where} GROUP BY ALL),
x{t} AS (SELECT cluster_id, substr(gram, 1, {K}) AS context, substr(gram, {K + 1}, 1) AS base, CAST(sum(n) AS BIGINT) AS support FROM {gram(K + 1)} GROUP BY ALL),
p{t} AS (SELECT cluster_id, context, base, CAST(round((ln((support + 1.0) / (CAST(sum(support) OVER (PARTITION BY cluster_id, context) AS BIGINT) + 4.0)) + 0.15 * ln(1.0 + support)) * 1e12) AS BIGINT) AS points FROM x{t}),
q{t} AS (SELECT cluster_id, seq, max(n) AS n, arg_min(gram, i) AS a, arg_max(gram, i) AS z FROM {gram(K)} GROUP BY ALL),
a{t} AS (SELECT cluster_id, a AS context, CAST(sum(n) AS BIGINT) AS support FROM q{t} GROUP BY ALL),
z{t} AS (SELECT cluster_id, z AS context, CAST(sum(n) AS BIGINT) AS support FROM q{t} GROUP BY ALL),
t{t} AS (SELECT cluster_id, CAST(sum(support) AS BIGINT) AS total, count(*) AS kinds FROM a{t} GROUP BY ALL),
l{t} AS (SELECT cluster_id, avg(ln(length(seq))) AS mu, greatest(0.08, sqrt(greatest(0.0, avg(ln(length(seq)) * ln(length(seq))) - avg(ln(length(seq))) * avg(ln(length(seq)))))) AS sg FROM c WHERE {where} GROUP BY 1)"""


def _pool_best(t: str, name: str, candidates: str) -> str:
    """The best 16 of the candidates ``(cluster_id, path)`` by the counters ``t``."""
    return f"""
{name}_i AS (SELECT DISTINCT cluster_id, path FROM ({candidates}) WHERE regexp_full_match(path, '[ACGT]{{{K + 1},}}')),
{name}_s AS (SELECT d.cluster_id, d.path, CAST(sum(p.points) AS BIGINT) AS points FROM (SELECT *, unnest(range(1, length(path) - {K} + 1)) AS i FROM {name}_i) d
  LEFT JOIN p{t} p ON p.cluster_id = d.cluster_id AND p.context = substr(d.path, d.i, {K}) AND p.base = substr(d.path, d.i + {K}, 1) GROUP BY ALL HAVING count(p.points) = length(d.path) - {K}),
{name}_v AS (SELECT s.cluster_id, s.path, s.points, (ln((coalesce(a.support, 0) + 1.0) / (t.total + t.kinds)) + 0.15 * ln(1.0 + coalesce(a.support, 0)) + s.points * 1e-12) / (length(s.path) - {K - 1})
  - 0.375 * ((ln(length(s.path)) - l.mu) / l.sg) * ((ln(length(s.path)) - l.mu) / l.sg) + 0.05 * ln(1.0 + coalesce(z.support, 0)) AS score
  FROM {name}_s s JOIN t{t} t ON t.cluster_id = s.cluster_id JOIN l{t} l ON l.cluster_id = s.cluster_id
  LEFT JOIN a{t} a ON a.cluster_id = s.cluster_id AND a.context = left(s.path, {K}) LEFT JOIN z{t} z ON z.cluster_id = s.cluster_id AND z.context = right(s.path, {K})),
{name} AS (SELECT cluster_id, path, points, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CAST(round(score * 1e12) AS HUGEINT) DESC, path) AS r FROM {name}_v) WHERE r <= 16)"""


@_query(f"""{_READS},{_pool_evidence("1", "e % 2 = 0")},{_pool_evidence("2", "e % 2 = 1")},{_pool_evidence("3", "TRUE")},{_pool_best("1", "old", "SELECT cluster_id, seq AS path FROM m1")},
step AS (SELECT cluster_id, path, i, substr(path, i, {K}) AS context, substr(path, i + {K}, 1) AS base FROM (SELECT *, unnest(range(1, length(path) - {K} + 1)) AS i FROM old)),
gain AS (SELECT s.cluster_id, s.path, s.i, o.base, o.points - p.points AS g FROM step s JOIN p3 p ON p.cluster_id = s.cluster_id AND p.context = s.context AND p.base = s.base
  JOIN p3 o ON o.cluster_id = s.cluster_id AND o.context = s.context WHERE o.points > p.points AND (s.cluster_id, s.context) IN (SELECT (cluster_id, context) FROM x2)),
fixed AS (SELECT cluster_id, substr(path, 1, i + {K - 1}) || base || substr(path, i + {K + 1}) AS path FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, path ORDER BY g DESC, base, i) AS r FROM gain) WHERE r = 1),
{_pool_best("3", "new", "SELECT cluster_id, path FROM old WHERE cluster_id IN (SELECT cluster_id FROM m2) UNION ALL SELECT cluster_id, seq FROM m2 UNION ALL SELECT cluster_id, path FROM fixed")}
SELECT cluster_id, path AS sequence, round(score, 9) AS score FROM new UNION ALL SELECT cluster_id, path, round(score, 9) FROM old WHERE cluster_id NOT IN (SELECT cluster_id FROM m2)""")
def candidate_pool(spark, d):
    """Every other read first, then the others as a batch; SQL scores all candidates from nothing."""
    first, path = F.col("read_id").cast("long") % 2 == 0, scratch(spark, "pool")
    before, batch = e.multiplicity(reads(spark, d).where(first)), e.multiplicity(reads(spark, d).where(~first))
    pool = po.advance(None, None, before, f"{path}/1")
    before = spark.read.schema(before.schema).parquet(f"{path}/1/batch")
    return po.advance(pool, before, batch, f"{path}/2").select("cluster_id", "sequence", F.round("score", 9).alias("score"))


@_query(f"{_PRED} SELECT count(*) AS clusters, CAST(sum(total_reads) AS BIGINT) AS total_reads, CAST(sum(consumed_reads) AS BIGINT) AS consumed_reads, count(*) FILTER (WHERE consumed_reads < total_reads) AS early_clusters, count(*) FILTER (WHERE status = 'completed_empty') AS completed_empty FROM pred")
def observed_totals(spark, d):
    """Measured by the job that writes the predictions, without one of its own."""
    seen = Observation()
    _pred(spark, d).observe(seen, *ev.measures()).write.parquet(scratch(spark, "observed"))
    row = seen.get
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row))


@_query(f"{_PRED} SELECT sha256(string_agg(cluster_id || chr(9) || reconstructed_sequence || chr(10), '' ORDER BY cluster_id)) AS sha256 FROM pred")
def canonical_prediction_digest(spark, d):
    return spark.createDataFrame([(ev.canonical_digest(_pred(spark, d)),)], "sha256 string")


@_query(f"{_PRED} SELECT 'distance_out_of_range' AS rule, cluster_id, CAST(edit_distance AS VARCHAR) AS detail FROM ed WHERE CAST(cluster_id AS BIGINT) % 5 = 0")
def evaluation_violations(spark, d):
    """Distances of a fifth of the clusters are spoiled; all of those and no others are found."""
    rows = ev.evaluate(_pred(spark, d), _truth(spark, d))
    bad = F.col("cluster_id").cast("long") % 5 == 0
    found = va.evaluation_violations(rows.withColumn("edit_distance", F.when(bad, F.col("edit_distance") + 1000).otherwise(F.col("edit_distance"))))
    return found.withColumn("detail", (F.col("detail").cast("long") - 1000).cast("string"))


@_query(f"{_READS} SELECT cluster_id, read_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY e DESC) AS INT) AS arrival FROM c")
def replayed_reads(spark, d):
    """Reads by an order pack; this one turns each cluster around."""
    r = reads(spark, d).withColumn("at", F.col("read_id").cast("long"))
    n = r.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pack = n.select("cluster_id", F.reverse(F.sequence(F.lit(0), F.col("n") - 1)).alias("permutation"))
    return od.replay(r, pack, "at").select("cluster_id", "read_id", "arrival")


@_query(f"{_READS}, n AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1) SELECT cluster_id FROM n WHERE CAST(cluster_id AS BIGINT) % 3 <> 0 AND (CAST(cluster_id AS BIGINT) % 3 = 2 OR n > 1)")
def broken_orders(spark, d):
    """Of three packs one is right, one holds zeros alone, and one is missing."""
    r, kind = reads(spark, d), F.col("cluster_id").cast("long") % 3
    n = r.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    right = F.sequence(F.lit(0), F.col("n") - 1)
    return od.broken(n.where(kind != 2).select("cluster_id", F.when(kind == 0, right).otherwise(F.transform(right, lambda _: F.lit(0))).alias("permutation")), r)


@_query(f"""{_READS}, f AS (SELECT cluster_id, CAST(cluster_id AS BIGINT) % 11 AS k, min(e) AS p FROM c GROUP BY 1),
a AS (SELECT cluster_id, row_number() OVER (ORDER BY p) - 1 AS read_ordinal FROM f),
b AS (SELECT cluster_id, row_number() OVER (ORDER BY CASE WHEN k = 4 THEN p + 1000000000000 ELSE p END) - 1 AS order_ordinal FROM f WHERE k <> 7)
SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id, read_ordinal, order_ordinal, CASE WHEN order_ordinal IS NULL THEN 'missing' ELSE 'moved' END AS state
FROM a LEFT JOIN b ON a.cluster_id = b.cluster_id WHERE read_ordinal IS DISTINCT FROM order_ordinal""")
def misplaced_orders(spark, d):
    """A pack that lacks some clusters and has others at its end."""
    r = reads(spark, d).withColumn("at", F.col("read_id").cast("long"))
    k = F.col("cluster_id").cast("long") % 11
    pack = r.where(k != 7).groupBy("cluster_id").agg(F.min("at").alias("at")).withColumn("at", F.when(k == 4, F.col("at") + 1_000_000_000_000).otherwise(F.col("at")))
    return od.misplaced(pack, r, "at", scratch(spark, "orders"))


@_query(f"{_READS} SELECT DISTINCT cluster_id, 'TRUTH_ONLY_NO_READS' AS reason FROM c WHERE cluster_id NOT IN (SELECT cluster_id FROM c WHERE length(seq) = design_length AND e % 3 = 0)")
def truth_without_reads(spark, d):
    r = reads(spark, d)
    some = r.where((F.length("read_sequence") == F.col("design_length")) & (F.col("read_id").cast("long") % 3 == 0))
    return va.without_reads(_truth(spark, d), some)


_MATRIX = "SELECT CAST(cluster_id AS BIGINT) % 7 AS d, CAST(cluster_id AS BIGINT) % 4 AS t, count(*) AS n, sum(length(seq)) AS m FROM c"


def _matrix_rows(spark, d, where: str) -> DataFrame:
    r = reads(spark, d).withColumn("c", F.col("cluster_id").cast("long")).where(where)
    return r.groupBy((F.col("c") % 7).alias("d"), (F.col("c") % 4).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("read_sequence")).alias("m"))


@_query(f"{_READS}, a AS ({_MATRIX} WHERE CAST(cluster_id AS BIGINT) % 28 <> 1 GROUP BY 1, 2), b AS ({_MATRIX} WHERE CAST(cluster_id AS BIGINT) % 28 <> 2 GROUP BY 1, 2) SELECT a.d, a.t, a.n AS old_n, CAST(a.m AS BIGINT) AS old_m, b.n AS new_n, CAST(b.m AS BIGINT) AS new_m FROM a JOIN b ON a.d = b.d AND a.t = b.t")
def evidence_matrix(spark, d):
    return ev.matrix({"old": _matrix_rows(spark, d, "c % 28 <> 1"), "new": _matrix_rows(spark, d, "c % 28 <> 2")}, ["d", "t"])


@_query(f"{_READS}, a AS ({_MATRIX} WHERE CAST(cluster_id AS BIGINT) % 28 <> 1 GROUP BY 1, 2), w AS (SELECT x.i AS d, y.i AS t FROM range(0, 6) x(i), range(0, 4) y(i)) SELECT d, t, 'missing' AS side FROM w WHERE (d, t) NOT IN (SELECT (d, t) FROM a) UNION ALL SELECT d, t, 'extra' FROM a WHERE (d, t) NOT IN (SELECT (d, t) FROM w)")
def matrix_completeness(spark, d):
    axes = [spark.range(6).withColumnRenamed("id", "d"), spark.range(4).withColumnRenamed("id", "t")]
    return ev.matrix_differences(_matrix_rows(spark, d, "c % 28 <> 1"), axes)


@_query(f"{_READS} SELECT read_id, CASE WHEN x = '' THEN 'run' ELSE x END AS name FROM (SELECT read_id, trim(regexp_replace('._' || read_id || ' ' || chr(47) || seq || '..', '[^A-Za-z0-9_.-]+', '_', 'g'), '._') AS x FROM c)")
def safe_names(spark, d):
    r = reads(spark, d).select("read_id", F.concat(F.lit("._"), "read_id", F.lit(" /"), C.canonical("read_sequence"), F.lit("..")).alias("x"))
    return r.select("read_id", C.safe_name(F.col("x")).alias("name"))


def _tsv_folder(spark, df: DataFrame) -> str:
    path = scratch(spark, "tsv")
    tsv.write_tsv(df, path)
    return path


@_query(f"{_READS} SELECT 'events' AS dataset_id, cluster_id, read_id, read_sequence, '' AS original_read_sequence, '' AS read_quality, 60 AS design_length FROM reads")
def reads_from_tsv(spark, d):
    """Written as tab-separated parts and read back, with another design length."""
    path = _tsv_folder(spark, reads(spark, d).select(*READS.fieldNames()))
    return tsv.read_reads(spark, path, 60).where("_corrupt is null").drop("_corrupt")


@_query(f"{_READS} SELECT read_id AS cluster_id, read_sequence AS sequence FROM reads")
def truth_from_tsv(spark, d):
    """The keyed format: the key's second part names the cluster."""
    rows = reads(spark, d).select(F.concat_ws("|", F.lit("events"), "read_id", F.lit("20")).alias("row_key"), "dataset_id", F.col("read_sequence").alias("reference_sequence"))
    return tsv.read_truth(spark, _tsv_folder(spark, rows)).select("cluster_id", "sequence")


@_query(f"{_PRED} SELECT * FROM pred")
def predictions_from_tsv(spark, d):
    return tsv.read_predictions(spark, _tsv_folder(spark, _pred(spark, d)))


@_query(f"{_READS}, n AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY 1) SELECT cluster_id, substr(sha256('{od.PREFIX}|s2|events|' || cluster_id), 1, 32) AS entropy_bits, n, CAST(n * (n - 1) / 2 AS BIGINT) AS places FROM n")
def orders_from_json(spark, d):
    """Replay orders written as compressed JSON lines and read back: seeds, sizes, and sums of places."""
    path = scratch(spark, "orders")
    tsv.write_orders(od.orders(reads(spark, d), "s2", "events"), path)
    total = F.aggregate("permutation", F.lit(0).cast("long"), lambda a, x: a + x)
    return tsv.read_orders(spark, path).select("cluster_id", "entropy_bits", F.size("permutation").cast("long").alias("n"), total.alias("places"))


@_query(f"{_READS} SELECT read_id AS key, CAST(length(read_sequence) AS INT) AS a_length, CAST(length(truth) AS INT) AS b_length, CAST(levenshtein(read_sequence, truth) AS INT) AS edit_distance FROM reads")
def pairs_from_tsv(spark, d):
    path = scratch(spark, "pairs")
    reads(spark, d).select(F.concat_ws("\t", "read_id", "read_sequence", "truth").alias("value")).write.text(path)
    return ev.edit_distances(tsv.read_pairs(spark, path))


def _finished(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream over what is there, to Parquet files, and read them."""
    out = scratch(spark, "stream")
    if mode == "append":
        stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return event_reads(spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*"))


@_query(f"{_READS} SELECT cluster_id, seq, n FROM m")
def stream_counts(spark, d):
    return _finished(stream_multiplicity(_stream(spark, d)), spark, "complete")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, reads AS total_reads, sequence, family FROM chosen JOIN stat USING (cluster_id)")
def stream_reconstruct(spark, d):
    sizes = reads(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("total_reads"))
    return _finished(stream_decode(_stream(spark, d).join(sizes, "cluster_id")), spark, "append")


@_query(f"{_beam_sql(Config())} SELECT cluster_id, reads AS total_reads, sequence, family, TRUE AS complete FROM chosen JOIN stat USING (cluster_id)")
def stream_reconstruct_maps(spark, d):
    """As stream_reconstruct, with state in maps."""
    sizes = reads(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("total_reads"))
    with state_store(spark):
        return _finished(stream_clusters(_stream(spark, d).join(sizes, "cluster_id")), spark, "append")
