"""Queries of clustering, models, matching, enrichment and position weight matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import clustering as K
from strandlake.operators import counting as C
from strandlake.operators import enrichment as E
from strandlake.operators import factorization as N
from strandlake.operators import matching as T
from strandlake.operators import models as M
from strandlake.operators import pwm as P
from strandlake.operators.similarity import distance, features, similarity
from strandlake.operators.space import KmerSpace
from strandlake.plans.registry import query
from strandlake.plans.relational import erf_sql
from strandlake.plans.sequences import L3, DENSE_S, LETTER, motifs, r6
from strandlake.plans.tables import DOC_SEQ, MOTIF_SEQ, dist, motif_sequences, read, sequences

DAY = "(SELECT vec_id, label, pos, e * e / sum(e * e) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"


def vectors(spark, sf_dir):
    """Embeddings as distributions over positions: (seq_id, kmer, w), and labels (id, cluster)."""
    e = read(spark, sf_dir, "embeddings")
    each = e.select(F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("i", "e")).select("seq_id", (F.col("i") + 1).cast("string").alias("kmer"), (F.col("e").cast("double") * F.col("e").cast("double")).alias("n"))
    return C.hellinger(each), e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


VEC = "(SELECT vec_id AS seq_id, label, CAST(pos AS VARCHAR) AS kmer, sqrt(e * e / sum(e * e) OVER (PARTITION BY vec_id)) AS w FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"


@query(f"SELECT label AS cluster, kmer, round(sqrt(sum(w * w) / (SELECT count(*) FROM embeddings e WHERE e.label = v.label)), 6) AS w FROM {VEC} v GROUP BY label, kmer")
def centroid(spark, sf_dir):
    v, labels = vectors(spark, sf_dir)
    return C.centroids(v, labels.withColumnRenamed("id", "seq_id")).select("cluster", "kmer", r6("w"))


@query(f"WITH d AS {dist(MOTIF_SEQ, 3)}, n AS (SELECT seq_id % 4 AS cluster, count(DISTINCT seq_id) AS n FROM d GROUP BY 1) SELECT cluster, kmer, round(sqrt(sum(w * w) / any_value(n)), 6) AS w FROM d JOIN n ON n.cluster = seq_id % 4 GROUP BY cluster, kmer")
def cluster_motifs(spark, sf_dir):
    """Motifs of given clusters: the root mean of their members' distributions."""
    m = motifs(spark, sf_dir)
    labels = m.select("seq_id").distinct().withColumn("cluster", F.col("seq_id") % 4)
    return C.centroids(m, labels).select("cluster", "kmer", r6("w"))


CLUSTERED = "(SELECT DISTINCT seq_id AS id, seq_id % 4 AS cluster FROM d)"
SIL = (
    f"WITH d AS {dist(MOTIF_SEQ, 3)}, {DENSE_S}, dd AS (SELECT a, b, sqrt(greatest(1 - s, 0)) AS d FROM q WHERE a <> b), l AS {CLUSTERED}, "
    "m AS (SELECT a, x.cluster AS own, y.cluster AS other, avg(d) AS m FROM dd JOIN l x ON x.id = a JOIN l y ON y.id = b GROUP BY ALL), "
    "t AS (SELECT a, own AS cluster, max(m) FILTER (own = other) AS x, min(m) FILTER (own <> other) AS y FROM m GROUP BY ALL), "
    "s AS (SELECT a, cluster, CASE WHEN x IS NULL OR y IS NULL OR greatest(x, y) = 0 THEN 0 ELSE (y - x) / greatest(x, y) END AS s FROM t)"
)


def clustered(spark, sf_dir):
    m = motifs(spark, sf_dir)
    labels = m.select(F.col("seq_id").alias("id")).distinct().withColumn("cluster", F.col("id") % 4)
    return distance(m, m), labels


@query(f"{SIL} SELECT a, cluster, round(s, 6) AS s FROM s")
def silhouette(spark, sf_dir):
    return K.silhouette(*clustered(spark, sf_dir)).select("a", "cluster", r6("s"))


@query(f"{SIL} SELECT cluster, round(avg(s), 6) AS s, count(*) AS size FROM s GROUP BY cluster")
def cluster_silhouette(spark, sf_dir):
    return K.cluster_silhouette(*clustered(spark, sf_dir)).select("cluster", r6("s"), "size")


@query(f"{SIL} SELECT cluster, round(avg(s), 6) AS s FROM s GROUP BY cluster HAVING avg(s) > -0.01")
def good_clusters(spark, sf_dir):
    return K.cluster_silhouette(*clustered(spark, sf_dir)).filter("s > -0.01").select("cluster", r6("s"))


@query()
def hclust(spark, sf_dir):
    """Clusters of the motifs at rank 6 by every method."""
    m = motifs(spark, sf_dir)
    d = distance(m, m)
    ids, x = K.matrix(d)
    rows = [(method, i, c) for method in K.METHODS for i, c in zip(ids, K.cut(K.linkage(x, method), len(ids), 6))]
    return spark.createDataFrame(rows, "method string, id long, cluster int")


@query()
def rank_info(spark, sf_dir):
    m = motifs(spark, sf_dir)
    return spark.createDataFrame(K.rank_info(distance(m, m)), "k int, s double, good int")


@query()
def get_w0(spark, sf_dir):
    return K.initial_motifs(motifs(spark, sf_dir), 2, 8)


@query()
def reduce_motifs(spark, sf_dir):
    return K.reduce_motifs(motifs(spark, sf_dir), 5)


@query()
def pnmf(spark, sf_dir):
    return N.factorise(motifs(spark, sf_dir), 4, max_iter=15).frame(spark)


@query()
def opnmf(spark, sf_dir):
    return N.factorise(motifs(spark, sf_dir), 4, np_columns=20, init="nndsvd", max_iter=10).frame(spark)


# A model on motif features: coefficients from the item ids, every fifth zero.
COEF = "(SELECT o.outcome, item_id AS motif_id, CASE WHEN item_id % 5 = 0 THEN 0 ELSE (item_id % 7 - 3) / 2 * (o.outcome + 1) END AS coef FROM benchmark CROSS JOIN (SELECT unnest([0, 1]) AS outcome) o)"


def model(spark, sf_dir):
    each = read(spark, sf_dir, "benchmark").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("outcome"), F.col("item_id").alias("motif_id"))
    coef = F.when(F.col("motif_id") % 5 == 0, 0.0).otherwise((F.col("motif_id") % 7 - 3) / 2 * (F.col("outcome") + 1))
    return each.withColumn("coef", coef), spark.createDataFrame([(0, 0.25), (1, -0.5)], "outcome int, intercept double")


@query(f"SELECT outcome, motif_id, CAST(coef AS DOUBLE) AS coef FROM {COEF} WHERE motif_id IN (SELECT motif_id FROM {COEF} GROUP BY motif_id HAVING bool_or(coef <> 0))")
def nonzero_model(spark, sf_dir):
    return M.nonzero(model(spark, sf_dir)[0])


FEAT = f"(SELECT s.seq_id, m.seq_id AS motif_id, sum(s.w * m.w) AS bc FROM {dist(DOC_SEQ, 3)} s JOIN {dist(MOTIF_SEQ, 3)} m USING (kmer) GROUP BY ALL)"
PRED = f"(SELECT seq_id, outcome, 1 / (1 + exp(-(sum(bc * coef) + CASE outcome WHEN 0 THEN 0.25 ELSE -0.5 END))) AS p FROM {FEAT} JOIN {COEF} USING (motif_id) GROUP BY seq_id, outcome)"


def predicted(spark, sf_dir):
    f = features(C.distribution(sequences(spark, sf_dir), L3), motifs(spark, sf_dir))
    return M.predict(f, *model(spark, sf_dir))


@query(f"SELECT seq_id, outcome, round(p, 6) AS p FROM {PRED}")
def logistic_predict(spark, sf_dir):
    return predicted(spark, sf_dir).select("seq_id", "outcome", r6("p"))


SCORED = f"(SELECT outcome, round(p, 3) AS score, quality AS label FROM {PRED} JOIN labels ON doc_id = seq_id)"


def scored(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    return predicted(spark, sf_dir).join(labels, "seq_id").select("outcome", F.round("p", 3).alias("score"), "label")


CURVE = f"c AS (SELECT outcome, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, p, n, sum(p) OVER (PARTITION BY outcome) AS pos, sum(n) OVER (PARTITION BY outcome) AS neg FROM (SELECT outcome, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM {SCORED} GROUP BY ALL) WINDOW w AS (PARTITION BY outcome ORDER BY score DESC))"


@query(f"WITH s AS {SCORED} SELECT a.outcome, round(avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auroc FROM s a JOIN s b ON a.outcome = b.outcome AND a.label = 1 AND b.label = 0 GROUP BY a.outcome")
def roc_auc(spark, sf_dir):
    return M.metrics(scored(spark, sf_dir), by=["outcome"]).select("outcome", r6("auroc"))


@query(f"WITH {CURVE} SELECT outcome, round(sum(p * tp / (tp + fp)) / max(pos), 6) AS aupr FROM c GROUP BY outcome")
def aupr(spark, sf_dir):
    return M.metrics(scored(spark, sf_dir), by=["outcome"]).select("outcome", r6("aupr"))


@query(f"WITH {CURVE} SELECT outcome, round(greatest(max((tp + neg - fp) / (pos + neg)), max(neg / (pos + neg))), 6) AS accuracy FROM c GROUP BY outcome")
def max_accuracy(spark, sf_dir):
    return M.metrics(scored(spark, sf_dir), by=["outcome"]).select("outcome", r6("accuracy"))


@query(f"WITH {CURVE}, e AS (SELECT outcome, score, (pos - (tp - p) + fp - n) / (pos + neg) AS error FROM c) SELECT outcome, score AS threshold, round(error, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY error, score DESC) AS k FROM e) WHERE k = 1")
def best_threshold(spark, sf_dir):
    return M.best_threshold(scored(spark, sf_dir), by=["outcome"]).select("outcome", "threshold", r6("error"))


@query(
    f"WITH d AS {dist(MOTIF_SEQ, 3)}, s AS (SELECT x.seq_id AS a, y.seq_id AS b, sum(x.w * y.w) AS s FROM d x JOIN d y USING (kmer) GROUP BY ALL), k AS {COEF}, f AS (SELECT x.outcome AS oa, y.outcome AS ob, sum(x.coef * s * y.coef) AS q FROM k x JOIN s ON x.motif_id = a JOIN k y ON y.motif_id = b GROUP BY ALL) "
    "SELECT f.oa AS outcome_a, f.ob AS outcome_b, round(f.q / sqrt(g.q * h.q), 6) AS r FROM f JOIN f g ON g.oa = f.oa AND g.ob = f.oa JOIN f h ON h.oa = f.ob AND h.ob = f.ob"
)
def model_correlation(spark, sf_dir):
    m = motifs(spark, sf_dir)
    s, (k, _) = similarity(m, m), model(spark, sf_dir)
    return M.model_correlation(k, k, s, s, s).select("outcome_a", "outcome_b", r6("r"))


@query()
def lasso_cv(spark, sf_dir):
    """L1 logistic regression of document quality on motif features, by five folds of the id."""
    f = features(C.distribution(sequences(spark, sf_dir), L3), motifs(spark, sf_dir))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("y"), F.pmod("doc_id", F.lit(5)).alias("fold"))
    ids, coef, intercept, lam, mean = M.lasso_cv(f, labels, 20, 60)
    return spark.createDataFrame([(int(n), float(c), intercept, lam, float(mean.max())) for n, c in zip(ids, coef)], "motif_id long, coef double, intercept double, lambda double, auroc double")


# Motif matching: all items are queries and targets.
TOM = (
    f"WITH d AS {dist(MOTIF_SEQ, 3)}, {DENSE_S}, i AS (SELECT seq_id, 6.0 + sum(w * w * log2(w * w)) AS ic FROM d GROUP BY seq_id), "
    "x AS (SELECT a, b, s, sqrt(greatest(u.ic * v.ic, 0)) AS x FROM q JOIN i u ON u.seq_id = a JOIN i v ON v.seq_id = b), "
    "f AS (SELECT a, regr_slope(s, x) AS slope, regr_intercept(s, x) AS intercept FROM x GROUP BY a), r AS (SELECT a, b, s, s - intercept - slope * x AS d, slope, intercept FROM x JOIN f USING (a)), "
    "t AS (SELECT a AS target, avg(d) AS mean, stddev_samp(d) AS sd, any_value(intercept) AS intercept, any_value(slope) AS slope FROM r GROUP BY a)"
)


@query(f"{TOM} SELECT target, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, round(intercept, 6) AS intercept, round(slope, 6) AS slope FROM t")
def tom_target_info(spark, sf_dir):
    return T.target_info(motifs(spark, sf_dir), L3).select("target", *[r6(c) for c in ("mean", "sd", "intercept", "slope")])


def matched(spark, sf_dir):
    m = motifs(spark, sf_dir)
    return T.match(m, m, L3)


MATCHED = (
    f"{TOM}, z AS (SELECT r.a AS query, r.b AS target, r.s, (r.d - t.mean) / t.sd AS z FROM r JOIN t ON t.target = r.b), pv AS (SELECT query, target, s, (1 - {erf_sql('z / sqrt(2)')}) / 2 AS p FROM z), "
    "ir AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, rank() OVER (PARTITION BY query ORDER BY p) + count(*) OVER (PARTITION BY query, p) - 1 AS i FROM pv), "
    "mt AS (SELECT query, target, s, p, least(1, min(p * n / i) OVER (PARTITION BY query ORDER BY p DESC)) AS q, p * 2 * n AS e FROM ir)"
)
MATCH_COLUMNS = "query, target, round(p, 6) AS p, round(q, 6) AS q, round(e, 4) AS e, round(s, 6) AS similarity"


def shown(matches, *more):
    return matches.select("query", "target", r6("p"), r6("q"), F.round("e", 4).alias("e"), r6("similarity"), *more)


@query(f"{MATCHED} SELECT {MATCH_COLUMNS} FROM mt")
def tom_match(spark, sf_dir):
    return shown(matched(spark, sf_dir))


@query(f"{TOM} SELECT r.a AS query, r.b AS target, round((r.d - t.mean) / t.sd, 5) + 0.0 AS z, round(r.s, 6) AS similarity FROM r JOIN t ON t.target = r.b")
def tom_scores(spark, sf_dir):
    """The standardised residuals behind the matches' p-values (SQL has no error function)."""
    m = motifs(spark, sf_dir)
    fit = T._residuals(T._scored(m, m, L3), "a").join(T.target_info(m, L3).select(F.col("target").alias("b"), "mean", "sd"), "b")
    return fit.select(F.col("a").alias("query"), F.col("b").alias("target"), (F.round((F.col("d") - F.col("mean")) / F.col("sd"), 5) + 0.0).alias("z"), (F.round("s", 6)).alias("similarity"))


@query(f"{MATCHED} SELECT {MATCH_COLUMNS}, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, target) AS k FROM mt WHERE query <> target AND p < 0.5) WHERE k = 1")
def tom_best_hit(spark, sf_dir):
    m = matched(spark, sf_dir).withColumn("similarity", F.round("similarity", 9))
    return shown(T.select_hits(m.filter("query <> target"), 0.5, "p", True, "similarity"), "rank")


@query(
    f"WITH d AS {dist(MOTIF_SEQ, 3)}, s AS (SELECT x.seq_id AS a, y.seq_id AS b, sum(x.w * y.w) AS s FROM d x JOIN d y USING (kmer) GROUP BY ALL), t AS (SELECT max(s) * 0.95 AS t FROM s WHERE a < b), h AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s, t WHERE s > t), "
    "n AS (SELECT a, b, s, k, unnest(['m' || CAST(b % 5 AS VARCHAR), 'n' || CAST(b % 3 AS VARCHAR)]) AS name FROM h), g AS (SELECT a AS motif, name, count(*) AS hits, avg(k) AS mean_rank, avg(s) AS mean_score FROM n GROUP BY ALL) "
    "SELECT motif, name, hits, round(mean_rank, 6) AS mean_rank, round(mean_score, 6) AS mean_score FROM (SELECT *, max(hits) OVER (PARTITION BY motif) AS m FROM g) WHERE hits = m"
)
def annotate(spark, sf_dir):
    m = motifs(spark, sf_dir)
    names = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.concat(F.lit("m"), (F.col("item_id") % 5).cast("string"), F.lit("_n"), (F.col("item_id") % 3).cast("string")).alias("name"))
    return T.annotate(m, m, 0.95, names).select("motif", "name", "hits", r6("mean_rank"), r6("mean_score"))


# Enrichment: whole items in tiles of 150 characters, the last one filled with N; tiles of even items are positives.
LABELLED = f"(SELECT seq_id * 1000 + t AS seq_id, rpad(substr(seq, 150 * t + 1, 150), 150, 'N') AS seq, 1 - seq_id % 2 AS label FROM (SELECT seq_id, seq, CAST(unnest(range(0, (length(seq) + 149) // 150)) AS INTEGER) AS t FROM {MOTIF_SEQ}))"
N_POS = 150 - 31 + 1


def labelled(spark, sf_dir):
    s = motif_sequences(spark, sf_dir).filter(F.length("seq") > 0)
    tiles = s.select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 150).cast("int"))).alias("t"))
    part = F.rpad(F.col("seq").substr(150 * F.col("t") + 1, F.lit(150)), 150, "N")
    return tiles.select((F.col("seq_id") * 1000 + F.col("t")).alias("seq_id"), (1 - F.col("seq_id") % 2).alias("label"), part.alias("seq"))


def window31(source: str) -> str:
    pos = f"(SELECT seq_id, label, p AS pos, substr(seq, p, 3) AS kmer FROM (SELECT seq_id, label, seq, unnest(range(1, 149)) AS p FROM {source}) WHERE regexp_full_match(substr(seq, p, 3), '[ACGT]{{3}}'))"
    n = f"(SELECT seq_id, label, s AS pos, kmer, count(*) AS n FROM (SELECT seq_id, label, kmer, unnest(range(greatest(pos - 28, 1), least(pos, {N_POS}) + 1)) AS s FROM {pos}) GROUP BY ALL)"
    return f"(SELECT seq_id, label, pos, kmer, sqrt(n / sum(n) OVER (PARTITION BY seq_id, pos)) AS w FROM {n})"


PROFILE = f"(SELECT p.seq_id, label, m.seq_id AS motif_id, pos, sum(p.w * m.w) AS bc FROM {window31(LABELLED)} p JOIN {dist(MOTIF_SEQ, 3)} m USING (kmer) GROUP BY ALL)"


def profiled(spark, sf_dir):
    s, m = labelled(spark, sf_dir), motifs(spark, sf_dir)
    return E.profiles(s, m, 15, L3), s, m


@query(f"WITH n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {LABELLED}) SELECT motif_id, pos, round((sum(CASE WHEN label = 1 THEN bc ELSE 0 END) / (SELECT p FROM n)) / nullif(sum(CASE WHEN label = 0 THEN bc ELSE 0 END) / (SELECT n FROM n), 0), 6) AS ratio FROM {PROFILE} GROUP BY motif_id, pos")
def profile_ratio(spark, sf_dir):
    p, s, _ = profiled(spark, sf_dir)
    return E.mean_ratio(p, s).select("motif_id", F.col("pos").cast("long"), r6("ratio"))


TOL = 1e-6
HITS = (
    f"WITH f AS (SELECT seq_id, label, motif_id, pos, round(bc / {TOL}) * {TOL} AS v FROM {PROFILE}), g AS (SELECT l.seq_id, l.label, m.seq_id AS motif_id FROM {LABELLED} l CROSS JOIN (SELECT DISTINCT seq_id FROM {dist(MOTIF_SEQ, 3)}) m), "
    "sc AS (SELECT g.motif_id, g.seq_id, g.label, coalesce(max(v), 0) AS score FROM g LEFT JOIN f USING (seq_id, motif_id) GROUP BY ALL), "
    "a AS (SELECT x.motif_id, avg(CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS a FROM sc x JOIN sc y ON x.motif_id = y.motif_id AND x.label = 1 AND y.label = 0 GROUP BY x.motif_id), "
    "e AS (SELECT c.motif_id, c.score, a.a, count(*) FILTER (o.label = (CASE WHEN a.a > 0.5 THEN 1 ELSE 0 END) AND o.score <= c.score) + count(*) FILTER (o.label <> (CASE WHEN a.a > 0.5 THEN 1 ELSE 0 END) AND o.score > c.score) AS err FROM (SELECT DISTINCT motif_id, score FROM sc) c JOIN a USING (motif_id) JOIN sc o USING (motif_id) GROUP BY ALL), "
    "t AS (SELECT motif_id, CASE WHEN a > 0.5 THEN a ELSE a - 1 END AS auroc, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY err, score DESC) AS k FROM e) WHERE k = 1), "
    f"h AS (SELECT motif_id, seq_id, sc.label, sc.score, f.pos, f.pos - row_number() OVER (PARTITION BY motif_id, seq_id ORDER BY f.pos) AS k FROM sc JOIN t USING (motif_id) JOIN f USING (motif_id, seq_id) WHERE sc.score > threshold AND sc.score - v <= {TOL}), "
    "hit AS (SELECT motif_id, seq_id, label, score, (min(pos) + max(pos)) // 2 AS pos FROM (SELECT *, min(k) OVER (PARTITION BY motif_id, seq_id) AS k0 FROM h) WHERE k = k0 GROUP BY ALL)"
)


def found(spark, sf_dir):
    p, s, m = profiled(spark, sf_dir)
    scores = E.best_scores(p, s, m, TOL)
    cut = E.thresholds(scores)
    return E.hits(p, scores, cut, TOL), cut, s, m


@query(f"{HITS} SELECT motif_id, round(auroc, 6) AS auroc, round(threshold, 6) AS threshold FROM t")
def profile_thresholds(spark, sf_dir):
    return found(spark, sf_dir)[1].select("motif_id", r6("auroc"), r6("threshold"))


@query(f"{HITS} SELECT motif_id, seq_id, label, round(score, 6) AS score, pos FROM hit")
def profile_hits(spark, sf_dir):
    return found(spark, sf_dir)[0].select("motif_id", "seq_id", "label", r6("score"), F.col("pos").cast("long"))


COUNTED = f"{HITS}, pc AS (SELECT m.motif_id, p.pos, count(hit.seq_id) FILTER (hit.label = 1) AS np, count(hit.seq_id) FILTER (hit.label = 0) AS nn FROM (SELECT DISTINCT motif_id FROM sc) m CROSS JOIN (SELECT unnest(range(1, {N_POS - 1})) AS pos) p LEFT JOIN hit ON hit.motif_id = m.motif_id AND hit.pos - 1 = p.pos AND hit.pos > 1 AND hit.pos < {N_POS} GROUP BY ALL)"


@query(f"{COUNTED} SELECT motif_id, pos, np, nn FROM pc")
def position_counts(spark, sf_dir):
    h, _, _, m = found(spark, sf_dir)
    return E.position_counts(h, m, N_POS)


FOLD = "SELECT motif_id, abs(pos - {c}) + 1 AS pos, sum(np) AS np, sum(nn) AS nn FROM pc GROUP BY ALL"
SCAN = (
    f"{COUNTED}, b AS (SELECT motif_id, pos // 6 + 1 AS pos, sum(np) AS np, sum(nn) AS nn FROM pc GROUP BY ALL), w AS (SELECT motif_id, sum(np) AS np_all, sum(nn) AS nn_all, max(pos) AS npos FROM b GROUP BY motif_id), "
    "iv AS (SELECT x.motif_id, x.pos AS s, y.pos AS e, sum(z.np) AS np, sum(z.nn) AS nn, sum(z.np * z.pos) AS m, max_by(z.pos, z.np * 1000 - z.pos) AS mp FROM b x JOIN b y ON x.motif_id = y.motif_id AND x.pos <= y.pos JOIN b z ON z.motif_id = x.motif_id AND z.pos BETWEEN x.pos AND y.pos GROUP BY ALL), "
    f"n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {LABELLED})"
)
BINOM = "CASE WHEN np = 0 OR {n} = 0 THEN 1 WHEN {p} >= 1 THEN 1 WHEN {p} <= 0 THEN 0 ELSE (SELECT sum(exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - ({p})))) FROM range(CAST(np AS BIGINT), CAST({n} AS BIGINT) + 1) t(k)) END"


def r8(name):
    return (F.round(name, 8) + 0.0).alias(name)


def binned(spark, sf_dir):
    """Position counts in bins of six positions, with the numbers of positives and negatives."""
    h, _, s, m = found(spark, sf_dir)
    return E.binned(E.position_counts(h, m, N_POS), 6), *E.label_sizes(s)


@query(
    f"{SCAN} SELECT motif_id, s AS start, e AS \"end\", round(m / nullif(np, 0), 6) AS mean_pos, mp AS max_pos, CAST(np AS BIGINT) AS np_in, CAST(np_all - np AS BIGINT) AS np_out, CAST(nn AS BIGINT) AS nn_in, CAST(nn_all - nn AS BIGINT) AS nn_out, round(np / nullif(np_all, 0) / ((e - s + 1) / npos), 6) AS centrality, "
    f"round({BINOM.format(n='np_all', p='(e - s + 1) / npos')}, 8) AS centrality_p FROM iv JOIN w USING (motif_id)"
)
def centrality(spark, sf_dir):
    counts, p, n = binned(spark, sf_dir)
    t = E.with_peaks(E.tests(counts, p, n), counts)
    return t.select("motif_id", "start", "end", r6("mean_pos"), "max_pos", "np_in", "np_out", "nn_in", "nn_out", r6("centrality"), r8("centrality_p"))


@query(
    f"{SCAN} SELECT motif_id, s AS start, e AS \"end\", round(np / (SELECT p FROM n) / nullif(nn / (SELECT n FROM n), 0), 6) AS enrichment, round({BINOM.format(n='(SELECT p FROM n)', p='nn / (SELECT n FROM n)')}, 8) AS enrichment_p FROM iv"
)
def enrichment(spark, sf_dir):
    return E.tests(*binned(spark, sf_dir)).select("motif_id", "start", "end", r6("enrichment"), r8("enrichment_p"))


def bh_sql(p: str, group: str) -> str:
    """SQL for the adjusted p-values of a window over the tests in a group: a fold over ranks that come first."""
    return f"least(1, min({p} * n / {p}_i) OVER (PARTITION BY {group} ORDER BY {p} DESC))"


TESTED = (
    f"{SCAN}, tp AS (SELECT motif_id, s, e, np, nn, np_all, npos, np / nullif(np_all, 0) / ((e - s + 1) / npos) AS centrality, np / (SELECT p FROM n) / nullif(nn / (SELECT n FROM n), 0) AS enrichment, {BINOM.format(n='np_all', p='(e - s + 1) / npos')} AS cp, {BINOM.format(n='(SELECT p FROM n)', p='nn / (SELECT n FROM n)')} AS ep FROM iv JOIN w USING (motif_id)), "
    "ti AS (SELECT *, count(*) OVER (PARTITION BY motif_id) AS n, rank() OVER (PARTITION BY motif_id ORDER BY cp) + count(*) OVER (PARTITION BY motif_id, cp) - 1 AS cp_i, rank() OVER (PARTITION BY motif_id ORDER BY ep) + count(*) OVER (PARTITION BY motif_id, ep) - 1 AS ep_i FROM tp), "
    f"tq AS (SELECT *, {bh_sql('cp', 'motif_id')} AS cq, {bh_sql('ep', 'motif_id')} AS eq FROM ti)"
)


@query(f"{TESTED} SELECT motif_id, s AS start, e AS \"end\", round(cq, 6) AS centrality_q, round(eq, 6) AS enrichment_q FROM tq")
def enrichment_q(spark, sf_dir):
    return E.tests(*binned(spark, sf_dir)).select("motif_id", "start", "end", r6("centrality_q"), r6("enrichment_q"))


@query()
def enrichment_two_tailed(spark, sf_dir):
    """Two tails need the outcomes as rare on the other side; tested by value."""
    return E.tests(*binned(spark, sf_dir), tail="two")


@query(f"{COUNTED} SELECT motif_id, pos, CAST(np AS BIGINT) AS np, CAST(nn AS BIGINT) AS nn FROM (SELECT motif_id, abs(pos - 59) + 1 AS pos, sum(np) AS np, sum(nn) AS nn FROM pc WHERE pos <= 117 GROUP BY ALL)")
def folded_counts(spark, sf_dir):
    h, _, _, m = found(spark, sf_dir)
    return E.folded(E.position_counts(h, m, N_POS).filter("pos <= 117"), 117)


#: Made-up texts hold no motif that stands out, so the level lets through all that are above 1 on both tests.
LEVEL = 1e6
RANKED = (
    f"{TESTED}, kp AS (SELECT motif_id, s, e, centrality, enrichment, cq, eq, round(-log10(greatest(cq, 1e-300)), 9) AS a, round(-log10(greatest(eq, 1e-300)), 9) AS b FROM tq WHERE cq * (SELECT count(DISTINCT motif_id) FROM tq) < {LEVEL} AND eq * (SELECT count(DISTINCT motif_id) FROM tq) < {LEVEL} AND centrality > 1 AND enrichment > 1), "
    "rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 + rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS score FROM kp), "
    "pl AS (SELECT *, row_number() OVER (ORDER BY score DESC, a DESC, motif_id, s, e) AS place FROM rk)"
)


@query(f"{RANKED} SELECT motif_id, s AS start, e AS \"end\", score, place FROM pl")
def central_motifs(spark, sf_dir):
    return E.central(E.tests(*binned(spark, sf_dir)), LEVEL).select("motif_id", "start", "end", "score", F.col("place").cast("long").alias("place"))


@query(
    f"{RANKED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY motif_id ORDER BY place) AS k FROM pl) WHERE k = 1) "
    "SELECT best.motif_id, row_number() OVER (ORDER BY place) AS rank, round(t.auroc, 6) AS auroc, s AS start, e AS \"end\", round(centrality, 6) AS centrality, round(enrichment, 6) AS enrichment FROM best JOIN t ON t.motif_id = best.motif_id"
)
def motif_map(spark, sf_dir):
    """From labelled sequences and motifs to the ranked table of enriched motifs, in one call."""
    m = E.motif_map(labelled(spark, sf_dir), motifs(spark, sf_dir), 15, L3, N_POS, TOL, 6, LEVEL)
    return m.select("motif_id", F.col("rank").cast("long").alias("rank"), r6("auroc"), "start", "end", r6("centrality"), r6("enrichment"))


@query()
def profile_fit(spark, sf_dir):
    p, s, _ = profiled(spark, sf_dir)
    return E.fit_profile(E.mean_ratio(p, s), N_POS // 2)


# Matrices: one per brand, six positions, bases from part keys.
COUNTS = "(SELECT p_brand AS name, 1 + p_size % 6 AS pos, 1 + count(*) FILTER (p_partkey % 4 = 0) AS a, 1 + count(*) FILTER (p_partkey % 4 = 1) AS c, 1 + count(*) FILTER (p_partkey % 4 = 2) AS g, 1 + count(*) FILTER (p_partkey % 4 = 3) AS t FROM part GROUP BY ALL)"
PWM = f"(SELECT name, pos, a / (a + c + g + t) AS a, c / (a + c + g + t) AS c, g / (a + c + g + t) AS g, t / (a + c + g + t) AS t, CAST(a + c + g + t AS DOUBLE) AS n FROM {COUNTS})"
PSSM = "(SELECT name, pos, " + ", ".join(f"log2(({b} * n + 0.025) / (n + 0.1) / 0.25) AS {b}" for b in "acgt") + f" FROM {PWM})"


def matrices(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    each = p.groupBy(F.col("p_brand").alias("name"), (F.col("p_size") % 6 + 1).alias("pos")).agg(*[(F.count(F.when(F.col("p_partkey") % 4 == i, 1)) + 1).alias(b) for i, b in enumerate("acgt")])
    return P.normalised(each)


@query(f"SELECT name, pos, round(a, 6) AS a, round(c, 6) AS c, round(g, 6) AS g, round(t, 6) AS t FROM {PSSM}")
def pwm_pssm(spark, sf_dir):
    return P.pssm(matrices(spark, sf_dir)).select("name", "pos", *[r6(b) for b in "acgt"])


def cell(x: str, i: str) -> str:
    return f"CASE substr({x}, {i}, 1) WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END"


WINDOWS6 = f"(SELECT seq_id, p AS pos, substr(seq, p, 6) AS x FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS p FROM {MOTIF_SEQ}) WHERE regexp_full_match(substr(seq, p, 6), '[ACGT]{{6}}'))"
SCAN6 = f"(SELECT seq_id, name, v.pos, sum({cell('x', 'm.pos')}) AS score, sum({cell(chr(114) + 'x', 'm.pos')}) AS back FROM (SELECT *, reverse(translate(x, 'ACGT', 'TGCA')) AS rx FROM {WINDOWS6}) v CROSS JOIN {PSSM} m WHERE m.name IN (SELECT name FROM {PSSM} GROUP BY name HAVING count(*) = 6) GROUP BY seq_id, name, v.pos)"


def scoring(spark, sf_dir):
    m = P.pssm(matrices(spark, sf_dir))
    full = m.groupBy("name").count().filter("count = 6").select("name")
    return m.join(full, "name", "left_semi")


@query(f"SELECT seq_id, name, pos, round(score, 6) AS score FROM {SCAN6}")
def pwm_scan(spark, sf_dir):
    return P.scores(motif_sequences(spark, sf_dir), scoring(spark, sf_dir)).select("seq_id", "name", "pos", r6("score"))


@query(f"SELECT seq_id, name, round(max(greatest(score, back)), 6) AS score FROM {SCAN6} GROUP BY ALL")
def pwm_max_ds(spark, sf_dir):
    return P.sequence_scores(P.scores(motif_sequences(spark, sf_dir), scoring(spark, sf_dir), double_strand=True)).select("seq_id", "name", r6("score"))


@query(f"SELECT seq_id, name, round(avg(score), 6) AS score FROM {SCAN6} GROUP BY ALL")
def pwm_avg(spark, sf_dir):
    return P.sequence_scores(P.scores(motif_sequences(spark, sf_dir), scoring(spark, sf_dir)), "avg").select("seq_id", "name", r6("score"))


@query(f"SELECT name, pos, round(2 + a * log2(a) + c * log2(c) + g * log2(g) + t * log2(t), 6) AS ic FROM {PWM}")
def pwm_ic(spark, sf_dir):
    return P.position_information(matrices(spark, sf_dir)).select("name", "pos", r6("ic"))


@query(f"SELECT name, round(sum(least(a, c, g, t)), 6) AS lo, round(sum(greatest(a, c, g, t)), 6) AS hi FROM {PSSM} GROUP BY name")
def pwm_range(spark, sf_dir):
    return P.score_range(P.pssm(matrices(spark, sf_dir))).select("name", r6("lo"), r6("hi"))


PADDED = f"(SELECT name, row_number() OVER (PARTITION BY name ORDER BY pos) + 2 AS pos, a, c, g, t FROM {PWM} UNION ALL SELECT n.name, p.pos, 0.25, 0.25, 0.25, 0.25 FROM (SELECT name, count(*) AS w FROM {PWM} GROUP BY name) n, (SELECT unnest([1, 2, 3, 4]) AS k) k, LATERAL (SELECT CASE WHEN k <= 2 THEN k ELSE w + k END AS pos) p)"
WORDS3 = f"(SELECT {LETTER.format(16)} || {LETTER.format(4)} || {LETTER.format(1)} AS x FROM range(64) t(i))"
LMER_P = f"(SELECT u.name, x, {cell('x', '1').replace(' a ', ' u.a ').replace(' c ', ' u.c ').replace(' g ', ' u.g ').replace(' t ', ' u.t ')} * {cell('x', '2').replace(' a ', ' v.a ').replace(' c ', ' v.c ').replace(' g ', ' v.g ').replace(' t ', ' v.t ')} * {cell('x', '3').replace(' a ', ' w.a ').replace(' c ', ' w.c ').replace(' g ', ' w.g ').replace(' t ', ' w.t ')} AS p FROM {PADDED} u JOIN {PADDED} v ON u.name = v.name AND v.pos = u.pos + 1 JOIN {PADDED} w ON u.name = w.name AND w.pos = u.pos + 2 CROSS JOIN {WORDS3})"


@query(f"SELECT name, kmer, round(sqrt(n / sum(n) OVER (PARTITION BY name)), 6) AS w FROM (SELECT name, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS kmer, sum(p) AS n FROM (SELECT name, x, avg(p) AS p FROM {LMER_P} GROUP BY name, x) GROUP BY ALL)")
def pwm_to_motif(spark, sf_dir):
    return P.motifs(matrices(spark, sf_dir), KmerSpace(3, 0, True)).select("name", "kmer", r6("w"))


@query(f"SELECT name, x AS kmer, round(sqrt(p / sum(p) OVER (PARTITION BY name)), 6) AS w FROM (SELECT name, x, max(p) AS p FROM {LMER_P} GROUP BY name, x) WHERE p * 64 >= 1")
def pwm_to_motif_max(spark, sf_dir):
    return P.motifs(matrices(spark, sf_dir), L3, best=True).select("name", "kmer", r6("w"))


SIX = range(1, 7)
STEPS6 = (
    f"SELECT name, g, count(*) / 4096.0 AS p FROM (SELECT name, {' + '.join(f'floor(s{i}[1 + (w // {4 ** (i - 1)}) % 4] / 0.05)' for i in SIX)} AS g FROM "
    f"(SELECT name, {', '.join(f'max([a, c, g, t]) FILTER (pos = {i}) AS s{i}' for i in SIX)} FROM {PSSM} GROUP BY name HAVING count(*) = 6), range(4096) t(w)) GROUP BY name, g"
)


@query(f"SELECT name, CAST(g AS BIGINT) AS step, round(sum(p) OVER (PARTITION BY name ORDER BY g DESC), 6) AS p FROM ({STEPS6})")
def pwm_distribution(spark, sf_dir):
    return P.distributions(scoring(spark, sf_dir), 0.05).select("name", F.round(F.col("score") / 0.05).cast("long").alias("step"), r6("p"))


@query(
    f"WITH d AS (SELECT name, g * 0.05 AS score, sum(p) OVER (PARTITION BY name ORDER BY g DESC) AS p FROM ({STEPS6})), w AS (SELECT DISTINCT name, x AS asked FROM d, (SELECT CAST(unnest([-9.03, -2.02, 0.01, 1.51, 3.33]) AS DOUBLE) AS x)), "
    "lo AS (SELECT w.name, asked, max_by(struct_pack(s := score, p := p), score) FILTER (score < asked) AS lo, min_by(struct_pack(s := score, p := p), score) FILTER (score >= asked) AS hi FROM w JOIN d USING (name) GROUP BY ALL) "
    "SELECT name, asked, round(CASE WHEN lo IS NULL THEN 1 WHEN hi IS NULL THEN 0 ELSE lo.p + (hi.p - lo.p) * (asked - lo.s) / (hi.s - lo.s) END, 6) AS p FROM lo"
)
def pwm_pvalues(spark, sf_dir):
    """Scores to p-values, linearly between the scores of a matrix' distribution."""
    m = scoring(spark, sf_dir)
    asked = m.select("name").distinct().select("name", F.explode(F.array(*map(F.lit, (-9.03, -2.02, 0.01, 1.51, 3.33)))).alias("asked"))
    return P.p_values(asked, m, "asked", 0.05).select("name", "asked", r6("p"))


@query()
def pwm_thresholds(spark, sf_dir):
    return P.thresholds(scoring(spark, sf_dir), 1e-3)
