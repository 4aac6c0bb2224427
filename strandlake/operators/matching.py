"""Motif matching: similarities judged against regressions on information content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.stats import normal_upper_udf
from strandlake.operators.counting import information
from strandlake.operators.similarity import dense, similarity
from strandlake.operators.space import KmerSpace
from strandlake.operators.windows import adjust


def _residuals(s: DataFrame, by: str) -> DataFrame:
    """``s`` (a, b, s, x) with the residual ``d`` of the regression of s on x within ``by``."""
    w = Window.partitionBy(by)
    n, sx, sy = F.count("s").over(w), F.sum("x").over(w), F.sum("s").over(w)
    sxx, sxy = F.sum(F.col("x") * F.col("x")).over(w), F.sum(F.col("x") * F.col("s")).over(w)
    spread = sxx - sx * sx / n
    slope = F.when(spread > 1e-12, (sxy - sx * sy / n) / spread).otherwise(0.0)
    fitted = s.withColumn("slope", slope).withColumn("intercept", (sy - F.col("slope") * sx) / n)
    return fitted.withColumn("d", F.col("s") - F.col("intercept") - F.col("slope") * F.col("x"))


def _scored(q: DataFrame, t: DataFrame, space: KmerSpace) -> DataFrame:
    """(a, b, s, x): similarity and geometric mean of information of every query and target."""
    s = dense(similarity(q, t), q, t)
    iq = information(q, space).select(F.col("seq_id").alias("a"), F.col("ic").alias("_iq"))
    it = information(t, space).select(F.col("seq_id").alias("b"), F.col("ic").alias("_it"))
    return s.join(iq, "a").join(it, "b").select("a", "b", "s", F.sqrt(F.greatest(F.col("_iq") * F.col("_it"), F.lit(0.0))).alias("x"))


def target_info(targets: DataFrame, space: KmerSpace) -> DataFrame:
    """(target, mean, sd, intercept, slope): each target's similarities to all targets against information."""
    fit = _residuals(_scored(targets, targets, space), "a")
    return fit.groupBy(F.col("a").alias("target")).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.first("intercept").alias("intercept"), F.first("slope").alias("slope"))


def global_fit(targets: DataFrame, space: KmerSpace) -> DataFrame:
    """One row: slope, intercept, mean and sd of the residuals over all pairs a < b."""
    s = _scored(targets, targets, space).filter("a < b").withColumn("_all", F.lit(1))
    r = s.agg(F.regr_slope("s", "x").alias("slope"), F.regr_intercept("s", "x").alias("intercept"))
    d = s.join(F.broadcast(r)).withColumn("d", F.col("s") - F.col("intercept") - F.col("slope") * F.col("x"))
    return d.agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))


def match(queries: DataFrame, targets: DataFrame, space: KmerSpace, correction: str = "BH", info: DataFrame | None = None) -> DataFrame:
    """(query, target, p, q, e, similarity) of every pair."""
    info = target_info(targets, space) if info is None else info
    fit = _residuals(_scored(queries, targets, space), "a").join(info.select(F.col("target").alias("b"), F.col("mean").alias("_m"), F.col("sd").alias("_sd")), "b")
    z = (F.col("d") - F.col("_m")) / F.col("_sd")
    scored = fit.withColumn("p", normal_upper_udf(z)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a")))
    return adjust(scored, ["a"], "p", correction).select(F.col("a").alias("query"), F.col("b").alias("target"), "p", "q", (F.col("p") * 2 * F.col("n")).alias("e"), F.col("s").alias("similarity"))


_ORDER = {"similarity": lambda: [F.col("similarity").desc()], "p": lambda: [F.col("p")], "q": lambda: [F.col("q"), F.col("similarity").desc()], "e": lambda: [F.col("e"), F.col("similarity").desc()]}


def select_hits(matches: DataFrame, threshold: float = 0.5, select_by: str = "q", best_hit: bool = False, sort_by: str = "similarity") -> DataFrame:
    """Hits with ``rank`` in their query.  p, q and e must be below the threshold, similarity at or above it."""
    keep = F.col(select_by) >= threshold if select_by == "similarity" else F.col(select_by) < threshold
    w = Window.partitionBy("query").orderBy(*_ORDER[sort_by](), "target")
    ranked = matches.filter(keep).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter("rank = 1") if best_hit else ranked


def annotate(motifs: DataFrame, reference: DataFrame, share: float, names: DataFrame, separator: str = "_") -> DataFrame:
    """(motif, name, hits, mean_rank, mean_score): reference names of the most hits of each motif.

    A hit is a similarity above ``share`` of the largest among different motifs.
    ``names``: (seq_id, name) of the reference, a name may join several by ``separator``.
    """
    s = similarity(motifs, reference)
    top = similarity(motifs, motifs).filter("a < b").agg(F.max("s").alias("_top"))
    w = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    hits = s.join(F.broadcast(top)).filter(F.col("s") > F.col("_top") * share).withColumn("k", F.row_number().over(w))
    each = hits.join(names.select(F.col("seq_id").alias("b"), F.explode(F.split("name", separator)).alias("name")), "b")
    grouped = each.groupBy(F.col("a").alias("motif"), "name").agg(F.count(F.lit(1)).alias("hits"), F.avg("k").alias("mean_rank"), F.avg("s").alias("mean_score"))
    most = F.max("hits").over(Window.partitionBy("motif"))
    return grouped.withColumn("_most", most).filter("hits = _most").drop("_most")
