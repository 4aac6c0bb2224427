"""Positional enrichment: motif profiles, hits, position counts and interval tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.stats import binomial_test_udf
from strandlake.operators.models import best_threshold, metrics
from strandlake.operators.similarity import pairs
from strandlake.operators.space import KmerSpace
from strandlake.operators.windows import adjust, features_profile, interval_scan


def profiles(seqs: DataFrame, motifs: DataFrame, half_win: int, space: KmerSpace) -> DataFrame:
    """(seq_id, label, motif_id, pos, bc): similarity of the window starting at ``pos`` (one-based); zeros left out.

    ``seqs``: (seq_id, label, seq), all of one length, centred.
    """
    bc = features_profile(motifs, seqs.select("seq_id", "seq"), 2 * half_win + 1, space).withColumnRenamed("start", "pos")
    return bc.join(seqs.select("seq_id", "label"), "seq_id")


def mean_ratio(profile: DataFrame, seqs: DataFrame) -> DataFrame:
    """(motif_id, pos, ratio): mean over positives by mean over negatives; absent values count as zero."""
    n = seqs.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("_n"))
    part = lambda k: F.sum(F.when(F.col("label") == k, F.col("bc")).otherwise(0.0))
    s = profile.groupBy("motif_id", "pos").agg(part(1).alias("x"), part(0).alias("y"))
    return s.join(F.broadcast(n)).select("motif_id", "pos", F.when(F.col("y") > 0, (F.col("x") / F.col("_p")) / (F.col("y") / F.col("_n"))).alias("ratio"))


def best_scores(profile: DataFrame, seqs: DataFrame, motifs: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(motif_id, seq_id, label, score): largest rounded similarity of each sequence, 0 if it has none."""
    grid = pairs(seqs, motifs, "seq_id", "motif_id").join(seqs.select("seq_id", "label"), "seq_id")
    top = profile.groupBy("motif_id", "seq_id").agg(F.max(F.round(F.col("bc") / tolerance) * tolerance).alias("score"))
    return grid.join(top, ["motif_id", "seq_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def thresholds(scores: DataFrame) -> DataFrame:
    """(motif_id, auroc, threshold): the threshold with the least error of ``score > threshold``.

    Where negatives score higher, labels are turned round and the area is negative.
    """
    area = metrics(scores, by=["motif_id"]).select("motif_id", F.col("auroc").alias("_a"))
    up = best_threshold(scores, by=["motif_id"]).select("motif_id", F.col("threshold").alias("_up"))
    down = best_threshold(scores.withColumn("label", 1 - F.col("label")), by=["motif_id"]).select("motif_id", F.col("threshold").alias("_down"))
    over = F.col("_a") > 0.5
    return area.join(up, "motif_id").join(down, "motif_id").select("motif_id", F.when(over, F.col("_a")).otherwise(F.col("_a") - 1).alias("auroc"), F.when(over, F.col("_up")).otherwise(F.col("_down")).alias("threshold"))


def hits(profile: DataFrame, scores: DataFrame, cut: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(motif_id, seq_id, label, score, pos): of sequences above the threshold the centre of the first plateau of the maximum."""
    good = scores.join(cut.select("motif_id", "threshold"), "motif_id").filter("score > threshold")
    rounded = profile.select("motif_id", "seq_id", "pos", (F.round(F.col("bc") / tolerance) * tolerance).alias("_v"))
    top = good.join(rounded, ["motif_id", "seq_id"]).filter(F.col("score") - F.col("_v") <= tolerance)
    w = Window.partitionBy("motif_id", "seq_id")
    island = F.col("pos") - F.row_number().over(w.orderBy("pos"))
    first = top.withColumn("_k", island).withColumn("_first", F.min("_k").over(w)).filter("_k = _first")
    return first.groupBy("motif_id", "seq_id", "label", "score").agg(F.floor((F.min("pos") + F.max("pos")) / 2).alias("pos"))


def position_counts(found: DataFrame, motifs: DataFrame, positions: int) -> DataFrame:
    """(motif_id, pos, np, nn): hits by position; the first and last window don't count, the others are numbered from 1."""
    n = found.filter((F.col("pos") > 1) & (F.col("pos") < positions)).groupBy("motif_id", (F.col("pos") - 1).alias("pos")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("np"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("nn")
    )
    grid = motifs.select(F.col("seq_id").alias("motif_id")).distinct().select("motif_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(positions - 2).cast("long"))).alias("pos"))
    return grid.join(n, ["motif_id", "pos"], "left").select("motif_id", "pos", F.coalesce("np", F.lit(0)).alias("np"), F.coalesce("nn", F.lit(0)).alias("nn"))


def folded(counts: DataFrame, positions: int) -> DataFrame:
    """Counts by distance from the centre; needs an odd number of positions."""
    if positions % 2 == 0:
        raise ValueError("folding needs an odd number of positions")
    return counts.groupBy("motif_id", (F.abs(F.col("pos") - (positions + 1) // 2) + 1).alias("pos")).agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))


def tests(counts: DataFrame, positives: int, negatives: int, tail: str = "upper", correction: str = "BH") -> DataFrame:
    """Every interval of positions of each motif with centrality and enrichment, their p and q (q within the motif).

    ``counts``: (motif_id, pos, np, nn) for every position from 1 on.
    """
    whole = counts.groupBy("motif_id").agg(F.sum("np").alias("np_all"), F.sum("nn").alias("nn_all"), F.max("pos").alias("npos"))
    scan = interval_scan(counts.withColumn("_m", F.col("pos") * F.col("np")), ["motif_id"], "pos", ["np", "nn", "_m"]).join(whole, "motif_id")
    width = F.col("end") - F.col("start") + 1
    share = width / F.col("npos")
    rate = F.col("nn") / F.lit(float(negatives))
    one = lambda x, n, p: binomial_test_udf(x, n, p, F.lit(tail))
    out = scan.select(
        "motif_id",
        "start",
        "end",
        F.when(F.col("np") > 0, F.col("_m") / F.col("np")).alias("mean_pos"),
        F.col("np").alias("np_in"),
        (F.col("np_all") - F.col("np")).alias("np_out"),
        F.col("nn").alias("nn_in"),
        (F.col("nn_all") - F.col("nn")).alias("nn_out"),
        F.when(F.col("np_all") > 0, F.col("np") / F.col("np_all") / share).alias("centrality"),
        one(F.col("np"), F.col("np_all"), share).alias("centrality_p"),
        F.when(F.col("nn") > 0, F.col("np") / F.lit(float(positives)) / rate).alias("enrichment"),
        one(F.col("np"), F.lit(positives), rate).alias("enrichment_p"),
    )
    return adjust(adjust(out, ["motif_id"], "centrality_p", correction).withColumnRenamed("q", "centrality_q"), ["motif_id"], "enrichment_p", correction).withColumnRenamed("q", "enrichment_q")


def with_peaks(tested: DataFrame, counts: DataFrame) -> DataFrame:
    """``tested`` with ``max_pos``: first position of the largest count in each interval."""
    inside = tested.select("motif_id", "start", "end").join(counts.select("motif_id", "pos", "np"), "motif_id").filter("pos BETWEEN start AND end")
    peak = inside.groupBy("motif_id", "start", "end").agg(F.max(F.struct("np", (-F.col("pos")).alias("p"))).alias("m")).select("motif_id", "start", "end", (-F.col("m.p")).alias("max_pos"))
    return tested.join(peak, ["motif_id", "start", "end"])


def central(tested: DataFrame, significance: float = 0.05) -> DataFrame:
    """Intervals significant and above 1 on both tests after correction for the number of motifs, best combined rank first."""
    from strandlake.operators.windows import rank_average

    n = tested.agg(F.countDistinct("motif_id").alias("_n"))
    kept = tested.join(F.broadcast(n)).filter((F.col("centrality_q") * F.col("_n") < significance) & (F.col("enrichment_q") * F.col("_n") < significance) & (F.col("centrality") > 1) & (F.col("enrichment") > 1))
    logs = kept.withColumns({"_a": F.round(-F.log10(F.greatest("centrality_q", F.lit(1e-300))), 9), "_b": F.round(-F.log10(F.greatest("enrichment_q", F.lit(1e-300))), 9)}).withColumn("_all", F.lit(1))
    scored = logs.withColumn("score", rank_average(["_all"], "_a") + rank_average(["_all"], "_b"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("_all").orderBy(F.col("score").desc(), F.col("_a").desc(), "motif_id", "start", "end"))).drop("_a", "_b", "_all", "_n")


def label_sizes(seqs: DataFrame) -> tuple[int, int]:
    """Numbers of positives and negatives."""
    n = {r["label"]: r["count"] for r in seqs.groupBy("label").count().collect()}
    return n.get(1, 0), sum(c for k, c in n.items() if k != 1)


def binned(counts: DataFrame, width: int) -> DataFrame:
    """Position counts in bins of ``width`` positions."""
    return counts.groupBy("motif_id", (F.floor(F.col("pos") / width) + 1).alias("pos")).agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))


def motif_map(seqs: DataFrame, motifs: DataFrame, half_win: int, space: KmerSpace, positions: int, tolerance: float = 1e-10, width: int = 1, significance: float = 0.05) -> DataFrame:
    """(motif_id, rank, auroc, threshold, start, end, centrality, ..., score): enriched motifs, the best interval of each, best first.

    ``seqs``: (seq_id, label, seq), all of one length, positives with label 1;
    ``positions``: window starts of a sequence.
    """
    p = profiles(seqs, motifs, half_win, space)
    scores = best_scores(p, seqs, motifs, tolerance)
    cut = thresholds(scores)
    counts = position_counts(hits(p, scores, cut, tolerance), motifs, positions)
    ranked = central(tests(binned(counts, width) if width > 1 else counts, *label_sizes(seqs)), significance)
    best = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("motif_id").orderBy("place"))).filter("_k = 1").drop("_k")
    # One row a motif is left to number.
    return best.join(cut, "motif_id").withColumn("_all", F.lit(1)).withColumn("rank", F.row_number().over(Window.partitionBy("_all").orderBy("place"))).drop("_all", "place")


def fit_profile(ratio: DataFrame, center: int, restarts: int = 8, seed: int = 0) -> DataFrame:
    """(motif_id, shape, height, width, position, base, aic, peak95): which curve fits each motif's mean ratio best.

    Two curves over the distance from ``center``: one centred bell, and twin
    bells at plus and minus ``position``; the better by AIC is kept.  peak95 is
    the distance within which 95 % of the curve above its base lies.
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        from strandlake.functions.stats import aic

        x, y = pdf["pos"].to_numpy(float) - center, pdf["ratio"].to_numpy(float)
        ok = np.isfinite(y)
        x, y = x[ok], y[ok]
        bell = lambda w, p: np.exp(-(((x - p) / w) ** 2))
        span, best = max(np.abs(x).max(initial=1.0), 1.0), None
        rng = np.random.default_rng(seed)
        for shape, k in (("centred", 3), ("twin", 4)):
            starts = [(span / 4, 0.0 if shape == "centred" else span / 2)] + [(span * u, 0.0 if shape == "centred" else span * v) for u, v in rng.random((restarts, 2)) * 0.9 + 0.05]
            for w, p in starts:
                step = span / 4
                value = np.inf

                def solve(w, p):
                    curve = bell(w, 0.0) if shape == "centred" else bell(w, p) + bell(w, -p)
                    m = np.stack([curve, np.ones_like(curve)], axis=1)
                    c, *_ = np.linalg.lstsq(m, y, rcond=None)
                    return float(((m @ c - y) ** 2).sum()), c

                value, c = solve(w, p)
                while step > span * 1e-4:  # pattern search over width and position; height and base are linear
                    moves = [(max(w + a * step, 0.5), min(max(p + b * step, 0.0), span)) for a in (-1, 0, 1) for b in ((-1, 0, 1) if shape == "twin" else (0,))]
                    tried = [(*solve(*q), *q) for q in moves]
                    top = min(tried, key=lambda t: t[0])
                    if top[0] < value - 1e-15:
                        value, c, w, p = top
                    else:
                        step /= 2
                score = aic(max(value, 1e-12), len(x), k)
                if best is None or score < best[0] - 1e-9:
                    best = (score, shape, float(c[0]), float(w), float(p), float(c[1]))
        score, shape, height, w, p, base = best
        curve = np.abs(height * (bell(w, 0.0) if shape == "centred" else bell(w, p) + bell(w, -p)))
        far = np.argsort(np.abs(x), kind="stable")
        mass = np.cumsum(curve[far]) / max(curve.sum(), 1e-300)
        return pd.DataFrame({"motif_id": [pdf["motif_id"].iloc[0]], "shape": [shape], "height": [height], "width": [w], "position": [p], "base": [base], "aic": [score], "peak95": [float(np.abs(x)[far][min(int(np.searchsorted(mass, 0.95)), len(x) - 1)])]})

    return ratio.groupBy("motif_id").applyInPandas(fit, "motif_id long, shape string, height double, width double, position double, base double, aic double, peak95 double")
