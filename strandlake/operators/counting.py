"""K-mer counts and distributions.

Sequences are (seq_id, seq); counts (seq_id, kmer, n); distributions
(seq_id, kmer, w) with w the square root of the k-mer's share, zeros left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import canonical, runs, upper_bases
from strandlake.operators.space import KmerSpace, gapped

#: Runs are cut into overlapping pieces of so many starts, so that no row holds a chromosome.
PIECE = 1024


def _pieces(whole: DataFrame, length: int, carried: list[str]) -> DataFrame:
    """(carried, start, lmer) of every substring of ``length`` of ``_s``, one-based starts."""
    starts = F.length("_s") - length + 1
    piece = whole.filter(starts > 0).select(*carried, starts.alias("_n"), "_s", F.explode(F.sequence(F.lit(0), F.floor((starts - 1) / PIECE).cast("int"))).alias("_p"))
    piece = piece.select(*carried, "_p", F.least(F.lit(PIECE), F.col("_n") - F.col("_p") * PIECE).cast("int").alias("_m"), F.col("_s").substr(F.col("_p") * PIECE + 1, F.lit(PIECE + length - 1)).alias("_s"))
    out = piece.select(*carried, "_p", "_s", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_i"))
    return out.select(*carried, (F.col("_p") * PIECE + F.col("_i")).alias("pos"), F.col("_s").substr(F.col("_i"), F.lit(length)).alias("lmer"))


def lmers(seqs: DataFrame, l: int, strict: bool = False) -> DataFrame:  # noqa: E741
    """(seq_id, lmer) of every l-mer within runs."""
    return _pieces(seqs.select("seq_id", F.explode(runs("seq", strict)).alias("_s")), l, ["seq_id"]).drop("pos")


def lmer_positions(seqs: DataFrame, l: int) -> DataFrame:  # noqa: E741
    """(seq_id, pos, lmer) of every l-mer without invalid characters, pos one-based in the sequence."""
    return _pieces(seqs.select("seq_id", upper_bases("seq").alias("_s")), l, ["seq_id"]).filter(~F.col("lmer").rlike("[^ACGT]"))


def words(occurrences: DataFrame, space: KmerSpace) -> DataFrame:
    """Occurrences with ``lmer`` replaced by the space's words ``kmer``."""
    others = [c for c in occurrences.columns if c != "lmer"]
    if space.gaps:
        return occurrences.select(*others, F.explode(gapped(F.col("lmer"), space)).alias("kmer"))
    return occurrences.select(*others, (canonical("lmer") if space.ds else F.col("lmer")).alias("kmer"))


def count(seqs: DataFrame, space: KmerSpace, strict: bool = False) -> DataFrame:
    """(seq_id, kmer, n).  Sequences without a k-mer have no rows.

    With both strands and gaps, one l-mer is counted once per mask and word.
    """
    if space.gaps:  # gapped words from distinct l-mers: fewer rows to expand
        plain = lmers(seqs, space.l, strict).groupBy("seq_id", "lmer").agg(F.count(F.lit(1)).alias("n"))
        return words(plain, space).groupBy("seq_id", "kmer").agg(F.sum("n").alias("n"))
    return words(lmers(seqs, space.l, strict), space).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


def hellinger(counts: DataFrame, value: str = "n", key: str = "seq_id") -> DataFrame:
    """(key, kmer, w): w = sqrt(n / sum of n over the key)."""
    total = F.sum(value).over(Window.partitionBy(key))
    return counts.select(key, "kmer", F.sqrt(F.col(value) / total).alias("w"))


def distribution(seqs: DataFrame, space: KmerSpace, strict: bool = False, estimate: bool = False) -> DataFrame:
    """(seq_id, kmer, w).  ``estimate`` with gaps gives smoothed l-mers instead of gapped words."""
    if estimate and space.gaps:
        return hellinger(estimated(count(seqs, KmerSpace(space.l, 0, False), strict), space), "n")
    return hellinger(count(seqs, space, strict))


def project(values, l: int, order: int):  # noqa: E741
    """Part of a function on the 4**l l-mers with interactions of at most ``order`` positions.

    ``values``: an array whose last axis is the l-mers in base-4 order.  One
    pass per position keeps the parts of each order apart.
    """
    import numpy as np

    parts = [np.asarray(values, float).reshape(*np.shape(values)[:-1], *[4] * l)]
    first = parts[0].ndim - l
    for axis in range(first, first + l):
        means = [p.mean(axis=axis, keepdims=True) for p in parts]
        flat = [np.broadcast_to(m, p.shape) for m, p in zip(means, parts)]
        rest = [p - m for m, p in zip(means, parts)]
        parts = [(flat[n] if n < len(flat) else 0) + (rest[n - 1] if n else 0) for n in range(min(len(parts) + 1, order + 1))]
    return sum(parts).reshape(np.shape(values))


def estimated(counts: DataFrame, space: KmerSpace, eps: float = 1e-12, key: str = "seq_id") -> DataFrame:
    """Smoothed l-mer counts (key, kmer, n) from l-mer counts (key, kmer, n).

    The estimate spreads gapped-word counts over all l-mers by their number of
    mismatches; this equals the projection of the counts on interactions of at
    most l - gaps positions, found here for one id's vector of 4**l at a time.
    Contributions of runs and of strands add up.  Values up to ``eps`` go.
    """
    l, kept, ds = space.l, space.l - space.gaps, space.ds  # noqa: E741
    kind = dict(counts.dtypes)[key]

    def smooth(pdf):
        import numpy as np
        import pandas as pd

        base = str.maketrans("ACGT", "0123")
        v = np.zeros(4**l)
        np.add.at(v, [int(k.translate(base), 4) for k in pdf["kmer"]], pdf["n"].to_numpy(float))
        est = project(v, l, kept)
        if not ds:
            est = np.where(est > eps, est, 0)
        at = np.flatnonzero(est)
        names = ["".join("ACGT"[i >> 2 * (l - 1 - p) & 3] for p in range(l)) for i in at.tolist()]
        if ds:
            flip = str.maketrans("ACGT", "TGCA")
            names = [min(w, w.translate(flip)[::-1]) for w in names]
        out = pd.DataFrame({key: pdf[key].iloc[0] if len(pdf) else None, "kmer": names, "n": est[at]})
        out = out.groupby([key, "kmer"], as_index=False, dropna=False)["n"].sum()
        return out[out["n"] > eps]

    return counts.select(key, "kmer", F.col("n").cast("double").alias("n")).groupBy(key).applyInPandas(smooth, f"{key} {kind}, kmer string, n double")


def estimate_motifs(motifs: DataFrame, space: KmerSpace, key: str = "seq_id") -> DataFrame:
    """Smoothed motifs from l-mer motifs (key, kmer, w): the same weights on w squared."""
    return hellinger(estimated(motifs.select(key, "kmer", (F.col("w") * F.col("w")).alias("n")), space, 0.0, key), "n", key)


def mix(a: DataFrame, b: DataFrame, key: str = "seq_id") -> DataFrame:
    """sqrt((a^2 + b^2) / 2) of two sets of distributions with common ids."""
    both = a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), [key, "kmer"], "full")
    sq = lambda c: F.coalesce(F.col(c) * F.col(c), F.lit(0.0))
    return both.select(key, "kmer", F.sqrt((sq("wa") + sq("wb")) / 2).alias("w"))


def information(motifs: DataFrame, space: KmerSpace, key: str = "seq_id") -> DataFrame:
    """(key, ic): log2 of the dictionary size less the entropy."""
    p = F.col("w") * F.col("w")
    return motifs.filter("w > 0").groupBy(key).agg((F.log2(F.lit(float(space.size))) + F.sum(p * F.log2(p))).alias("ic"))


def merge(a: DataFrame, b: DataFrame, space_a: KmerSpace, space_b: KmerSpace, key: str = "seq_id") -> DataFrame:
    """Both sets, the second's ids after the first's."""
    space_a.check(space_b)
    top = a.agg(F.coalesce(F.max(key) + 1, F.lit(0)).alias("_top"))  # one row
    moved = b.join(F.broadcast(top)).select((F.col(key) + F.col("_top")).alias(key), "kmer", "w")
    return a.select(key, "kmer", "w").unionByName(moved)


def select(dist: DataFrame, ids: DataFrame, key: str = "seq_id") -> DataFrame:
    """Distributions whose id is in ``ids``; rows (k-mers) can't be left out, or they would be no distributions."""
    return dist.join(ids.select(key).distinct(), key, "left_semi")


def centroids(dist: DataFrame, labels: DataFrame, key: str = "seq_id") -> DataFrame:
    """(cluster, kmer, w): square root of the mean square, absent words count as zero."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    summed = dist.join(labels.select(key, "cluster"), key).groupBy("cluster", "kmer").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    return summed.join(sizes, "cluster").select("cluster", "kmer", F.sqrt(F.col("s") / F.col("size")).alias("w"))


