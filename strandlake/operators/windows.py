"""Sliding windows over sequences and numeric vectors, ranks and p-value adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.counting import lmer_positions, words
from strandlake.operators.space import KmerSpace


def profile_counts(seqs: DataFrame, win: int, space: KmerSpace) -> DataFrame:
    """(seq_id, start, kmer, n): counts in the window of ``win`` characters from each start.

    A word with an invalid character isn't counted.  Each occurrence is sent to
    the windows that hold it, so rows grow with ``win`` and nothing is gathered.
    """
    if win < space.l:
        raise ValueError("the window is shorter than a word")
    sizes = seqs.select("seq_id", (F.length("seq") - win + 1).alias("_starts")).filter("_starts > 0")
    held = words(lmer_positions(seqs, space.l), space).join(sizes, "seq_id")
    first, last = F.greatest(F.col("pos") - (win - space.l), F.lit(1)), F.least(F.col("pos"), F.col("_starts"))
    return held.filter(last >= first).select("seq_id", "kmer", F.explode(F.sequence(first, last)).alias("start")).groupBy("seq_id", "start", "kmer").agg(F.count(F.lit(1)).alias("n"))


def profile(seqs: DataFrame, win: int, space: KmerSpace) -> DataFrame:
    """(seq_id, start, kmer, w): one distribution per window start; windows without words have none."""
    n = profile_counts(seqs, win, space)
    return n.select("seq_id", "start", "kmer", F.sqrt(F.col("n") / F.sum("n").over(Window.partitionBy("seq_id", "start"))).alias("w"))


def features_profile(motifs: DataFrame, seqs: DataFrame, win: int, space: KmerSpace) -> DataFrame:
    """(seq_id, start, motif_id, bc)."""
    from strandlake.operators.similarity import features

    windows = profile(seqs, win, space).select(F.struct("seq_id", "start").alias("seq_id"), "kmer", "w")
    return features(windows, motifs).select("seq_id.seq_id", "seq_id.start", "motif_id", "bc")


def sliding(df: DataFrame, partition: list[str], order: str, value: str, length: int, pos: int) -> DataFrame:
    """``df`` with win_count, win_min, win_max, win_sum, win_squares, win_mean and win_std of ``length`` values.

    A window's results stand at its element ``pos``; where the window doesn't
    fit they are null.  Nulls inside a window are skipped.
    """
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-pos, length - 1 - pos)
    fits = F.count(F.lit(1)).over(w) == length
    out = {
        "win_count": F.count(value).over(w),
        "win_min": F.min(value).over(w),
        "win_max": F.max(value).over(w),
        "win_sum": F.sum(value).over(w),
        "win_squares": F.sum(F.col(value) * F.col(value)).over(w),
        "win_mean": F.avg(value).over(w),
        "win_std": F.stddev_samp(value).over(w),
    }
    return df.withColumns({k: F.when(fits, v) for k, v in out.items()})


def rank_average(partition: list[str], value, descending: bool = False):
    """Rank with ties sharing their mean rank."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(w.orderBy(order)) + (ties - 1) / 2


def adjust(df: DataFrame, partition: list[str], p: str, method: str = "BH") -> DataFrame:
    """``df`` with ``q``: BH (fdr), BY, bonferroni, holm, hochberg or none, within each partition of tests.

    Tied tests share a rank (the last of theirs; holm: the first), so each
    extremum is a running one over the tests before in one sorted order and
    costs one pass.  A null ``p`` is no test and has a null ``q``.
    """
    w, value = Window.partitionBy(*partition), F.col(p)
    n, upto = F.count(p).over(w), F.count(p).over(w.orderBy(value.asc_nulls_last()))
    if method == "none":
        return df.withColumn("q", value)
    if method == "bonferroni":
        x = value * n
    elif method == "holm":
        df = df.withColumn("_x", value * (n - F.rank().over(w.orderBy(value.asc_nulls_last())) + 1))
        x = F.max("_x").over(w.orderBy(value.asc_nulls_last()))
    else:
        share = {"BH": n / upto, "fdr": n / upto, "BY": n / upto, "hochberg": n - upto + 1}[method]
        df = df.withColumn("_x", value * share)
        x = F.min("_x").over(w.orderBy(value.desc_nulls_last()))
        if method == "BY":
            place = F.row_number().over(w.orderBy(value.asc_nulls_last()))
            df = df.withColumn("_i", F.when(value.isNotNull(), place))
            x = F.min("_x").over(w.orderBy(value.desc_nulls_last())) * F.sum(1 / F.col("_i")).over(w)
    return df.withColumn("q", F.when(value.isNotNull(), F.least(F.lit(1.0), x))).drop("_x", "_i")


def quantile_class(df: DataFrame, value: str, classes: int) -> DataFrame:
    """``df`` with ``class``: 1 to ``classes`` by interpolated quantiles, each class closed above, the first also below."""
    cuts = df.agg(F.percentile(value, F.array(*[F.lit(i / classes) for i in range(1, classes)])).alias("_cuts"))
    return df.join(F.broadcast(cuts)).withColumn("class", (F.size(F.filter("_cuts", lambda c: c < F.col(value))) + 1).cast("long")).drop("_cuts")


def rank_category(rank):
    """Ranks as 1, 2-3, 4-10 and above."""
    return F.when(rank <= 1, "1").when(rank <= 3, "2-3").when(rank <= 10, "4-10").otherwise(">10")


def interval_scan(counts: DataFrame, partition: list[str], pos: str, values: list[str]) -> DataFrame:
    """Every interval of positions with the sums of ``values`` in it: (partition, start, end, values).

    ``counts`` has a row for each position, zeros included.  Prefix sums make
    each interval a difference of two rows; the rows of a partition are its
    positions, n of them give n (n + 1) / 2 intervals, which is the result.
    """
    w = Window.partitionBy(*partition).orderBy(pos)
    cum = counts.select(*partition, pos, *[F.sum(v).over(w).alias(f"_{v}") for v in values], *[F.col(v) for v in values])
    ends = cum.select(*partition, F.col(pos).alias("end"), *[F.col(f"_{v}").alias(f"_{v}_end") for v in values])
    starts = cum.select(*partition, F.col(pos).alias("start"), *[(F.col(f"_{v}") - F.col(v)).alias(f"_{v}_before") for v in values])
    return starts.join(ends, partition).filter("start <= end").select(*partition, "start", "end", *[(F.col(f"_{v}_end") - F.col(f"_{v}_before")).alias(v) for v in values])
