"""Genomic intervals: overlap joins, exclusion, greedy selection, sequences and matched background.

Intervals are (chrom, start, end), zero-based and half-open, with any further
columns.  Two intervals count as overlapping when they share a base *or touch*
(end of one equal to the start of the other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import gc_repeat_key, reverse_complement

BIN = 1 << 14


def _bins(start, end, width):
    return F.sequence(F.floor(start / width), F.floor(F.greatest(end, start) / width))


def overlapping(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (columns a_*, b_*) whose intervals overlap or touch.

    Both sides are expanded to the bins they reach and joined on (chrom, bin);
    a pair is emitted only in the bin of its later start, so there are no
    repeats and no distinct.  ``width`` should be near the usual length.
    """
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("_bin", F.explode(_bins(F.col("a_start"), F.col("a_end"), width)))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_bin2", F.explode(_bins(F.col("b_start"), F.col("b_end"), width)))
    meets = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    once = F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)
    return left.join(right, (F.col("a_chrom") == F.col("b_chrom")) & (F.col("_bin") == F.col("_bin2")) & meets & once).drop("_bin", "_bin2")


def covering(a: DataFrame, b: DataFrame, min_overlap: int = 0, width: int = BIN) -> DataFrame:
    """Pairs where b's interval covers a: wholly with ``min_overlap`` 0, else by so many bases."""
    pairs = overlapping(a, b, width)
    if min_overlap == 0:
        return pairs.filter("b_start <= a_start AND a_end <= b_end")
    return pairs.filter((F.least("a_end", "b_end") - F.greatest("a_start", "b_start")) >= min_overlap)


def excluding(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of ``a`` that neither overlap nor touch an interval of ``b``."""
    right = b.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(_bins(F.col("start"), F.col("end"), width)).alias("_k"))
    keyed = a.withColumn("_bins", _bins(F.col("start"), F.col("end"), width))
    hit = keyed.select(*a.columns, F.explode("_bins").alias("_bin")).join(right, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_k")) & (F.col("start") <= F.col("_e")) & (F.col("_s") <= F.col("end")), "left_semi")
    bad = hit.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    return a.join(bad, (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left_anti")


def clusters(df: DataFrame, touching: bool = True, width: int = BIN) -> DataFrame:
    """``df`` with ``cluster``: number, within its chrom, of the chain of intervals it hangs together with.

    Intervals are ordered within bins of ``width`` bases; only one row a bin
    (how far its intervals reach, how many chains begin in it) goes through a
    window over the chromosome, so no task sorts a chromosome's intervals.
    What lies before an interval also orders equal ones, so that both windows
    see them in the same order.  A missing end reaches nowhere; a missing start
    begins no chain and comes last.
    """
    at = F.col("_i.start"), F.col("_i.end")
    held = df.select(F.struct(*df.columns).alias("_i"), F.col("chrom").alias("_c"), F.floor(F.col("start") / width).alias("_k"))
    w, earlier = Window.partitionBy("_c", "_k"), Window.partitionBy("_c").orderBy(F.asc_nulls_last("_k")).rowsBetween(Window.unboundedPreceding, -1)
    order = [x.asc_nulls_last() for x in at]

    def with_bins(rows, value, total, name):
        """``rows`` with ``name``: the total of ``value`` over the earlier bins of the chromosome."""
        bins = rows.groupBy("_c", "_k").agg(total(value).alias("_v")).select(F.col("_c").alias("_bc"), F.col("_k").alias("_bk"), total("_v").over(earlier).alias(name))
        return rows.join(bins, F.col("_c").eqNullSafe(F.col("_bc")) & F.col("_k").eqNullSafe(F.col("_bk"))).drop("_bc", "_bk")

    reached = with_bins(held, at[1], F.max, "_reach")
    before = F.greatest(F.max(at[1]).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    apart = F.coalesce((at[0] > F.col("_before")) if touching else (at[0] >= F.col("_before")), F.lit(False))
    begins = reached.withColumn("_before", before).withColumn("_new", apart.cast("long"))
    numbered = begins.withColumn("_nth", F.sum("_new").over(w.orderBy(*order, F.asc_nulls_first("_before")).rowsBetween(Window.unboundedPreceding, 0)))
    begun = with_bins(numbered, F.col("_new"), F.sum, "_past")
    number = 1 + F.coalesce("_past", F.lit(0)) + F.col("_nth")
    return begun.select("_i.*", number.alias("cluster"))


def merged(df: DataFrame, touching: bool = False) -> DataFrame:
    """(chrom, start, end) of the unions of overlapping intervals."""
    return clusters(df, touching).groupBy("chrom", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("cluster")


def first_come(df: DataFrame, order: str) -> DataFrame:
    """Greedy set of intervals in the order of ``order``: one stays if it meets none that stayed before.

    The choice only depends on intervals chained to each other, so chains are
    scanned apart, a thousand neighbouring ones to a group, and no chromosome
    is gathered into one task.
    """
    columns = df.columns

    def scan(pdf):
        from bisect import bisect_left, insort

        pdf = pdf.sort_values(order, kind="stable")
        kept, starts, ends = [], [], []
        for i, (s, e, unknown) in enumerate(zip(pdf["start"], pdf["end"], pdf["start"].isna() | pdf["end"].isna())):
            if unknown:  # meets nothing
                kept.append(i)
                continue
            at = bisect_left(starts, s)
            if (at < len(starts) and starts[at] <= e) or (at > 0 and ends[at - 1] >= s):
                continue
            insort(starts, s)
            ends.insert(at, e)
            kept.append(i)
        return pdf.iloc[kept][columns]

    return clusters(df).groupBy("chrom", F.floor(F.col("cluster") / 1000)).applyInPandas(scan, df.schema)


def sequences(bed: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """``bed`` with ``seq``: bases of each interval, reverse-complemented on the - strand.

    ``genome``: (chrom, chunk_id, seq) in pieces of ``chunk`` bases, so that a
    read touches the pieces it needs and no chromosome is held whole.
    """
    names = bed.columns
    keyed = bed.withColumn("_row", F.struct(*names)).withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / chunk))))
    piece = genome.select(F.col("chrom").alias("_c"), F.col("chunk_id").alias("_id"), F.col("seq").alias("_seq"))
    base = F.col("_id") * chunk
    cut = F.col("_seq").substr((F.greatest(F.col("start") - base, F.lit(0)) + 1).cast("int"), F.greatest(F.lit(0), F.least(F.col("end") - base, F.lit(chunk)) - F.greatest(F.col("start") - base, F.lit(0))).cast("int"))
    parts = keyed.join(piece, (F.col("chrom") == F.col("_c")) & (F.col("_k") == F.col("_id"))).select("_row", F.struct("_k", cut.alias("s")).alias("p"))
    whole = parts.groupBy("_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))
    return whole.select("_row.*", "seq").withColumn("seq", F.when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq")))


def windows_of(df: DataFrame, mode: str, w: int) -> DataFrame:
    """Intervals around a whole region (0), its start, its last base or its middle, 2 w wide."""
    at = {"start": F.col("start"), "end": F.col("end") - 1, "middle": F.floor((F.col("start") + F.col("end")) / 2)}
    if mode == "whole":
        return df
    return df.withColumns({"start": at[mode] - w, "end": at[mode] + w})


def background(selected: DataFrame, excluded: DataFrame, candidates: DataFrame, n: int = 0) -> DataFrame:
    """Background regions matched to ``selected`` by length and GC and repeat bin.

    All three are (chrom, start, end, seq); each background region is a
    candidate that meets no excluded, selected or earlier accepted region, and
    at most as many are taken per (length, key) as are selected.  ``n`` of 0
    matches all.  A candidate's turn is its hashed place, so reruns agree.
    """
    key = lambda df: df.select("chrom", "start", "end", (F.col("end") - F.col("start")).alias("size"), gc_repeat_key("seq").alias("key"))
    wanted = key(selected).groupBy("size", "key").agg(F.count(F.lit(1)).alias("need"))
    total = selected.count()
    if n > total:
        raise ValueError("more background than selected regions")
    free = excluding(key(candidates), excluded.select("chrom", "start", "end").unionByName(selected.select("chrom", "start", "end")))
    turn = F.md5(F.concat_ws(":", "chrom", "start", "end"))
    apart = first_come(free.join(wanted.select("size", "key"), ["size", "key"], "left_semi").select("chrom", "start", "end", "size", "key").withColumn("turn", turn), "turn")
    ranked = apart.join(wanted, ["size", "key"]).withColumn("i", F.row_number().over(Window.partitionBy("size", "key").orderBy("turn", "chrom", "start"))).filter("i <= need")
    out = ranked.select("chrom", "start", "end", "size", "key")
    return out.orderBy(F.md5(F.concat_ws(":", "chrom", "start")), "chrom", "start").limit(n) if n else out


def random_intervals(spark: SparkSession, lengths: dict[str, int], n: int, size: int, seed: int) -> DataFrame:
    """``n`` intervals of ``size`` bases, chromosomes uniform, starts uniform."""
    names = sorted(c for c, m in lengths.items() if m >= size)
    table = F.create_map(*[F.lit(x) for c in names for x in (c, lengths[c])])
    chrom = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.rand(seed) * len(names)) + 1).cast("int"))
    df = spark.range(n).select(chrom.alias("chrom"), F.rand(seed + 1).alias("u"))
    start = F.floor(F.col("u") * (table[F.col("chrom")] - size + 1)).cast("long")
    return df.select("chrom", start.alias("start"), (start + size).alias("end"))
