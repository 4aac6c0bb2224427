"""Transcripts: exons, introns, coding regions and positions on them.

A transcript is (tx_id, ref, exon_starts, exon_ends, forward, cds_start,
cds_end): exons half-open on the reference in reference order, the coding
region null where there is none.  Positions on an element count along the
strand from the transcript's first base; the last coding base is coding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement, translate_codons
from strandlake.operators.elements import interval_to_element


def checked(tx: DataFrame) -> DataFrame:
    """``tx``, failing on a coding region that is empty or turned round."""
    bad = F.col("cds_start").isNotNull() & (F.col("cds_end") <= F.col("cds_start"))
    return tx.withColumn("cds_start", F.when(bad, F.raise_error(F.lit("empty coding region")).cast("long")).otherwise(F.col("cds_start")))


def exons(tx: DataFrame) -> DataFrame:
    """(tx_id, exon, s, e, before, phase pieces): exons along the strand with the mRNA bases before each.

    s and e are element positions; exon counts from 0 at the 5' end.
    """
    lo, hi = F.array_min("exon_starts"), F.array_max("exon_ends")
    each = tx.select("tx_id", "forward", "cds_start", "cds_end", lo.alias("_lo"), hi.alias("_hi"), F.explode(F.arrays_zip("exon_starts", "exon_ends")).alias("x"))
    s, e = interval_to_element(F.col("x.exon_starts"), F.col("x.exon_ends"), F.col("_lo"), F.col("_hi"), F.col("forward"))
    cs, ce = interval_to_element(F.col("cds_start"), F.col("cds_end"), F.col("_lo"), F.col("_hi"), F.col("forward"))
    w = Window.partitionBy("tx_id").orderBy("s")
    t = each.select("tx_id", s.alias("s"), e.alias("e"), cs.alias("cs"), ce.alias("ce"))
    before = F.sum(F.col("e") - F.col("s")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("e") - F.col("s"))
    return t.select("tx_id", (F.row_number().over(w) - 1).cast("long").alias("exon"), "s", "e", before.alias("before"), "cs", "ce")


def introns(exon_table: DataFrame) -> DataFrame:
    """(tx_id, intron, s, e) between consecutive exons."""
    w = Window.partitionBy("tx_id").orderBy("s")
    return exon_table.withColumn("_n", F.lead("s").over(w)).filter("_n IS NOT NULL").select("tx_id", F.col("exon").alias("intron"), F.col("e").alias("s"), F.col("_n").alias("e"))


def lengths(exon_table: DataFrame) -> DataFrame:
    """(tx_id, exons, premrna, mrna, utr5, cds, utr3): lengths in bases; coding ones null without a coding region."""
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("e"), b) - F.greatest(F.col("s"), a))
    far = F.lit(1 << 60)
    has = F.max("cs").isNotNull()
    out = exon_table.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("exons"),
        (F.max("e") - F.min("s")).alias("premrna"),
        F.sum(F.col("e") - F.col("s")).alias("mrna"),
        F.when(has, F.sum(inside(F.lit(0), F.col("cs")))).alias("utr5"),
        F.when(has, F.sum(inside(F.col("cs"), F.col("ce")))).alias("cds"),
        F.when(has, F.sum(inside(F.col("ce"), far))).alias("utr3"),
    )
    return out


def utr_intervals(exon_table: DataFrame) -> DataFrame:
    """(tx_id, utr5_s, utr5_e, utr3_s, utr3_e): element spans before and after the coding region, introns included."""
    t = exon_table.groupBy("tx_id").agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.max("cs").alias("cs"), F.max("ce").alias("ce")).filter("cs IS NOT NULL")
    return t.select("tx_id", F.col("lo").alias("utr5_s"), F.col("cs").alias("utr5_e"), F.col("ce").alias("utr3_s"), F.col("hi").alias("utr3_e"))


def on_mrna(positions: DataFrame, exon_table: DataFrame) -> DataFrame:
    """(tx_id, pos, mrna, utr5, cds, utr3, kind): element positions on the spliced transcript.

    Null in introns.  cds counts from the first coding base and may be negative
    or beyond; kind is utr5, cds, utr3, mrna (no coding region) or intron.
    """
    offset = F.greatest(F.lit(0), F.least(F.col("e"), F.col("cs")) - F.col("s"))
    bounds = exon_table.groupBy("tx_id").agg(F.sum(offset).alias("_five"), F.sum(F.greatest(F.lit(0), F.least(F.col("e"), F.col("ce")) - F.col("s"))).alias("_coded"), F.max("cs").alias("_cs"), F.max("ce").alias("_ce"))
    inside = exon_table.select("tx_id", "exon", "s", "e", "before")
    hit = positions.join(inside, "tx_id", "left").withColumn("_in", (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")))
    at = hit.groupBy("tx_id", "pos").agg(F.max(F.when(F.col("_in"), F.col("before") + F.col("pos") - F.col("s"))).alias("mrna"), F.max(F.when(F.col("_in"), F.col("exon"))).alias("exon"))
    t = at.join(bounds, "tx_id")
    m = F.col("mrna")
    kind = F.when(m.isNull(), "intron").when(F.col("_cs").isNull(), "mrna").when(F.col("pos") < F.col("_cs"), "utr5").when(F.col("pos") < F.col("_ce"), "cds").otherwise("utr3")
    has = F.col("_cs").isNotNull()
    return t.select("tx_id", "pos", m, F.when(kind == "utr5", m).alias("utr5"), F.when(has, m - F.col("_five")).alias("cds"), F.when(kind == "utr3", m - F.col("_coded")).alias("utr3"), kind.alias("kind"))


def from_cds(positions: DataFrame, exon_table: DataFrame) -> DataFrame:
    """(tx_id, cds, pos): coding positions to element positions, null outside the transcript."""
    five = exon_table.groupBy("tx_id").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("e"), F.col("cs")) - F.col("s"))).alias("_five"))
    t = positions.join(five, "tx_id").withColumn("_m", F.col("cds") + F.col("_five")).join(exon_table.select("tx_id", "s", "e", "before"), "tx_id", "left")
    hit = (F.col("_m") >= F.col("before")) & (F.col("_m") < F.col("before") + F.col("e") - F.col("s"))
    return t.groupBy("tx_id", "cds").agg(F.max(F.when(hit, F.col("s") + F.col("_m") - F.col("before"))).alias("pos"))


def phases(exon_table: DataFrame) -> DataFrame:
    """(tx_id, exon, start_phase, end_phase): coding phase of an exon's first base and after its last."""
    five = exon_table.groupBy("tx_id").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("e"), F.col("cs")) - F.col("s"))).alias("_five"))
    t = exon_table.join(five, "tx_id").filter("cs IS NOT NULL")
    first = F.col("before") - F.col("_five")
    return t.select("tx_id", "exon", F.pmod(first, F.lit(3)).alias("start_phase"), F.pmod(first + F.col("e") - F.col("s"), F.lit(3)).alias("end_phase"))


def sequences(tx: DataFrame, reference: DataFrame, exon_table: DataFrame) -> DataFrame:
    """(tx_id, mrna, utr5, cds, utr3, protein): spliced sequences; ``reference``: (tx_id, seq) of the transcript's span."""
    turned = tx.select("tx_id", "forward").join(reference, "tx_id").select("tx_id", F.when(F.col("forward"), F.col("seq")).otherwise(reverse_complement("seq")).alias("_seq"))
    part = F.col("_seq").substr((F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    spliced = exon_table.join(turned, "tx_id").groupBy("tx_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("exon", part.alias("p")))), lambda x: x["p"]), "").alias("mrna"))
    t = spliced.withColumnRenamed("mrna", "_m").join(lengths(exon_table).select("tx_id", "utr5", "cds", "utr3"), "tx_id")
    cut = lambda a, n: F.substring(F.col("_m"), (a + 1).cast("int"), n.cast("int"))
    u, c, v = F.col("utr5"), F.col("cds"), F.col("utr3")
    out = t.select("tx_id", F.col("_m").alias("mrna"), cut(F.lit(0), u).alias("utr5"), cut(u, c).alias("cds"), cut(u + c, v).alias("utr3"))
    return out.withColumn("protein", translate_codons("cds"))


def intervals_on_mrna(intervals: DataFrame, exon_table: DataFrame) -> DataFrame:
    """(tx_id, s, e, mrna_s, mrna_e, utr5_s, ..., utr3_e): both ends of element intervals mapped, each for itself."""
    parts = ("mrna", "utr5", "cds", "utr3")
    ends = intervals.select("tx_id", F.explode(F.array("s", "e")).alias("pos")).distinct()
    at = on_mrna(ends, exon_table)
    for end in ("s", "e"):
        own = at.select("tx_id", F.col("pos").alias(end), *[F.col(p).alias(f"{p}_{end}") for p in parts])
        intervals = intervals.join(own, ["tx_id", end])
    return intervals.select("tx_id", "s", "e", *[f"{p}_{end}" for p in parts for end in ("s", "e")])


def from_protein(positions: DataFrame, exon_table: DataFrame) -> DataFrame:
    """(tx_id, protein, pos): amino acids to the element position of their first base."""
    bases = positions.withColumn("cds", F.col("protein") * 3).select("tx_id", "cds")
    return from_cds(bases, exon_table).select("tx_id", F.floor(F.col("cds") / 3).alias("protein"), "pos")


def on_protein(positions: DataFrame, exon_table: DataFrame) -> DataFrame:
    """(tx_id, pos, protein): the amino acid each element position codes for, null outside the coding region."""
    t = on_mrna(positions, exon_table)
    return t.select("tx_id", "pos", F.when(F.col("kind") == "cds", F.floor(F.col("cds") / 3)).alias("protein"))
