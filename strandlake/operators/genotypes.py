"""Genotypes in long form: (interval, pos, subject, a1, a2, phased) with allele ids, and variants (interval, pos, alleles).

Allele 0 is the reference; a null id is a missing call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["interval", "pos"]


def maf(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """(interval, pos, maf): minor-allele share of biallelic variants, else null; missing calls stay in the denominator."""
    zero = lambda c: F.sum(F.when(F.col(c) == 0, 1).otherwise(0))
    f = (zero("a1") + zero("a2")) / (2 * F.count(F.lit(1)))
    t = genotypes.groupBy(*KEY).agg(f.alias("f"))
    return variants.join(t, KEY, "left").select(*KEY, F.when(F.size("alleles") == 2, F.least(F.col("f"), 1 - F.col("f"))).alias("maf"))


def matrix(genotypes: DataFrame, as_haplotypes: bool = False) -> DataFrame:
    """(interval, pos, subject, copy, allele): two rows a subject; haplotypes drop unphased calls to null."""
    t = genotypes.select(*KEY, "subject", "phased", F.posexplode(F.array("a1", "a2")).alias("copy", "allele"))
    return t.select(*KEY, "subject", "copy", F.when(F.col("phased"), F.col("allele")).alias("allele") if as_haplotypes else "allele")


def haplotypes(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """(subject, copy, haplotype): allele letters in variant order, N where missing."""
    t = matrix(genotypes).join(variants, KEY)
    letter = F.coalesce(F.get("alleles", "allele"), F.lit("N"))
    held = F.sort_array(F.collect_list(F.struct(*KEY, letter.alias("x"))))
    return t.groupBy("subject", "copy").agg(F.array_join(F.transform(held, lambda s: s["x"]), "").alias("haplotype"))


def invariant(genotypes: DataFrame) -> DataFrame:
    """(interval, pos) of variants without a heterozygote and with at most one allele."""
    called = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    het = F.bool_or(F.when(called, F.col("a1") != F.col("a2")))
    both = F.size(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array("a1", "a2"), lambda x: x.isNotNull())))))
    return genotypes.groupBy(*KEY).agg(F.coalesce(het, F.lit(False)).alias("het"), both.alias("n")).filter("NOT het AND n <= 1").select(*KEY)


def without(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """``genotypes`` less the listed variants."""
    return genotypes.join(variants.select(*KEY), KEY, "left_anti")


def within(genotypes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Calls inside (interval, start, end); a missing bound is open."""
    t = intervals.select("interval", F.col("start").alias("_s"), F.col("end").alias("_e"))
    ok = (F.col("_s").isNull() | F.col("_e").isNull()) | ((F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e")))
    return genotypes.join(t.withColumnRenamed("interval", "_i"), (F.col("interval") == F.col("_i")) & ok, "left_semi")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """(interval, start, end): overlapping ones of a name united; a whole-reference one (a missing bound) absorbs all."""
    whole = intervals.filter("start IS NULL OR end IS NULL").select("interval").distinct()
    rest = intervals.join(whole, "interval", "left_anti")
    w = Window.partitionBy("interval").orderBy("start", "end")
    apart = F.coalesce((F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    parts = rest.withColumn("_n", apart).withColumn("_k", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    united = parts.groupBy("interval", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")
    return united.unionByName(whole.select("interval", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))


def merge_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """(interval, pos, alleles): allele lists united, the first's order first; different reference alleles are an error."""
    both = a.select(*KEY, F.col("alleles").alias("_a")).join(b.select(*KEY, F.col("alleles").alias("_b")), KEY, "full")
    clash = F.get("_a", F.lit(0)) != F.get("_b", F.lit(0))
    united = F.array_union(F.coalesce("_a", "_b"), F.coalesce("_b", "_a"))
    return both.select(*KEY, F.when(clash, F.raise_error(F.lit("different reference alleles")).cast("array<string>")).otherwise(united).alias("alleles"))


def remapped(genotypes: DataFrame, own: DataFrame, united: DataFrame) -> DataFrame:
    """Allele ids of ``own`` variants as ids of the ``united`` ones."""
    t = genotypes.join(own.select(*KEY, F.col("alleles").alias("_o")), KEY).join(united.select(*KEY, F.col("alleles").alias("_u")), KEY)
    new = lambda c: (F.nullif(F.array_position("_u", F.get("_o", c)), F.lit(0)) - 1).cast("int")
    return t.select(*KEY, "subject", new("a1").alias("a1"), new("a2").alias("a2"), "phased")


def merge(a: DataFrame, va: DataFrame, b: DataFrame, vb: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genotypes, variants) of two sets of subjects.

    A subject without a call at a variant of the other set is homozygous for
    the reference where ``covered`` (subject, interval, start, end) holds the
    site, else missing.  Calls of the first set win where both have one.
    """
    v = merge_variants(va, vb)
    ra, rb = remapped(a, va, v), remapped(b, vb, v)
    calls = ra.unionByName(rb.join(ra.select(*KEY, "subject"), [*KEY, "subject"], "left_anti"))
    site = v.select(*KEY).join(covered.withColumnRenamed("interval", "_i"), (F.col("interval") == F.col("_i")) & (F.col("start").isNull() | ((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))))
    absent = site.select(*KEY, "subject").distinct().join(calls.select(*KEY, "subject"), [*KEY, "subject"], "left_anti")
    return calls.unionByName(absent.select(*KEY, "subject", F.lit(0).alias("a1"), F.lit(0).alias("a2"), F.lit(True).alias("phased"))), v


def reverse(variants: DataFrame) -> DataFrame:
    """Alleles complemented, for the other strand."""
    return variants.withColumn("alleles", F.transform("alleles", lambda a: F.reverse(F.translate(a, "ACGTacgt", "TGCAtgca"))))


def discordant(variants: DataFrame) -> DataFrame:
    """``variants`` with ``action``: of rows repeating a position the first is set missing (mark), later ones go (drop)."""
    w = Window.partitionBy("interval").orderBy("pos", "alleles")
    again, more = F.lag("pos").over(w) == F.col("pos"), F.lead("pos").over(w) == F.col("pos")
    return variants.withColumn("action", F.when(again, "drop").when(more, "mark").otherwise("keep"))


def spans(intervals: DataFrame) -> DataFrame:
    """(interval, start, end): one interval a name from the least start to the largest end."""
    return intervals.groupBy("interval").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group, size) of (group, subject)."""
    return groups.groupBy("group").agg(F.countDistinct("subject").alias("size"))


def selected(genotypes: DataFrame, groups: DataFrame, names: list[str], drop_invariant: bool = False) -> DataFrame:
    """Calls of the subjects of some groups."""
    t = genotypes.join(groups.filter(F.col("group").isin(names)).select("subject").distinct(), "subject", "left_semi")
    return without(t, invariant(t)) if drop_invariant else t


def variations(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """(interval, subject, copy, pos, seq): equal-length substitutions that each copy carries."""
    t = matrix(genotypes).filter("allele > 0").join(variants, KEY)
    alt = F.get("alleles", "allele")
    return t.filter(F.length(alt) == F.length(F.get("alleles", F.lit(0)))).select("interval", "subject", "copy", "pos", alt.alias("seq"))


def outside(genotypes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Calls inside none of (interval, start, end); a missing bound is open."""
    t = intervals.select(F.col("interval").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col("_s").isNull() | F.col("_e").isNull()) | ((F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e")))
    return genotypes.join(t, (F.col("interval") == F.col("_i")) & hit, "left_anti")


def split_intervals(intervals: DataFrame, removed: DataFrame) -> DataFrame:
    """(interval, start, end): what is left of each interval without the removed ones, which may split it.

    The cuts of an interval are gathered in one row: they are those of a list
    of removed intervals, not of the data.
    """
    own = intervals.select("interval", "start", "end")
    cuts = merged_intervals(removed.select("interval", "start", "end")).select(F.col("interval").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    whole = F.col("_s").isNull() | F.col("_e").isNull()
    meets = (F.col("interval") == F.col("_i")) & (whole | ((F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start"))))
    held = own.join(cuts, meets, "left").groupBy("interval", "start", "end").agg(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull() & ~whole, F.struct("_s", "_e")))).alias("x"), F.bool_or(F.coalesce(F.col("_i").isNotNull() & whole, F.lit(False))).alias("gone"))
    starts = F.concat(F.array("start"), F.transform("x", lambda c: c["_e"]))
    ends = F.concat(F.transform("x", lambda c: c["_s"]), F.array("end"))
    parts = held.filter("NOT gone").select("interval", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("p"))
    return parts.select("interval", F.col("p.s").alias("start"), F.col("p.e").alias("end")).filter("start < end")


def sorted_subjects(genotypes: DataFrame, order: DataFrame) -> DataFrame:
    """Calls of the subjects in (subject, place), with ``turn``: the subject's number by place within its variant."""
    w = Window.partitionBy(*KEY).orderBy("place", "subject")
    return genotypes.join(order, "subject").withColumn("turn", F.row_number().over(w).cast("long"))


def genotyping_intervals(variants: DataFrame) -> DataFrame:
    """From resequencing to genotyping: one interval a name, from its first variant to its last."""
    return variants.groupBy("interval").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def whole(start, end):
    """A missing bound on either end: the whole reference."""
    return start.isNull() | end.isNull()


def contains(a: tuple, b: tuple):
    """Whether interval ``a`` (start, end) of the same name holds ``b``; one with a missing bound holds all."""
    return whole(*a) | (~whole(*b) & (a[0] <= b[0]) & (b[1] <= a[1]))


def compare(a: tuple, b: tuple):
    """-1, 0 or 1 by start, then by end; a missing bound compares equal."""
    first = F.when(a[0] < b[0], -1).when(a[0] > b[0], 1).when(a[1] < b[1], -1).when(a[1] > b[1], 1).otherwise(0)
    return F.when(whole(*a) | whole(*b), 0).otherwise(first)
