"""The k-mer dictionary that distributions live in."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement


@dataclass(frozen=True)
class KmerSpace:
    """Words of ``l`` bases of which ``gaps`` are wild cards; ``ds`` folds a word with its reverse complement.

    Words are strings with N at gaps.  Counting needs l >= 2; longer words than
    the dictionary's need (up to 31) are fine, no dictionary is ever built for
    counting.
    """

    l: int  # noqa: E741
    gaps: int = 0
    ds: bool = False

    def __post_init__(self):
        if self.l < 2 or not 0 <= self.gaps < self.l:
            raise ValueError(f"no such k-mer space: {self}")

    @property
    def masks(self) -> list[tuple[int, ...]]:
        """Kept positions (zero-based from the left) by mask number; numbers follow positions counted from the right."""
        return [tuple(sorted(self.l - 1 - p for p in kept)) for kept in combinations(range(self.l), self.l - self.gaps)]

    @property
    def size(self) -> int:
        """Words in the dictionary."""
        k = self.l - self.gaps
        if not self.ds:
            return comb(self.l, k) * 4**k
        # A word is its own reverse complement if its mask is symmetric and its letters pair up.
        own = sum(4 ** (k // 2) for m in self.masks if k % 2 == 0 and m == tuple(sorted(self.l - 1 - p for p in m)))
        return (comb(self.l, k) * 4**k + own) // 2

    def check(self, other: "KmerSpace") -> None:
        if self != other:
            raise ValueError(f"different k-mer spaces: {self} and {other}")


def gapped(kmer, space: KmerSpace):
    """Array of the gapped words of an l-mer, canonical if the space folds strands."""

    def word(k, mask):
        return F.concat(*[k.substr(F.lit(p + 1), F.lit(1)) if p in mask else F.lit("N") for p in range(space.l)])

    def key(mask_no, mask, k):
        letters = F.concat(*[k.substr(F.lit(p + 1), F.lit(1)) for p in mask])
        return F.struct(letters.alias("letters"), F.lit(mask_no).alias("mask"), word(k, mask).alias("word"))

    masks = space.masks
    if not space.ds:
        return F.array(*[word(kmer, m) for m in masks])
    rc = reverse_complement(kmer)
    number = {m: i for i, m in enumerate(masks)}
    both = []
    for i, m in enumerate(masks):
        back = tuple(sorted(space.l - 1 - p for p in m))
        # Words compare by letters, then by mask number.
        both.append(F.least(key(i, m, kmer), key(number[back], back, rc))["word"])
    return F.array(*both)


def dictionary(spark: SparkSession, space: KmerSpace) -> DataFrame:
    """(kmer, rc): every word, with its reverse complement if the space folds strands."""
    n = spark.range(4**space.l).select(F.array_join(F.transform(F.sequence(F.lit(space.l - 1), F.lit(0), F.lit(-1)), lambda d: F.substring(F.lit("ACGT"), (F.floor(F.col("id") / F.pow(F.lit(4.0), d)) % 4 + 1).cast("int"), F.lit(1))), "").alias("lmer"))
    if space.gaps:
        n = n.select(F.explode(gapped(F.col("lmer"), space)).alias("kmer")).distinct()
    elif space.ds:
        n = n.select(F.least("lmer", reverse_complement("lmer")).alias("kmer")).distinct()
    else:
        n = n.withColumnRenamed("lmer", "kmer")
    rc = F.reverse(F.translate("kmer", "ACGT", "TGCA")) if space.ds else F.lit(None).cast("string")
    return n.select("kmer", rc.alias("rc"))
