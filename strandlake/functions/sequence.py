"""Scalar functions of nucleotide sequences, as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the standard genetic code, by codon in the order T, C, A, G.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Fixed value: the vertebrate mitochondrial code in the same order.
MITOCHONDRIAL_CODE = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"
CODONS = tuple("".join(c) for c in product("TCAG", repeat=3))

LETTERS, DENSE = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_bases(seq) -> Column:
    """acgt to ACGT; unlike upper(), it never changes the number of characters."""
    return F.translate(col(seq), "acgt", "ACGT")


def base_codes(seq) -> Column:
    """A, C, G, T in either case become 0 to 3, every other character 4."""
    return F.translate(F.regexp_replace(col(seq), "[^ACGTacgt]", "4"), "ACGTacgt", "01230123")


def to_dna(seq) -> Column:
    """RNA to DNA."""
    return F.translate(col(seq), "Uu", "Tt")


def text_to_dna(text) -> Column:
    """Letters of prose as bases, a fixed letter-to-base map; other characters stay and so split runs."""
    return F.translate(F.lower(F.coalesce(col(text), F.lit(""))), LETTERS, DENSE)


def runs(seq, strict: bool = False) -> Column:
    """Maximal runs of ACGT (either case), upper-cased; ``strict`` raises on any other character."""
    s = col(seq)
    if strict:
        s = F.when(s.rlike("[^ACGTacgt]"), F.raise_error(F.lit("invalid character in a sequence"))).otherwise(s)
    return F.regexp_extract_all(upper_bases(s), F.lit("[ACGT]+"), F.lit(0))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def canonical(kmer) -> Column:
    """The smaller of a k-mer and its reverse complement; letters sort as base codes do."""
    return F.least(col(kmer), reverse_complement(kmer))


def window(seq, first: int, last: int) -> Column:
    """Characters ``first`` to ``last``, one-based and inclusive."""
    return F.substring(col(seq), first, last - first + 1)


def gc_count(seq) -> Column:
    return F.length(F.regexp_replace(col(seq), "[^GCgc]", ""))


def repeat_count(seq) -> Column:
    """Lower-case (repeat-masked) bases."""
    return F.length(F.regexp_replace(col(seq), "[^acgtn]", ""))


def gc_repeat_key(seq, gc_bins: int = 20, repeat_bins: int = 20) -> Column:
    """Bin of GC share and masked share, as one number."""
    n = F.length(col(seq))
    gc = F.when(n > 0, F.floor(gc_count(seq) * gc_bins / n)).otherwise(0)
    masked = F.when(n > 0, F.floor(repeat_count(seq) * repeat_bins / n)).otherwise(0)
    return (gc * (repeat_bins + 1) + masked).cast("long")


def translate_codons(seq, frame: int = 0, code: str = STANDARD_CODE) -> Column:
    """Amino acids of whole codons from ``frame`` on; codons with other letters give X."""
    s = upper_bases(F.substring(col(seq), frame + 1, 2**30))
    table = F.create_map(*[F.lit(x) for pair in zip(CODONS, code) for x in pair])
    n = F.floor(F.length(s) / 3).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.element_at(table, F.substring(s, i * 3 - 2, F.lit(3))), F.lit("X")))
    return F.when(n > 0, F.array_join(each, "")).when(col(seq).isNotNull(), F.lit(""))


def split_nonempty(text, separator: str) -> Column:
    return F.filter(F.split(col(text), separator), lambda x: x != "")
