"""Nullable vectors: element arithmetic, subsets, edits and aggregates, as array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequence import col


def zip_with(a, b, f) -> Column:
    """Element by element; a null element gives null."""
    return F.zip_with(col(a), col(b), f)


def select(a, index) -> Column:
    """Elements at zero-based positions; positions outside give null."""
    return F.transform(col(index), lambda i: F.get(col(a), i))


def which(flags) -> Column:
    """Zero-based positions of true elements."""
    f = col(flags)
    return F.filter(F.transform(f, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def match(a, table) -> Column:
    """Zero-based position in ``table`` of each element, null if absent."""
    return F.transform(col(a), lambda x: F.nullif(F.array_position(col(table), x), F.lit(0)) - 1)


def find(a, value) -> Column:
    """Zero-based position of the first element equal to ``value``, null if absent."""
    return F.nullif(F.array_position(col(a), value), F.lit(0)) - 1


def insert(a, at: int, b) -> Column:
    return F.concat(F.slice(col(a), 1, F.lit(at)), col(b), F.slice(col(a), at + 1, F.greatest(F.size(col(a)) - at, F.lit(0))))


def remove(a, at: int, n: int) -> Column:
    return F.concat(F.slice(col(a), 1, F.lit(at)), F.slice(col(a), at + n + 1, F.greatest(F.size(col(a)) - at - n, F.lit(0))))


def replace(a, at: int, b) -> Column:
    return F.transform(col(a), lambda x, i: F.when((i >= at) & (i < at + F.size(col(b))), F.get(col(b), i - at)).otherwise(x))


def na_count(a) -> Column:
    return F.size(F.filter(col(a), lambda x: x.isNull()))


def _held(a) -> Column:
    return F.filter(col(a), lambda x: x.isNotNull())


def aggregate(a, kind: str, skipnan: bool = True) -> Column:
    """min, max, sum, squares, mean or std (n - 1) of a vector; with ``skipnan`` false any null gives null."""
    v = _held(a)
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    mean = F.when(n > 0, total / n)
    spread = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    out = {
        "min": F.array_min(v),
        "max": F.array_max(v),
        "sum": F.when(n > 0, total),
        "squares": F.when(n > 0, squares),
        "mean": mean,
        "std": F.when(n > 1, F.sqrt(spread / (n - 1))),
    }[kind]
    return out if skipnan else F.when(na_count(a) == 0, out)


def intersection(s1, e1, s2, e2) -> tuple[Column, Column]:
    """Common part of two half-open intervals, else an empty interval at the later start."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return s, F.greatest(s, e)


def left_difference(s1, e1, s2, e2) -> tuple[Column, Column]:
    """Part of the second interval before the first, else an empty interval at the first's start."""
    return F.least(s1, s2), F.when(s2 < s1, F.least(e2, s1)).otherwise(s1)


def right_difference(s1, e1, s2, e2) -> tuple[Column, Column]:
    """Part of the second interval after the first, else an empty interval at the first's end."""
    return F.when(e2 > e1, F.greatest(e1, s2)).otherwise(e1), F.greatest(e1, e2)


def union(s1, e1, s2, e2) -> tuple[Column, Column]:
    """Hull of two intervals that overlap or touch, else (0, 0)."""
    meet = (F.greatest(s1, s2) < F.least(e1, e2)) | (s1 == e2) | (e1 == s2)
    s, e = F.least(s1, s2), F.greatest(e1, e2)
    ok = meet & (s < e)
    return F.when(ok, s).otherwise(0), F.when(ok, e).otherwise(0)


class Condition:
    """A disjunction of bit tests: each term says which bits are set and which are not."""

    def __init__(self, terms: list[tuple[int, int]]):
        self.terms = [(s, u) for s, u in terms if not s & u]

    @classmethod
    def of(cls, set_bits: int = 0, unset_bits: int = 0) -> "Condition":
        return cls([(set_bits, unset_bits)])

    def __or__(self, other: "Condition") -> "Condition":
        return Condition(self.terms + other.terms)

    def __and__(self, other: "Condition") -> "Condition":
        return Condition([(a | c, b | d) for a, b in self.terms for c, d in other.terms])

    def __invert__(self) -> "Condition":
        out = Condition.of()
        for s, u in self.terms:
            singles = [(0, 1 << i) for i in range(64) if s >> i & 1] + [(1 << i, 0) for i in range(64) if u >> i & 1]
            out = out & Condition(singles)
        return out

    def test(self, flags) -> Column:
        f = col(flags)
        out = F.lit(False)
        for s, u in self.terms:
            out = out | ((f.bitwiseAND(F.lit(s)) == s) & (f.bitwiseAND(F.lit(u)) == 0))
        return out


def order(array) -> Column:
    """Places (from 0) of an array's elements in ascending order; nulls first, ties by place."""
    pairs = F.transform(col(array), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def is_sorted(array) -> Column:
    return F.array_sort(col(array)) == col(array)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, also of negative ``n``; 0 for negative ``k``."""
    product = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(1.0), lambda p, i: p * (n - i + 1) / i)
    return F.when(k < 0, 0.0).when(k == 0, 1.0).otherwise(product)


def aic(f: Column, n: Column, k: int) -> Column:
    """n ln(f / n) + 2 (k + 1): ``f`` a residual sum of squares over ``n`` points, ``k`` parameters."""
    return n * F.log(f / n) + 2 * (k + 1)
