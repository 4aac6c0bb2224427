"""Statistics that Spark SQL lacks: vectorised pandas UDFs over small numeric columns."""

from __future__ import annotations

from math import erf, erfc, exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_upper(z: float) -> float:
    """P(Z >= z) of a standard normal variable."""
    return erfc(z / sqrt(2)) / 2


def log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p <= 0:
        return float(k == 0)
    if p >= 1:
        return float(k == n)
    return exp(log_choose(n, k) + k * log(p) + (n - k) * log(1 - p))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def binomial_upper(x: int, n: int, p: float) -> float:
    """P(X >= x)."""
    if x <= 0:
        return 1.0
    return 0.0 if x > n else incomplete_beta(x, n - x + 1, p)


def binomial_lower(x: int, n: int, p: float) -> float:
    """P(X <= x)."""
    return 1.0 if x >= n else 1 - incomplete_beta(x + 1, n - x, p)


def binomial_test(x: int, n: int, p: float, tail: str = "upper") -> float:
    """p-value of x successes of n; no success at all gives 1 for every tail."""
    if x <= 0 or n <= 0:
        return 1.0
    p = min(max(p, 0.0), 1.0)
    if tail == "upper":
        return binomial_upper(x, n, p)
    if tail == "lower":
        return binomial_lower(x, n, p)
    if p in (0.0, 1.0):
        return float(x == n * p)
    # Two tails: outcomes at most as likely as x on the other side; their edge by bisection, as the mass falls off there.
    bound, mode = binomial_pmf(x, n, p) * (1 + 1e-7), int(n * p)
    if x == mode:
        return 1.0
    if x < mode:
        lo, hi = mode, n + 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if mid > n or binomial_pmf(mid, n, p) <= bound else (mid + 1, hi)
        return min(1.0, binomial_lower(x, n, p) + (binomial_upper(lo, n, p) if lo <= n else 0.0))
    lo, hi = 0, mode + 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if binomial_pmf(mid, n, p) <= bound else (lo, mid)
    return min(1.0, (binomial_lower(lo - 1, n, p) if lo else 0.0) + binomial_upper(x, n, p))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, P of a table at least as extreme upwards) of the 2 by 2 table a b / c d."""
    row, col, n = a + b, a + c, a + b + c + d
    odds = a * d / (b * c) if b * c else float("inf")
    top = min(row, col)
    total = sum(exp(log_choose(col, k) + log_choose(n - col, row - k) - log_choose(n, row)) for k in range(a, top + 1) if row - k <= n - col)
    return odds, min(1.0, total)


def wilcoxon_signed_rank(pairs: list[tuple[float, float]]) -> tuple[float, float]:
    """(V, two-sided p) of paired values: exact up to 50 pairs without ties or zeros, else normal with corrections."""
    d = [x - y for x, y in pairs if x != y]
    n = len(d)
    if not n:
        return 0.0, 1.0
    order = sorted(range(n), key=lambda i: abs(d[i]))
    ranks, i, ties = [0.0] * n, 0, 0
    while i < n:
        j = i
        while j + 1 < n and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        t = j - i + 1
        ties += t**3 - t
        i = j + 1
    v = sum(r for r, x in zip(ranks, d) if x > 0)
    if n < 50 and not ties and n == len(pairs):
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if 0 <= k - r < len(ways) else 0) for k in range(len(ways) + r)]
        low = sum(ways[: int(v) + 1]) / 2**n
        high = sum(ways[int(v) :]) / 2**n
        return v, min(1.0, 2 * min(low, high))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = v - mean
    z = (z - (0.5 if z > 0 else -0.5 if z < 0 else 0)) / sqrt(var)
    return v, min(1.0, 2 * normal_upper(abs(z)))


def aic(f: float, n: float, k: int) -> float:
    return n * log(f / n) + 2 * (k + 1)


def gauss_mass(p: float, x: float, w: float) -> float:
    """Half the difference of two error functions: mass between p - x and p + x at scale w."""
    return (erf((p + x) / w) - erf((p - x) / w)) / 2


@F.pandas_udf(DoubleType())
def normal_upper_udf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_upper(v))


@F.pandas_udf(DoubleType())
def binomial_test_udf(x: pd.Series, n: pd.Series, p: pd.Series, tail: pd.Series) -> pd.Series:
    memo: dict = {}

    def one(key):
        if any(pd.isna(v) for v in key):
            return None
        if key not in memo:
            memo[key] = binomial_test(int(key[0]), int(key[1]), float(key[2]), key[3])
        return memo[key]

    return pd.Series([one(k) for k in zip(x, n, p, tail)], dtype="float64")


@F.pandas_udf(DoubleType())
def gauss_mass_udf(p: pd.Series, x: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in k) else gauss_mass(*k) for k in zip(p, x, w)], dtype="float64")


@F.pandas_udf(DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(int(w), int(x), int(y), int(z))[1] for w, x, y, z in zip(a, b, c, d)], dtype="float64")
