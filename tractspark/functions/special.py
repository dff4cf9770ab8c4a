"""Tails of distributions for the few rows that hold test results."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    high = 1.0
    while t_sf(high, df) > 1 - p and high < 1e300:
        high *= 2
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


#: Pairs of values up to which a forced exact test is exact.
EXACT_PAIRS = 10_000


def rank_sum_p(u: float, n1: int, n2: int, ties: float, exact: bool = False) -> float:
    """Two-sided p of Mann-Whitney: exact if a sample has 8 values or fewer and none tie, else normal with both corrections. exact: the exact
    distribution (which knows no ties) up to EXACT_PAIRS pairs."""
    if n1 * n2 <= EXACT_PAIRS if exact else min(n1, n2) <= 8 and not ties:
        counts = [1] + [0] * (n1 * n2)
        for i in range(1, n1 + 1):  # Gaussian binomial coefficient by its factors
            for k in range(n1 * n2, n2 + i - 1, -1):
                counts[k] -= counts[k - n2 - i]
            for k in range(i, n1 * n2 + 1):
                counts[k] += counts[k - i]
        top = max(u, n1 * n2 - u)
        return min(1.0, 2 * sum(counts[math.ceil(top - 1e-9) :]) / math.comb(n1 + n2, n1))
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, 2 * normal_sf((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(var)))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a Pearson or Spearman coefficient over n pairs, by Student's t."""
    if n < 3:
        return float("nan")
    return 0.0 if abs(r) >= 1 else 2 * t_sf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kendall_p(score: float, n: int, ties: tuple[tuple[float, float, float], tuple[float, float, float]]) -> float:
    """Two-sided p of Kendall's tau. score: concordant less discordant pairs; ties: for each side the sums over tied groups of t (t - 1) / 2,
    t (t - 1) (t - 2) and t (t - 1) (2 t + 5). Without ties and up to 33 rows by the number of permutations, else normal."""
    (x, x0, x1), (y, y0, y1) = ties
    pairs = n * (n - 1) // 2
    if n < 2 or pairs in (x, y):
        return float("nan")
    if not x and not y and n <= 33:
        counts = [1]
        for i in range(2, n + 1):  # permutations of i by their inversions
            counts = [sum(counts[max(0, k - i + 1) : k + 1]) for k in range(len(counts) + i - 1)]
        few = int(round((pairs - abs(score)) / 2))
        return min(1.0, 2 * sum(counts[: few + 1]) / math.factorial(n))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * x * y / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(score) / math.sqrt(2 * var))
