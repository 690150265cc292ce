"""Quantiles and tail areas of the normal and t distributions, with the standard library only."""

from __future__ import annotations

import math
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def beta_area(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isnan(t) or math.isnan(df):
        return math.nan
    return beta_area(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
        if high - low <= 1e-15 * high:
            break
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def u_two_sided(u: float, n1: int, n2: int) -> float:
    """Two-sided tail of Mann-Whitney's U without ties, from the counts of all orders."""
    # ways[k]: orders of the units taken so far with a U of k; the counts are the coefficients of a Gaussian binomial.
    ways = [1] + [0] * (n1 * n2)
    for k in range(1, n1 + 1):
        for j in range(n1 * n2, n2 + k - 1, -1):
            ways[j] -= ways[j - n2 - k]
        for j in range(k, n1 * n2 + 1):
            ways[j] += ways[j - k]
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * sum(ways[: low + 1]) / sum(ways))
