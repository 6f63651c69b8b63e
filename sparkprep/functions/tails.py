"""Tails and quantiles of the normal, t, F and chi-squared distributions, in plain Python.

All come from the regularised incomplete gamma and beta functions, by their series and continued fractions. Upper tails are
computed as such, so that p-values of 1e-300 don't turn into 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

TINY, EPS, TURNS = 1e-300, 1e-16, 10_000


def _fraction(terms: Callable[[int], tuple[float, float]], start: float) -> float:
    """start + a1 / (b1 + a2 / (b2 + ...)) from terms(i) = (ai, bi), evaluated from the front."""
    f = start or TINY
    c, d = f, 0.0
    for i in range(1, TURNS):
        a, b = terms(i)
        d = 1 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        f *= c * d
        if abs(c * d - 1) < EPS:
            break
    return f


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * EPS:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    return scale / _fraction(lambda i: (i * (a - i), x + 2 * i + 1 - a), x + 1 - a)


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x > 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    def terms(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return front / _fraction(terms, 1.0)


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def f_sf(x: float, dfn: float, dfd: float) -> float:
    if math.isinf(x):
        return 0.0
    return 1.0 if x <= 0 else beta_part(dfd / 2, dfn / 2, dfd / (dfd + dfn * x))


def t_sf2(t: float, df: float) -> float:
    """Both tails."""
    return 0.0 if math.isinf(t) else beta_part(df / 2, 0.5, df / (df + t * t))


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def normal_cdf(z: float) -> float:
    return normal_sf(-z)


def _inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
        if high - low <= 1e-15 * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def normal_ppf(p: float) -> float:
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    return -normal_ppf(1 - p) if p < 0.5 and p > 1e-9 else _inverse(normal_cdf, p, -40, 40)


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 2.0
    while 1 - t_sf2(high, df) / 2 < p and high < 1e12:
        high *= 2
    return _inverse(lambda t: 1 - t_sf2(t, df) / 2, p, 0.0, high)
