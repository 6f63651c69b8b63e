"""Tests, effect sizes, corrections and intervals on the driver's numbers: samples, groups or tables that Spark has summed up."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from ..errors import InsufficientDataError
from . import tails

NORMALITY = ["shapiro", "normaltest", "anderson"]
VARIANCE = ["levene", "bartlett"]
CORRECTIONS = ["bonferroni", "holm", "fdr_bh", "fdr_by"]
SHAPIRO_ROWS = 5000
LEAST_EXPECTED = 5
#: From which V on an association is small, medium and large, by the lesser dimension less one (3 and more alike).
V_SIZES = {1: [0.10, 0.30, 0.50], 2: [0.07, 0.21, 0.35], 3: [0.06, 0.17, 0.29]}


def _numbers(data) -> np.ndarray:
    x = np.asarray(data, float).ravel()
    return x[~np.isnan(x)]


# -- normality


def _poly(x: float, *c: float) -> float:
    return sum(k * x**i for i, k in enumerate(c))


def shapiro(data) -> tuple[float, float]:
    """W and p by Royston's approximation (AS R94), for 3 to 5000 values."""
    x = np.sort(_numbers(data))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([tails.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1 / math.sqrt(n)
    # Fixed values of the approximation.
    last = m[-1] / math.sqrt(mm) + _poly(u, 0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    elif n <= 5:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    else:
        next_ = m[-2] / math.sqrt(mm) + _poly(u, 0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[0], a[1], a[-2], a[-1] = -last, -next_, next_, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0, 1.0
    y = math.log(1 - w)
    if n <= 11:
        g = _poly(n, -2.273, 0.459)
        if y >= g:
            return w, 0.0
        y = -math.log(g - y)
        mu = _poly(n, 0.5440, -0.39978, 0.025054, -0.0006714)
        sd = math.exp(_poly(n, 1.3822, -0.77857, 0.062767, -0.0020322))
    else:
        k = math.log(n)
        mu = _poly(k, -1.5861, -0.31082, -0.083751, 0.0038915)
        sd = math.exp(_poly(k, -0.4803, -0.082676, 0.0030302))
    return w, tails.normal_sf((y - mu) / sd)


def normaltest_from(n: int, g1: float, g2: float) -> tuple[float, float]:
    """D'Agostino and Pearson's K2 and p from population skewness and excess kurtosis."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    c = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / c * (2 / c + math.sqrt(1 + 4 / c**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / d) ** (1 / 3), d)) / math.sqrt(2 / (9 * a)) if d else math.inf
    k = z1 * z1 + z2 * z2
    return k, tails.chi2_sf(k, 2)


def log_tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithms of the normal distribution below and above each z."""
    return np.array([math.log(max(tails.normal_cdf(v), 1e-300)) for v in z]), np.array([math.log(max(tails.normal_sf(v), 1e-300)) for v in z])


def anderson_from(n: int, total: float) -> tuple[float, float, float]:
    """A2, p (interpolated between 0.15 and 0.01) and the critical value at 5%, from the sum of (2i - 1) ln F + (2(n - i) + 1) ln(1 - F)."""
    # Critical points for unknown mean and variance, and their levels.
    points, levels = np.array([0.576, 0.656, 0.787, 0.918, 1.092]), np.array([0.15, 0.10, 0.05, 0.025, 0.01])
    points = points / (1 + 4 / n - 25 / n / n)
    a2 = float(-n - total / n)
    return a2, float(np.interp(a2, points, levels)), float(points[2])


def anderson(data) -> tuple[float, float, float]:
    x = np.sort(_numbers(data))
    n = len(x)
    low, high = log_tails((x - x.mean()) / x.std(ddof=1))
    i = np.arange(1, n + 1)
    return anderson_from(n, float(((2 * i - 1) * low + (2 * (n - i) + 1) * high).sum()))


def check_normality(data, method: str = "shapiro", alpha: float = 0.05) -> dict:
    if method not in NORMALITY:
        raise ValueError(f"method is one of {NORMALITY}")
    x = _numbers(data)
    if len(x) < 3 or method == "normaltest" and len(x) < 8:
        return {"is_normal": False, "statistic": math.nan, "p_value": math.nan, "method": method, "n": len(x)}
    extra = {}
    if method == "shapiro":
        some = x if len(x) <= SHAPIRO_ROWS else np.random.default_rng(42).choice(x, SHAPIRO_ROWS, replace=False)
        stat, p = shapiro(some)
    elif method == "normaltest":
        d = x - x.mean()
        v = (d**2).mean()
        stat, p = normaltest_from(len(x), (d**3).mean() / v**1.5, (d**4).mean() / v**2 - 3) if v else (math.nan, 1.0)
    else:
        stat, p, extra["critical_value"] = anderson(x) if x.std() else (math.nan, 1.0, math.nan)
    return {"is_normal": bool(p > alpha), "statistic": stat, "p_value": p, "method": method, "n": len(x)} | extra


# -- groups


def anova(groups: Sequence[tuple[int, float, float]]) -> tuple[float, float, float]:
    """F, p and eta squared from (n, mean, population variance) of each group."""
    k, n = len(groups), sum(g[0] for g in groups)
    mean = sum(g[0] * g[1] for g in groups) / n
    between = sum(g[0] * (g[1] - mean) ** 2 for g in groups)
    return anova_from(k, n, between, sum(g[0] * g[2] for g in groups))


def anova_from(k: int, n: int, between: float, within: float) -> tuple[float, float, float]:
    """From the numbers of groups and rows and the sums of squares."""
    eta = between / (between + within) if between + within else math.nan
    if n <= k or k < 2:
        return math.nan, math.nan, eta
    f = (between / (k - 1)) / (within / (n - k)) if within else (math.inf if between else math.nan)
    return f, tails.f_sf(f, k - 1, n - k) if not math.isnan(f) else math.nan, eta


def kruskal(groups: Sequence[tuple[int, float]], tie_sum: float) -> tuple[float, float]:
    """H and p from (n, sum of ranks) of each group, and the sum of t^3 - t over ties."""
    n = sum(g[0] for g in groups)
    h = 12 / (n * (n + 1)) * sum(r * r / m for m, r in groups) - 3 * (n + 1)
    spread = 1 - tie_sum / (n**3 - n)
    h = h / spread if spread else math.nan
    return h, tails.chi2_sf(h, len(groups) - 1) if not math.isnan(h) else math.nan


def bartlett(groups: Sequence[tuple[int, float]]) -> tuple[float, float]:
    """Statistic and p from (n, sample variance) of each group."""
    k, n = len(groups), sum(g[0] for g in groups)
    pooled = sum((m - 1) * v for m, v in groups) / (n - k)
    top = (n - k) * math.log(pooled) - sum((m - 1) * math.log(v) for m, v in groups)
    t = top / (1 + (sum(1 / (m - 1) for m, _ in groups) - 1 / (n - k)) / (3 * (k - 1)))
    return t, tails.chi2_sf(t, k - 1)


def check_homogeneity_of_variance(groups: Sequence, method: str = "levene", alpha: float = 0.05) -> dict:
    if method not in VARIANCE:
        raise ValueError(f"method is one of {VARIANCE}")
    xs = [_numbers(g) for g in groups]
    if len(xs) < 2:
        raise ValueError("two groups are needed")
    if min(map(len, xs)) < 2:
        return {"equal_variances": False, "statistic": math.nan, "p_value": math.nan, "method": method}
    if method == "levene":
        away = [np.abs(x - np.median(x)) for x in xs]
        stat, p, _ = anova([(len(a), a.mean(), a.var()) for a in away])
    else:
        v = [(len(x), x.var(ddof=1)) for x in xs]
        stat, p = bartlett(v) if all(s for _, s in v) else (math.nan, math.nan)
    return {"equal_variances": bool(p > alpha), "statistic": stat, "p_value": p, "method": method}


def validate_sample_size(groups: Sequence, test_type: str = "ttest", min_size: int = 30) -> dict:
    sizes = [len(_numbers(g)) for g in groups]
    if test_type in ("ttest", "anova"):
        enough = bool(sizes) and min(sizes) >= min_size
    elif test_type == "chi2":
        enough = sum(sizes) >= min_size * len(sizes)
    else:
        enough = bool(sizes) and sizes[0] >= min_size
    return {"sufficient": enough, "sizes": sizes, "min_size": min_size, "test_type": test_type}


# -- tables


def _table(table) -> np.ndarray:
    t = np.asarray(table, float)
    if t.ndim != 2:
        raise ValueError("a table has two dimensions")
    return t


def expected(table) -> np.ndarray:
    t = _table(table)
    return np.outer(t.sum(1), t.sum(0)) / t.sum()


def chi_square(table, correction: bool = True) -> tuple[float, float, int]:
    """Statistic, p and degrees of freedom; Yates' correction on 2 x 2 tables only."""
    t = _table(table)
    e = expected(t)
    df = (t.shape[0] - 1) * (t.shape[1] - 1)
    if df == 0:
        return 0.0, 1.0, 0
    away = np.abs(t - e)
    if correction and df == 1:
        away = away - np.minimum(0.5, away)
    stat = float((away**2 / e).sum())
    return stat, tails.chi2_sf(stat, df), df


def check_chi2_expected_frequencies(table, min_expected: float = LEAST_EXPECTED) -> dict:
    e = expected(table)
    return expected_frequencies_from(e.shape, float(e.min()), int((e < min_expected).sum()), min_expected)


def expected_frequencies_from(shape: tuple[int, int], least: float, below: int, min_expected: float = LEAST_EXPECTED) -> dict:
    """From the table's shape, its least expected frequency, and how many are too small."""
    percent = 100.0 * below / (shape[0] * shape[1])
    if tuple(shape) == (2, 2) and least < min_expected:
        advice = "use Fisher's exact test"
    else:
        advice = "chi-square is valid" if percent < 20 else "merge rare categories"
    return {"valid": percent < 20, "min_expected": least, "percent_below": percent, "recommendation": advice}


def cramers_v(table, correction: bool = True, bias_correction: bool = False) -> dict:
    t = _table(table)
    stat, p, _ = chi_square(t, correction) if t.sum() else (math.nan, math.nan, 0)
    return cramers_v_from(stat, t.sum(), t.shape, bias_correction) | {"pvalue": p}


def cramers_v_from(chi2: float, n: float, shape: tuple[int, int], bias_correction: bool = False) -> dict:
    """From chi-square, the number of rows and the table's shape."""
    (r, c), least = shape, min(shape) - 1
    plain = v = math.sqrt(chi2 / (n * least)) if n and least else math.nan
    if bias_correction and n > 1 and not math.isnan(v):
        phi2 = max(0.0, chi2 / n - (r - 1) * (c - 1) / (n - 1))
        left = min(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1
        v = math.sqrt(phi2 / left) if left > 0 else math.nan
    size = "undefined" if math.isnan(v) else _size(v, V_SIZES[min(least, 3)])
    of = {1: "2x2", 2: "3xK"}.get(least, "large")
    words = "Cannot interpret (invalid table)" if math.isnan(v) else f"{size.capitalize()} effect size for {of} table (V = {v:.3f})"
    out = {"cramers_v": float(v), "interpretation": size, "description": words, "chi2_statistic": chi2, "bias_correction_applied": bias_correction}
    return out | ({"cramers_v_uncorrected": plain} if bias_correction else {})


def _size(v: float, cuts: list[float]) -> str:
    return ["negligible", "small", "medium", "large"][sum(abs(v) >= c for c in cuts)]


def cohens_d(g1, g2, pooled: bool = True) -> dict:
    a, b = _numbers(g1), _numbers(g2)
    return cohens_d_from((len(a), a.mean(), a.var(ddof=1)), (len(b), b.mean(), b.var(ddof=1)), pooled)


def cohens_d_from(a: tuple[int, float, float], b: tuple[int, float, float], pooled: bool = True) -> dict:
    """From (n, mean, sample variance) of two groups."""
    var = ((a[0] - 1) * a[2] + (b[0] - 1) * b[2]) / (a[0] + b[0] - 2) if pooled else a[2]
    if not var:
        return {"cohens_d": math.nan, "interpretation": "undefined"}
    d = (a[1] - b[1]) / math.sqrt(var)
    return {"cohens_d": float(d), "interpretation": _size(d, [0.2, 0.5, 0.8])}


def eta_squared(groups: Sequence | None = None, f_statistic: float | None = None, df_between: int | None = None, df_within: int | None = None) -> dict:
    if groups is not None:
        eta = anova([(len(x), x.mean(), x.var()) for x in map(_numbers, groups)])[2]
    elif f_statistic is not None and df_between and df_within:
        eta = f_statistic * df_between / (f_statistic * df_between + df_within)
    else:
        raise ValueError("groups, or an F with its degrees of freedom, are needed")
    return {"eta_squared": eta, "interpretation": "undefined" if math.isnan(eta) else _size(eta, [0.01, 0.06, 0.14])}


def pearson_r_to_d(r: float) -> float:
    return math.copysign(math.inf, r) if abs(r) >= 1 else 2 * r / math.sqrt(1 - r * r)


# -- many tests, intervals


def apply_multiple_testing_correction(p_values, method: str = "fdr_bh", alpha: float = 0.05) -> dict:
    p = np.asarray(p_values, float)
    if not len(p):
        raise InsufficientDataError("no p-values", 1, 0)
    if ((p < 0) | (p > 1)).any():
        raise ValueError("p-values are between 0 and 1")
    if method not in CORRECTIONS:
        raise ValueError(f"method is one of {CORRECTIONS}")
    m, order = len(p), np.argsort(p, kind="stable")
    s = p[order]
    if method == "bonferroni":
        q = s * m
    elif method == "holm":
        q = np.maximum.accumulate(s * (m - np.arange(m)))
    else:
        scale = m / np.arange(1, m + 1) * (1 if method == "fdr_bh" else (1 / np.arange(1, m + 1)).sum())
        q = np.minimum.accumulate((s * scale)[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(q, 1)
    return {"corrected_pvalues": out, "reject": out <= alpha, "method": method, "n_significant": int((out <= alpha).sum())}


def mean_ci_from(n: int, mean: float, sd: float, confidence: float = 0.95) -> tuple[float, float]:
    if n < 2:
        return math.nan, math.nan
    half = tails.t_ppf((1 + confidence) / 2, n - 1) * sd / math.sqrt(n)
    return mean - half, mean + half


def calculate_mean_ci(data, confidence: float = 0.95) -> dict:
    x = _numbers(data)
    mean = float(x.mean()) if len(x) else math.nan
    low, high = mean_ci_from(len(x), mean, x.std(ddof=1) if len(x) > 1 else 0.0, confidence)
    return {"mean": mean, "ci_lower": low, "ci_upper": high, "confidence": confidence, "n": len(x)}


def calculate_correlation_ci(r: float, n: int, confidence: float = 0.95) -> dict:
    if abs(r) >= 1 or n < 4:
        return {"correlation": r, "ci_lower": math.nan, "ci_upper": math.nan}
    z, half = math.atanh(r), tails.normal_ppf((1 + confidence) / 2) / math.sqrt(n - 3)
    return {"correlation": r, "ci_lower": math.tanh(z - half), "ci_upper": math.tanh(z + half)}


def bootstrap_ci(data, statistic_func: Callable = np.mean, n_bootstrap: int = 1000, confidence: float = 0.95, random_state: int | None = 42) -> dict:
    x = _numbers(data)
    if len(x) < 2:
        return {"statistic": float(statistic_func(x)) if len(x) else math.nan, "ci_lower": math.nan, "ci_upper": math.nan, "bootstrap_distribution": np.array([])}
    rng = np.random.default_rng(random_state)
    drawn = np.array([statistic_func(rng.choice(x, len(x), replace=True)) for _ in range(n_bootstrap)])
    low, high = np.percentile(drawn, [50 * (1 - confidence), 50 * (1 + confidence)])
    return {"statistic": float(statistic_func(x)), "ci_lower": float(low), "ci_upper": float(high), "bootstrap_distribution": drawn}


def correlation_p(r: float, n: int) -> float:
    if n < 3:
        return math.nan
    return 0.0 if abs(r) >= 1 else tails.t_sf2(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)
