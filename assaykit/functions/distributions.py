"""Tail probabilities for test statistics, for a handful of values on the driver."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(x: float, a: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(x / 2, dof / 2)


def ks_sf(d: float, n: float, m: float) -> float:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    t = d * math.sqrt(n * m / (n + m))
    if t < 1e-3:
        return 1.0
    if t < 1.0:  # the other series converges faster here
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * t * t)) for k in range(1, 20))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / t * s))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 100))))


#: Samples up to this size get the exact distribution of the Kolmogorov-Smirnov statistic.
EXACT_KS = 10_000


def ks_exact_sf(d: float, n: int, m: int) -> float:
    """Exact two-sided p-value of the two-sample Kolmogorov-Smirnov statistic of samples without ties.

    Every order of the pooled values is a path from (0, 0) to (n, m). The share of the paths to (i, j) that have touched
    the bound follows from those to its two neighbours; it is worked out for all points of one diagonal at a time. All
    terms are positive, so small values keep their digits.
    """
    bound = round(d * n * m)  # the statistic is a multiple of 1 / (n m)
    if bound <= 0:
        return 1.0
    touched = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        i = np.arange(max(0, s - m), min(n, s) + 1)
        j = s - i
        side = np.where(i > 0, touched[np.maximum(i - 1, 0)], 0.0)
        share = (side * i + np.where(j > 0, touched[i], 0.0) * j) / s
        now = np.where(np.abs(i * m - j * n) >= bound, 1.0, share)
        touched = np.zeros(n + 1)
        touched[i] = now
    return float(min(1.0, touched[n]))


def ks_p(d: float, n: int, m: int) -> float:
    """Exact for samples of up to EXACT_KS values, asymptotic beyond."""
    return ks_exact_sf(d, int(n), int(m)) if 0 < max(n, m) <= EXACT_KS else ks_sf(d, n, m)


def corr_p(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
