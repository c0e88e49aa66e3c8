"""Tests of normality and nearest-neighbour mutual information."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import num, q
from ..functions.distributions import chi2_sf, normal_cdf
from ..functions.exprs import kurtosis, skew
from ..plans.fuse import fused, row
from ..plans.ordering import prefix_sums

#: Rows that the Shapiro-Wilk test and the nearest-neighbour estimator take to the driver.
SAMPLE_ROWS = 5_000


def dagostino(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D'Agostino-Pearson K2 (n >= 20) from the moments: feature, n, k2, p_value."""
    got = fused(df, [row(feature=F.lit(c), n=F.count(num(c)), g1=F.skewness(num(c)), g2=F.kurtosis(num(c))) for c in cols]).collect()
    out = []
    for r in got:
        n = r["n"]
        if n < 20 or r["g1"] is None:
            continue
        y = r["g1"] * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
        b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + math.sqrt(2 * (b2 - 1))
        a = math.sqrt(2 / (w2 - 1))
        z1 = math.asinh(y / a) / math.sqrt(0.5 * math.log(w2))
        e = 3.0 * (n - 1) / (n + 1)
        v = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
        x = (r["g2"] + 3 - e) / math.sqrt(v)
        b = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        d = 6 + 8 / b * (2 / b + math.sqrt(1 + 4 / (b * b)))
        t = (1 - 2 / d) / (1 + x * math.sqrt(2 / (d - 4)))
        z2 = (1 - 2 / (9 * d) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2 / (9 * d))
        k2 = z1 * z1 + z2 * z2
        out.append((r["feature"], n, k2, chi2_sf(k2, 2)))
    return df.sparkSession.createDataFrame(out, "feature string, n long, k2 double, p_value double")


@F.pandas_udf(T.DoubleType())
def _log_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.log(max(normal_cdf(x), 1e-300)))


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """A2 against a normal of the sample's mean and deviation (n >= 8), from running counts of distinct values."""
    held = df.where(num(column).isNotNull())
    n, m, s = held.agg(F.count("*"), F.avg(num(column)), F.stddev_samp(num(column))).first()
    if n < 8 or not s:
        return df.sparkSession.createDataFrame([], "feature string, n long, a2 double")
    counts = held.groupBy(num(column).alias("x")).agg(F.count("*").alias("c"))
    run = prefix_sums(counts, "x", {"u": F.col("c")})
    z = (F.col("x") - F.lit(m)) / F.lit(s)
    before = F.col("u") - F.col("c")
    up = (F.col("u") * F.col("u") - before * before).cast("double")
    down = ((n - before) * (n - before) - (n - F.col("u")) * (n - F.col("u"))).cast("double")
    total = run.agg(F.sum(up * _log_cdf(z) + down * _log_cdf(-z)).alias("t"))
    return total.select(F.lit(column).alias("feature"), F.lit(n).cast("long").alias("n"), (-F.lit(float(n)) - F.col("t") / F.lit(float(n))).alias("a2"))


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (algorithm AS R94), for 12 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 12 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([_normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    c = m / math.sqrt(mm)
    an = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u))
    am = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u))
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * am**2)
    a = m / math.sqrt(phi)
    a[0], a[1], a[-2], a[-1] = -an, -am, am, an
    w = float((a @ x) ** 2 / np.square(x - x.mean()).sum())
    logn = math.log(n)
    mu = float(np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], logn))
    sigma = math.exp(float(np.polyval([0.0030302, -0.082676, -0.4803], logn)))
    return w, 1 - normal_cdf((math.log(max(1 - w, 1e-300)) - mu) / sigma)


def shapiro(df: DataFrame, column: str, key: str, limit: int = SAMPLE_ROWS) -> dict:
    """Shapiro-Wilk of a column, or of a hash-drawn sample of limit rows."""
    got = df.where(num(column).isNotNull()).orderBy(F.xxhash64(q(key)), q(key)).limit(limit).select(num(column).alias("x")).toPandas()["x"]
    w, p = shapiro_wilk(got)
    return {"feature": column, "n": len(got), "w": w, "p_value": p}


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        out = np.where(x < 6, out - 1 / x, out)
        x = np.where(x < 6, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def ksg_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information in nats of two continuous samples by the k nearest neighbours in the maximum norm."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    reach = np.partition(both, k - 1, axis=1)[:, k - 1 : k]
    nx, ny = (dx < reach).sum(1) - 1, (dy < reach).sum(1) - 1
    return max(0.0, float(_digamma(np.array([k]))[0] + _digamma(np.array([n]))[0] - (_digamma(nx + 1.0) + _digamma(ny + 1.0)).mean()))


def shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fused(df, [row(feature=F.lit(c), n=F.count(num(c)), skew=skew(num(c)), kurtosis=kurtosis(num(c))) for c in cols])
