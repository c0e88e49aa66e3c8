"""Aggregate and scalar expressions. All are null-safe and never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null where either is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def skew(c: Column) -> Column:
    """Bias-adjusted skewness (G1); 0 for a constant column of 3 values or more."""
    n = F.count(c).cast("double")
    adjusted = F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    return F.when((n >= 3) & (F.var_pop(c) == 0), 0.0).otherwise(adjusted)


def kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis (G2); 0 for a constant column of 4 values or more."""
    n = F.count(c).cast("double")
    adjusted = F.when(n >= 4, div(((n + 1) * F.kurtosis(c) + 6) * (n - 1), (n - 2) * (n - 3)))
    return F.when((n >= 4) & (F.var_pop(c) == 0), 0.0).otherwise(adjusted)


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(div(part, whole) * 100, F.lit(0.0))


def ladder(value: Column, steps: list[tuple[float, str]], last: str, strict: bool = True) -> Column:
    """The name of the first step that the value lies below."""
    out = F.lit(last)
    for limit, name in reversed(steps):
        out = F.when(value < limit if strict else value <= limit, name).otherwise(out)
    return out


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(F.nullif(p, F.lit(0.0)))).otherwise(0.0)
