"""Preprocessing of one table: types found, then fills, codes, scales, transforms and components fitted in a few scans.

What is fitted is a small plan of numbers and categories; :meth:`Prepared.transform` turns it into column expressions, so a
table of any size is transformed in one projection, and the same plan serves new data. Unknown categories are all zeros
(or -1), gaps get the fitted fills.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CATEGORICAL, DATETIME, NUMERIC, columns_of, num, q
from ..plans.fuse import fused, long_values, row
from ..plans.ranks import Histogram, exact_quantiles
from .features import frequent, yeo_johnson_expr
from .linear import _batch, _centred, summed
from .profile import id_columns

#: Quantiles of a quantile transform.
QUANTILES = 1000
#: Shares beyond which a normal score is cut.
EDGE = 1e-7


@dataclass
class Types:
    """Columns by what they hold; converted ones are text that reads as numbers or times."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    converted: dict[str, str] = field(default_factory=dict)


def read_number(c: str) -> Column:
    """Text as a number, without thousands separators, currency and percent signs and blanks."""
    return F.regexp_replace(q(c).cast("string"), r"[,$%\s]", "").try_cast("double")


def infer_types(df: DataFrame, cols: Sequence[str] | None = None, loss: float = 0.1, long_text: float = 50.0) -> Types:
    """Types of columns, text ones by their values: numbers or times if less than the share loss of them does not read so,
    free text if long (or of some length and mostly distinct), else categories. All values are read, in two scans."""
    cols = list(cols or df.columns)
    out = Types(numeric=columns_of(df.select(*map(q, cols)), NUMERIC), datetime=columns_of(df.select(*map(q, cols)), DATETIME))
    texts = columns_of(df.select(*map(q, cols)), CATEGORICAL)
    if texts:
        s = lambda c: q(c).cast("string")
        found = fused(df, [row(feature=F.lit(c), n=F.count(s(c)), numbers=F.count(read_number(c)), times=F.count(s(c).try_cast("timestamp")), length=F.coalesce(F.avg(F.length(s(c))), F.lit(0.0))) for c in texts])
        distinct = {r["feature"]: r["k"] for r in long_values(df, texts).where("value is not null").distinct().groupBy("feature").agg(F.count("*").alias("k")).collect()}
        for r in found.collect():
            c, n = r["feature"], r["n"]
            if n and n - r["numbers"] <= loss * n and df.schema[c].dataType.typeName() != "boolean":
                out.numeric.append(c)
                out.converted[c] = "numeric"
            elif n and n - r["times"] <= loss * n and df.schema[c].dataType.typeName() != "boolean":
                out.datetime.append(c)
                out.converted[c] = "datetime"
            elif n and (r["length"] > long_text or (distinct[c] > 0.8 * n and r["length"] > 20)):
                out.text.append(c)
            else:
                out.categorical.append(c)
    # text that reads as numbers or times is an id by its name only, as are plain doubles
    out.ids = [r["feature"] for r in id_columns(df, cols).where("id_like").collect() if r["named"] or r["feature"] not in out.converted]
    return out


def normal_score(p: Column) -> Column:
    """The standard normal quantile of a share, cut at EDGE: rational approximations in the middle and in the tails (absolute error below 1e-8)."""
    # Acklam's coefficients of the inverse normal distribution.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def poly(k: Sequence[float], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + F.lit(v)
        return out

    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    low = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(low))
    tail = poly(c, t) / poly(d, t)
    r = (p - 0.5) * (p - 0.5)
    return F.when(low < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(poly(a, r) * (p - 0.5) / poly(b, r))


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _share(v: Column, cuts: Sequence[float]) -> Column:
    """Place of a value between sorted cuts, 0 to 1, linear within a step; the step is found by halving."""
    table, last = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>"), len(cuts) - 1
    halves = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, last.bit_length())))))
    step = F.aggregate(halves, F.lit(0), lambda at, s: F.when((at + s < last) & (F.get(table, at + s) < v), at + s).otherwise(at))

    def place(at: Column) -> Column:
        lo, hi = F.get(table, at), F.get(table, at + 1)
        return F.least(F.greatest((at + F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))) / last, F.lit(0.0)), F.lit(1.0))

    return _bound(step, place)


@dataclass
class Prepared:
    """A fitted preparation; columns of the result: num_<column>, cat_<column>_<value> or cat_<column>, <column>_<part>, pc_<n>."""

    types: Types
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    ignored: list[str]
    target: str | None = None
    fills: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    grouped: dict = field(default_factory=dict)  # whether rarer values share a column
    ordinal: bool = False
    scales: dict = field(default_factory=dict)
    method: str | None = None
    fitted: dict = field(default_factory=dict)  # powers or quantiles by column
    components: tuple | None = None  # means, loadings

    def metadata(self) -> dict:
        return {
            "numeric_columns": self.numeric, "categorical_columns": self.categorical, "datetime_columns": self.datetime, "text_columns": self.types.text, "ignored_columns": self.ignored,
            "id_like_columns": self.types.ids, "converted": self.types.converted, "fills": self.fills, "categories": self.categories, "scales": self.scales, "transformation": self.method, "components": len(self.components[1]) if self.components else 0, "target": self.target,
        }

    def _value(self, c: str) -> Column:
        return read_number(c) if self.types.converted.get(c) == "numeric" else num(c)

    def _filled(self, c: str) -> Column:
        return F.coalesce(self._value(c), F.lit(self.fills[c]).cast("double"))

    def _scaled(self, c: str) -> Column:
        centre, width = self.scales.get(c, (0.0, 1.0))
        return (self._filled(c) - F.lit(float(centre))) / F.lit(float(width or 1.0))

    def _number(self, c: str) -> Column:
        x, fit = self._scaled(c), self.fitted.get(c)
        if fit is None:
            return x
        if self.method in ("yeo-johnson", "box-cox"):
            lam, centre, width = fit
            return (yeo_johnson_expr(x, lam) - F.lit(centre)) / F.lit(width or 1.0)
        share = _bound(x, lambda v: _share(v, fit))
        return _bound(share, normal_score) if self.method == "quantile-normal" else share

    def columns(self) -> dict[str, Column]:
        out = {f"num_{c}": self._number(c) for c in self.numeric}
        for c in self.categorical:
            v = F.coalesce(q(c).cast("string"), F.lit(self.fills[c]))
            known = self.categories[c]
            if self.ordinal:
                out[f"cat_{c}"] = F.coalesce(F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), v).cast("double") - 1, F.lit(-1.0))
                continue
            out |= {f"cat_{c}_{x}": (v == x).cast("double") for x in known}
            if self.grouped[c]:
                out[f"cat_{c}_other"] = (~v.isin(known)).cast("double")
        for c in self.datetime:
            t = q(c).cast("string").try_cast("timestamp") if c in self.types.converted else q(c).cast("timestamp")
            parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "dow": F.weekday(t), "quarter": F.quarter(t), "is_weekend": (F.weekday(t) >= 5).cast("int")}
            out |= {f"{c}_{n}": v.cast("double") for n, v in parts.items()}
            for n, period in (("month", 12), ("day", 31), ("hour", 24), ("dow", 7)):
                angle = 2 * math.pi * parts[n] / period
                out |= {f"{c}_{n}_sin": F.sin(angle), f"{c}_{n}_cos": F.cos(angle)}
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The prepared columns, the kept ones and the target; or the components of the prepared columns, if these were asked for."""
        made = self.columns()
        if self.components:
            mean, load = self.components
            held = [F.coalesce(v, F.lit(0.0)) - F.lit(float(m)) for v, m in zip(made.values(), mean, strict=True)]
            made = {f"pc_{i}": sum((h * F.lit(float(w)) for h, w in zip(held, line)), F.lit(0.0)) for i, line in enumerate(load, 1)}
        named = [q(c) for c in dict.fromkeys([*keep, *([self.target] if self.target and self.target in df.columns else [])])]
        return df.select(*named, *(v.alias(n) for n, v in made.items()))


def setup(
    df: DataFrame, target: str | None = None, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None, datetime: Sequence[str] | None = None, ignore: Sequence[str] = (),
    numeric_fill: str = "mean", categorical_fill: str = "most_frequent", encoding: str = "auto", max_categories: int = 10, normalize: str | None = None, transformation: str | None = None,
    components: float | None = None,
) -> Prepared:
    """Fits a preparation of all columns but the target, ids, free text and ignored ones.

    numeric_fill: mean, median, most_frequent or a number; categorical_fill: most_frequent or a value; encoding: auto (an
    indicator for each of the most frequent values, one for the others if there are more than max_categories) or ordinal
    (codes in the order of values); normalize: zscore, minmax, robust or maxabs; transformation: yeo-johnson (also by the
    name box-cox), quantile-uniform or quantile-normal, after scaling; components: principal components in place of the
    columns, min(50, max(2, 10 x components)) of them, at most as many as columns. An empty column is filled with 0, or
    with the value "missing"; an empty table gives a preparation that fills so.
    """
    types = infer_types(df.drop(target) if target else df)
    given = {c for g in (numeric, categorical, datetime) for c in g or ()}
    out_of = {*ignore, *(c for c in types.ids if c not in given)}
    chosen = lambda named, found: [c for c in (named if named is not None else found) if c not in out_of and c != target]
    p = Prepared(types, chosen(numeric, types.numeric), chosen(categorical, types.categorical), chosen(datetime, types.datetime), sorted(out_of), target, ordinal=encoding == "ordinal", method=transformation)
    if encoding not in ("auto", "ordinal", "onehot") or normalize not in (None, "zscore", "minmax", "robust", "maxabs") or transformation not in (None, "yeo-johnson", "box-cox", "quantile-uniform", "quantile-normal"):
        raise ValueError("unknown encoding, scaling or transformation")
    _fit_fills(df, p, numeric_fill, categorical_fill)
    for c in p.categorical:
        held = df.select(F.coalesce(q(c).cast("string"), F.lit(p.fills[c])).alias("v"))
        if p.ordinal:
            p.categories[c] = [r["v"] for r in held.distinct().orderBy("v").collect()]  # a dictionary of the column, as it has to be for expressions
        else:
            values = frequent(held, "v", max_categories + 1)
            p.grouped[c] = len(values) > max_categories
            p.categories[c] = sorted(values[: max_categories - 1] if p.grouped[c] else values)
    if normalize and p.numeric:
        _fit_scales(df, p, normalize)
    if transformation and p.numeric:
        _fit_transform(df, p, transformation)
    if components is not None:
        _fit_components(df, p, min(50, max(2, int(10 * components))))
    return p


def _fit_fills(df: DataFrame, p: Prepared, numeric_fill: str | float, categorical_fill: str) -> None:
    values = df.select(*(p._value(c).alias(c) for c in p.numeric)) if p.numeric else None
    if isinstance(numeric_fill, (int, float)):
        found = dict.fromkeys(p.numeric, numeric_fill)
    elif numeric_fill == "median":
        found = {c: v[0] for c, v in exact_quantiles(values, p.numeric, [0.5]).items()} if p.numeric else {}
    elif numeric_fill == "most_frequent":
        found = {r["feature"]: r["mode"] for r in Histogram(values, p.numeric).modes().collect()} if p.numeric else {}
    elif numeric_fill == "mean":
        found = {r["feature"]: r["m"] for r in fused(values, [row(feature=F.lit(c), m=F.avg(q(c))) for c in p.numeric]).collect()} if p.numeric else {}
    else:
        raise ValueError(f"unknown fill {numeric_fill}")
    p.fills |= {c: float(found.get(c) if found.get(c) is not None else 0.0) for c in p.numeric}
    for c in p.categorical:
        top = frequent(df, c, 1) if categorical_fill == "most_frequent" else [categorical_fill]
        p.fills[c] = top[0] if top else "missing"


def _fit_scales(df: DataFrame, p: Prepared, method: str) -> None:
    held = df.select(*(p._filled(c).alias(c) for c in p.numeric))
    if method == "robust":
        p.scales = {c: (v[1] or 0.0, (v[2] or 0.0) - (v[0] or 0.0)) for c, v in exact_quantiles(held, p.numeric, [0.25, 0.5, 0.75]).items()}
        return
    of = {"zscore": lambda x: (F.avg(x), F.stddev_pop(x)), "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)), "maxabs": lambda x: (F.lit(0.0), F.max(F.abs(x)))}[method]
    rows = [row(feature=F.lit(c), centre=of(num(c))[0].cast("double"), width=of(num(c))[1].cast("double")) for c in p.numeric]
    p.scales = {r["feature"]: (r["centre"] or 0.0, r["width"] or 0.0) for r in fused(held, rows).collect()}


def _fit_transform(df: DataFrame, p: Prepared, method: str) -> None:
    held = df.select(*(p._scaled(c).alias(c) for c in p.numeric))
    if method.startswith("quantile"):
        p.fitted = Histogram(held, p.numeric).grid(QUANTILES)
        return
    # powers of all columns by grids that close in, one scan a round
    span = {c: (-3.0, 5.0) for c in p.numeric}
    for _ in range(5):
        grid = {c: np.linspace(*span[c], 17).tolist() for c in p.numeric}
        rows = [row(feature=F.lit(c), lam=F.lit(g), ll=-F.count(num(c)) / 2.0 * F.log(F.var_pop(yeo_johnson_expr(num(c), g))) + (g - 1) * F.sum(F.signum(num(c)) * F.log1p(F.abs(num(c))))) for c in p.numeric for g in grid[c]]
        best: dict[str, tuple[float, float]] = {}
        for r in fused(held, rows).collect():
            ll = r["ll"] if r["ll"] is not None and math.isfinite(r["ll"]) else -math.inf
            best[r["feature"]] = max(best.get(r["feature"], (-math.inf, 1.0)), (ll, r["lam"]), key=lambda t: t[0])
        step = {c: (span[c][1] - span[c][0]) / 16 for c in p.numeric}
        span = {c: (best[c][1] - step[c], best[c][1] + step[c]) for c in p.numeric}
    power = {c: best[c][1] if best[c][0] > -math.inf else 1.0 for c in p.numeric}
    at = {r["feature"]: r for r in fused(held, [row(feature=F.lit(c), m=F.avg(yeo_johnson_expr(num(c), power[c])), s=F.stddev_pop(yeo_johnson_expr(num(c), power[c]))) for c in p.numeric]).collect()}
    p.fitted = {c: (power[c], at[c]["m"] or 0.0, at[c]["s"] or 1.0) for c in p.numeric}


def _fit_components(df: DataFrame, p: Prepared, k: int) -> None:
    """Loadings from one scan's sums of products of the prepared columns; the largest loading of each is positive."""
    made = p.columns()
    names = [f"c{i}" for i in range(len(made))]
    data = df.select(*(F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(names, made.values())))
    width = len(names)

    def products(b):
        v = np.column_stack([np.ones(b.num_rows), _batch(b, names), np.zeros(b.num_rows)])
        yield 0, v.T @ v

    cov, _, mean, _ = _centred(summed(data, 1, (width + 2, width + 2), products)[0])
    value, vector = np.linalg.eigh(cov)
    load = vector[:, np.argsort(-value)[: min(k, width)]].T
    load = load * np.sign(load[np.arange(len(load)), np.abs(load).argmax(1)])[:, None]
    p.components = (mean.tolist(), load.tolist())
