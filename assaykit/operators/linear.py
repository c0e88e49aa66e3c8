"""Linear models from sums of products: cross-validated sparse paths and chained-equation fills.

One scan gathers, for each fold, the matrix of sums of products of all columns. What follows - a path of strengths with
warm starts, scores on held-out folds, the choice, the last fit - needs these matrices only, whose size is that of the
columns squared. For a two-class target the weights of the rows change with the coefficients; there all folds and strengths
advance together, one scan a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import infer_task, num, q
from ..plans.fuse import fused, row
from ..plans.ordering import checkpointed
from .modelling import filled

#: Shares of the absolute penalty that the elastic net tries.
RATIOS, RATIOS_CLASSES = (0.1, 0.5, 0.7, 0.9), (0.1, 0.5, 0.9)
#: Coefficients above it keep their column.
KEPT = 1e-5


def summed(rows: DataFrame, groups: int, shape: tuple[int, int], products: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> np.ndarray:
    """Sums of matrices by group over all batches: each task adds up its own and sends groups x shape numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((groups, *shape)), False
        for b in batches:
            if b.num_rows:
                seen = True
                for g, m in products(b):
                    total[g] += m
        if seen:
            lines = total.reshape(-1, shape[1])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * shape[1], pa.int32()), pa.array(lines.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lines), dtype=np.int32)), values], names=["line", "part"])

    parts = rows.mapInArrow(gather, "line int, part array<double>")
    whole = parts.groupBy("line").agg(F.array(*(F.sum(F.col("part")[i]) for i in range(shape[1]))).alias("part"))
    out = np.zeros((groups * shape[0], shape[1]))
    for r in whole.collect():  # groups x shape numbers, whatever the rows
        out[r["line"]] = r["part"]
    return out.reshape(groups, *shape)


def _batch(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in names], 1)


def _standard(df: DataFrame, cols: Sequence[str], target: str, folds: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Filled, standardised columns (z0, z1, ...), the target y and a fold by a hash of the row, written once."""
    held = filled(df.where(q(target).isNotNull()), cols)
    at = {r["feature"]: r for r in fused(held, [row(feature=F.lit(c), m=F.avg(num(c)), s=F.stddev_pop(num(c))) for c in cols]).collect()}
    z = [((num(c) - F.lit(at[c]["m"])) / F.lit(at[c]["s"] or 1.0)).alias(f"z{i}") for i, c in enumerate(cols)]
    fold = F.pmod(F.xxhash64(F.lit(seed), q(target), *(num(c) for c in cols)), F.lit(folds)).cast("int")
    return checkpointed(held.select(*z, num(target).alias("y") if dict(df.dtypes)[target] != "string" else q(target).alias("y"), fold.alias("fold"))), [f"z{i}" for i in range(len(cols))]


def shrunk(x: float, by: float) -> float:
    return np.sign(x) * max(abs(x) - by, 0.0)


def descend(gram: np.ndarray, moment: np.ndarray, strength: float, ratio: float, start: np.ndarray, free: int = 0, tol: float = 1e-10, steps: int = 10_000) -> np.ndarray:
    """Minimum of w G w / 2 - m w + strength (ratio |w| + (1 - ratio) w^2 / 2) by coordinate descent; the first free coordinates have no penalty."""
    w = start.copy()
    ahead = moment - gram @ w
    for _ in range(steps):
        largest = 0.0
        for j in range(len(w)):
            sole = ahead[j] + gram[j, j] * w[j]
            down = gram[j, j] + (0.0 if j < free else strength * (1 - ratio))
            new = shrunk(sole, 0.0 if j < free else strength * ratio) / down if down > 1e-12 else 0.0
            if new != w[j]:
                ahead -= gram[:, j] * (new - w[j])
                largest = max(largest, abs(new - w[j]))
                w[j] = new
        if largest < tol * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """From sums of products of (1, z, y): covariances, moments with y, means of z and y."""
    n = max(m[0, 0], 1.0)
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    return cov[1:-1, 1:-1], cov[1:-1, -1], mean[1:-1], mean[-1]


def sparse_path(df: DataFrame, cols: Sequence[str], target: str, ratios: Sequence[float] = (1.0,), folds: int = 5, strengths: int = 100, least: float = 1e-3, seed: int = 42) -> DataFrame:
    """Linear regression with an absolute (ratio 1) or mixed penalty, strength and ratio chosen by cross-validation: feature, coefficient
    (of the standardised column), score (its size by the largest), kept, strength, ratio, cv_error.

    Strengths fall from the least one that shrinks all coefficients to 0 by the factor least, in equal steps of their
    logarithm. The smallest mean squared error over the held-out folds wins (ties: the stronger). Rows without a target
    are left out, gaps are filled by medians; folds go by a hash of the row, so equal rows share one. A constant column
    gets 0. No rows give coefficients of 0.
    """
    data, names = _standard(df, cols, target, folds, seed)
    k = len(cols)

    def products(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        v = np.column_stack([np.ones(b.num_rows), _batch(b, [*names, "y"])])
        of = b.column("fold").to_numpy()
        return ((int(f), v[of == f].T @ v[of == f]) for f in np.unique(of))

    by_fold = summed(data, folds, (k + 2, k + 2), products)
    every = by_fold.sum(0)
    gram, moment, _, _ = _centred(every)
    used = [f for f in range(folds) if by_fold[f][0, 0] > 0 and every[0, 0] > by_fold[f][0, 0]]
    best = (np.inf, 0.0, ratios[0])
    for ratio in ratios:
        top = np.abs(moment).max(initial=0.0) / ratio
        grid = top * np.logspace(0, np.log10(least), strengths)
        error = np.zeros(strengths)
        for f in used:
            g, m, mz, my = _centred(every - by_fold[f])
            w = np.zeros(k)
            for i, strength in enumerate(grid):
                w = descend(g, m, strength, ratio, w)
                u = np.concatenate([[-(my - mz @ w)], -w, [1.0]])
                error[i] += u @ by_fold[f] @ u / by_fold[f][0, 0] / len(used)
        if used and error.min() < best[0] - 1e-12 * abs(error.min()):
            best = (float(error.min()), float(grid[int(error.argmin())]), ratio)
    w = descend(gram, moment, best[1], best[2], np.zeros(k)) if used else np.zeros(k)
    return _chosen(df, cols, w, best[1], best[2], best[0])


def _chosen(df: DataFrame, cols: Sequence[str], w: np.ndarray, strength: float, ratio: float, error: float) -> DataFrame:
    top = np.abs(w).max(initial=0.0) or 1.0
    rows = [(c, float(x), float(abs(x) / top), bool(abs(x) > KEPT), float(strength), float(ratio), None if np.isinf(error) else float(error)) for c, x in zip(cols, w, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, score double, kept boolean, strength double, ratio double, cv_error double")


def logistic_path(df: DataFrame, cols: Sequence[str], target: str, ratios: Sequence[float] = (1.0,), folds: int = 5, costs: Sequence[float] = tuple(np.logspace(-4, 4, 10)), steps: int = 12, seed: int = 42) -> DataFrame:
    """The same for a target of two classes: logistic regression; cv_error is the share of held-out rows in the wrong class.

    A cost c stands for a strength of 1 / (c rows). All folds, costs and ratios take a Newton step in each scan, on the
    second-order sums of the rows they train on. The least error wins (ties: the smaller cost, then the earlier ratio).
    """
    classes = sorted(r[0] for r in df.where(q(target).isNotNull()).select(q(target)).distinct().limit(3).collect())
    if len(classes) > 2:
        raise ValueError("a target of two classes is needed")
    positive = df.withColumn(target, F.when(q(target).isNotNull(), (q(target) == F.lit(classes[-1])).cast("double"))) if classes else df
    data, names = _standard(positive, cols, target, folds, seed)
    k, spark = len(cols), df.sparkSession
    rows = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    n = sum(rows.values())
    tried = [(f, c, r) for f in range(folds) for c in costs for r in ratios if n > rows.get(f, 0) > 0]

    def newton(fits: list[tuple[int, float, float]], until: float = 1e-6) -> np.ndarray:
        """Coefficients (the first free of penalty) for each (fold left out, or -1; cost; ratio)."""
        w = np.zeros((len(fits), k + 1))
        left = np.array([f for f, _, _ in fits])
        for _ in range(steps if fits else 0):
            sent = spark.sparkContext.broadcast(w.copy())

            def products(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
                z = np.column_stack([np.ones(b.num_rows), _batch(b, names)])
                y, of = np.asarray(b.column("y").to_numpy(), float), b.column("fold").to_numpy()
                for i, at in enumerate(sent.value):
                    p = 1 / (1 + np.exp(-np.clip(z @ at, -35, 35)))
                    on = of != left[i]
                    curve = np.maximum(p * (1 - p), 1e-6) * on
                    yield i, np.column_stack([(z * curve[:, None]).T @ z, z.T @ ((y - p) * on)])

            got = summed(data, len(fits), (k + 1, k + 2), products)
            moved = 0.0
            for i, (f, cost, ratio) in enumerate(fits):
                m = max(n - rows.get(f, 0), 1)
                gram, slope = got[i][:, :-1] / m, got[i][:, -1] / m
                new = descend(gram, slope + gram @ w[i], 1 / (cost * m), ratio, w[i], free=1, tol=1e-9)
                step = new - w[i]
                step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # separable classes have no finite optimum
                moved, w[i] = max(moved, np.abs(step).max() / max(1.0, np.abs(w[i]).max())), w[i] + step
            if moved < until:
                break
        return w

    fitted = newton(tried)
    sent = spark.sparkContext.broadcast(fitted)
    of_fit = np.array([f for f, _, _ in tried])

    def wrong(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        z = np.column_stack([np.ones(b.num_rows), _batch(b, names)])
        y, of = np.asarray(b.column("y").to_numpy(), float), b.column("fold").to_numpy()
        miss = ((z @ sent.value.T > 0) != (y[:, None] > 0.5)) & (of[:, None] == of_fit[None])
        yield 0, miss.sum(0, keepdims=True)

    best, errors = (np.inf, costs[0], ratios[0]), np.zeros(0)
    if tried:
        errors = summed(data, 1, (1, len(tried)), wrong)[0, 0]
        for c in costs:
            for r in ratios:
                at = [i for i, (_, c2, r2) in enumerate(tried) if (c2, r2) == (c, r)]
                error = float(np.mean([errors[i] / rows[tried[i][0]] for i in at]))
                if error < best[0] - 1e-12:
                    best = (error, c, r)
    w = newton([(-1, best[1], best[2])])[0, 1:] if tried else np.zeros(k)
    return _chosen(df, cols, w, 1 / (best[1] * max(n, 1)), best[2], best[0])


def lasso(df: DataFrame, cols: Sequence[str], target: str, **more) -> DataFrame:
    """The cross-validated absolute penalty, by the kind of the target."""
    return (logistic_path if infer_task(df, target) == "classification" else sparse_path)(df, cols, target, (1.0,), **more)


def elastic_net(df: DataFrame, cols: Sequence[str], target: str, **more) -> DataFrame:
    """The cross-validated mixed penalty, by the kind of the target."""
    if infer_task(df, target) == "classification":
        return logistic_path(df, cols, target, RATIOS_CLASSES, **more)
    return sparse_path(df, cols, target, RATIOS, **more)


# --- chained equations -----------------------------------------------------------------------------------------------


def swept(m: np.ndarray, pivots: Sequence[int]) -> np.ndarray:
    """The matrix swept on pivots in turn: its last column then holds the regression coefficients on them. A pivot that the ones before explain is passed over (coefficient 0)."""
    a, scale, done = m.copy(), np.maximum(np.diag(m), 1e-300), []
    for p in pivots:
        if a[p, p] <= 1e-10 * scale[p]:
            continue
        d = a[p, p]
        line, column = a[p] / d, a[:, p].copy()
        a -= np.outer(column, line)
        a[p], a[:, p], a[p, p] = line, -column / d, 1 / d
        done.append(p)
    out = np.zeros(len(m))
    out[done] = a[done, -1]
    return out


def iterative_impute(df: DataFrame, cols: Sequence[str], rounds: int = 10) -> DataFrame:
    """Chained equations: each column's gaps are predicted from the other columns by least squares, column by column (fewest gaps first), round after round.

    Gaps start from the column's mean. A step reads the rows once: every row's fills so far are worked out anew from the
    equations of all steps before, which are few and small, so no step builds on another one's plan or files; the sums of
    products over the rows that have the column give the next equation. Columns without any value stay empty; columns
    come back as doubles, all others as they are.
    """
    spark, k = df.sparkSession, len(cols)
    at = {r["feature"]: r for r in fused(df, [row(feature=F.lit(c), n=F.count(num(c)), gaps=F.count(F.when(num(c).isNull(), 1)), m=F.avg(num(c)), s=F.stddev_pop(num(c))) for c in cols]).collect()}
    mean, scale = np.array([at[c]["m"] or 0.0 for c in cols]), np.array([at[c]["s"] or 1.0 for c in cols])
    order = sorted((i for i, c in enumerate(cols) if at[c]["gaps"] and at[c]["n"]), key=lambda i: (at[cols[i]]["gaps"], i))
    lead = [i for i, c in enumerate(cols) if at[c]["n"]]
    held = checkpointed(df.select(*(num(c).alias(f"z{i}") for i, c in enumerate(cols))))
    names = [f"z{i}" for i in range(k)]

    def replayed(x: np.ndarray, steps: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gap = np.isnan(x)
        z = np.where(gap, 0.0, (x - mean) / scale)
        for j, w in steps:
            rows = gap[:, j]
            z[rows, j] = w[0] + z[rows] @ w[1:]
        return z, gap

    equations: list[tuple[int, np.ndarray]] = []
    for _ in range(rounds):
        for j in order:
            sent = spark.sparkContext.broadcast(list(equations))

            def products(b: pa.RecordBatch, j: int = j, sent=sent) -> Iterator[tuple[int, np.ndarray]]:
                z, gap = replayed(_batch(b, names), sent.value)
                on = ~gap[:, j]
                v = np.column_stack([np.ones(on.sum()), z[on]])
                yield 0, v.T @ np.column_stack([v, z[on, j]])

            got = summed(held, 1, (k + 1, k + 2), products)[0]
            use = [0, *(i + 1 for i in lead if i != j)]
            m = np.zeros((len(use) + 1, len(use) + 1))
            m[:-1, :-1], m[:-1, -1], m[-1, :-1], m[-1, -1] = got[np.ix_(use, use)], got[use, -1], got[use, -1], got[j + 1, -1]
            w = np.zeros(k + 1)
            w[use] = swept(m, range(len(use)))[:-1]
            equations.append((j, w))
    sent = spark.sparkContext.broadcast(equations)
    empty = [i for i in range(k) if i not in lead]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _batch(b, cols)
            z, gap = replayed(x, sent.value)
            x = np.where(gap, z * scale + mean, x)
            x[:, empty] = np.nan
            for i, c in enumerate(cols):
                b = b.set_column(b.schema.get_field_index(c), c, pa.array(x[:, i], from_pandas=True))
            yield b

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in cols else f.dataType) for f in df.schema])
    return df.withColumns({c: num(c) for c in cols}).mapInArrow(fill, schema)


# --- principal components ----------------------------------------------------------------------------------------------

#: Deviations beyond which values are clipped before components are taken.
CLIP = 5.0


def principal(df: DataFrame, cols: Sequence[str], k: int = 50, top: int = 10, described: int = 5) -> dict:
    """Principal components of filled (medians), clipped and standardised columns, from one scan's sums of products.

    components: component, explained, cumulative, singular_value; loadings: of the first few components the columns of the
    largest size (component, rank, feature, loading; signs make the largest one positive); needed: components for 80, 90
    and 95 percent (all of them, if rounding keeps the sum below); place: a function of (df, key, dims) that gives
    row_key, pc_1, ... An infinite value counts as a gap, a constant column has no part. No rows give components of 0.
    """
    k = min(k, len(cols))
    finite = lambda c: F.when(F.abs(num(c)) != float("inf"), num(c))
    held = filled(df.select("*", *(finite(c).alias(f"__c{i}") for i, c in enumerate(cols))), names := [f"__c{i}" for i in range(len(cols))])
    at = {r["feature"]: r for r in fused(held, [row(feature=F.lit(n), m=F.avg(num(n)), s=F.stddev_pop(num(n))) for n in names]).collect()}
    fills = {r["feature"]: r["f"] for r in fused(held, [row(feature=F.lit(n), f=F.max(F.when(finite(c).isNull(), num(n)))) for n, c in zip(names, cols)]).collect()}
    cut = {n: (at[n]["m"] or 0.0, at[n]["s"] or 0.0) for n in names}

    def clipped(x, n: str):
        m, s = cut[n]
        return F.greatest(F.least(x, F.lit(m + CLIP * s)), F.lit(m - CLIP * s))

    after = {r["feature"]: r for r in fused(held, [row(feature=F.lit(n), m=F.avg(clipped(num(n), n)), s=F.stddev_pop(clipped(num(n), n))) for n in names]).collect()}
    z = lambda x, n: (clipped(x, n) - F.lit(after[n]["m"] or 0.0)) / F.lit(after[n]["s"] or 1.0)
    data = held.select(*(z(num(n), n).alias(n) for n in names))

    def products(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        v = np.column_stack([np.ones(b.num_rows), _batch(b, names), np.zeros(b.num_rows)])
        yield 0, v.T @ v

    every = summed(data, 1, (len(cols) + 2, len(cols) + 2), products)[0]
    cov, _, _, _ = _centred(every)
    n = every[0, 0]
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:k]
    value, load = np.maximum(value[order], 0), vector[:, order].T
    load = load * np.where(load[np.arange(k), np.abs(load).argmax(1)] < 0, -1.0, 1.0)[:, None]
    share = value / np.trace(cov) if np.trace(cov) > 0 else np.zeros(k)
    upto = np.cumsum(share)
    spark = df.sparkSession
    rows = [(i + 1, float(share[i]), float(upto[i]), float(np.sqrt(value[i] * n))) for i in range(k)]
    large = [(i + 1, r, cols[j], float(load[i, j])) for i in range(min(described, k)) for r, j in enumerate(np.argsort(-np.abs(load[i]), kind="stable")[:top], 1)]

    def place(more: DataFrame, key: str, dims: int = 2) -> DataFrame:
        parts = [z(F.coalesce(finite(c), F.lit(fills[n] if fills[n] is not None else cut[n][0])), n) for n, c in zip(names, cols)]
        return more.select(q(key).alias("row_key"), *(sum((x * F.lit(float(w)) for x, w in zip(parts, load[i])), F.lit(0.0)).alias(f"pc_{i + 1}") for i in range(min(dims, k))))

    return {
        "components": spark.createDataFrame(rows, "component int, explained double, cumulative double, singular_value double"),
        "loadings": spark.createDataFrame(large, "component int, rank int, feature string, loading double"),
        "needed": {p: int(next((i + 1 for i in range(k) if upto[i] >= p / 100 - 1e-12), k)) for p in (80, 90, 95)}, "place": place,
    }
