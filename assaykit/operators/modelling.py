"""Model-backed operators: importance, selection, explanation, anomaly models, imputation, reduction."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import infer_task, num, q
from ..functions.exprs import corr
from ..plans.fuse import fused, row
from ..plans.graph import components
from ..plans.ordering import bucket_of, checkpointed, numbered
from ..plans.ranks import exact_quantiles, medians
from .features import correlation_filter, variance_filter
from .leakage import binned_information

#: Rows a model fitted on the driver or broadcast to the executors may hold.
MODEL_ROWS = 20_000


def bounded(df: DataFrame, keys: Sequence[str], limit: int = MODEL_ROWS, seed: int = 42) -> DataFrame:
    """All rows, or about limit of them by a hash of the key."""
    n = df.count()
    return df if n <= limit else df.where(F.pmod(F.xxhash64(*(q(k) for k in keys), F.lit(seed)), F.lit(1 << 30)) < int(limit / n * (1 << 30)))


def filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns with gaps filled by the median (0 for an empty column)."""
    at = medians(df, cols)
    return df.withColumns({c: F.coalesce(num(c), F.lit(float(at[c] or 0.0))) for c in cols})


def assembled(df: DataFrame, cols: Sequence[str], target: str, task: str | None = None) -> tuple[DataFrame, str]:
    """Columns features (vector) and label; rows without a target are left out."""
    task = task or infer_task(df, target)
    held = filled(df.where(q(target).isNotNull()), cols)
    held = labelling(held, target, task)(held)
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(held), task


def labelling(df: DataFrame, target: str, task: str) -> Callable[[DataFrame], DataFrame]:
    """What adds the column label to rows with the targets of df."""
    if task != "classification":
        return lambda rows: rows.withColumn("label", num(target))
    named = lambda rows: rows.withColumn("__t", q(target).cast("string"))
    model = StringIndexer(inputCol="__t", outputCol="label", stringOrderType="alphabetAsc").fit(named(df))
    return lambda rows: model.transform(named(rows))


def forest(task: str, trees: int = 50, depth: int = 10, seed: int = 42):
    return (RandomForestClassifier if task == "classification" else RandomForestRegressor)(numTrees=trees, maxDepth=depth, seed=seed)


def evaluator(task: str):
    return MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2")


def _scores(df: DataFrame, cols: Sequence[str], values: Sequence[float], name: str = "importance") -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values, strict=True)], f"feature string, {name} double")


def forest_importance(df: DataFrame, cols: Sequence[str], target: str, trees: int = 50, depth: int = 10) -> DataFrame:
    data, task = assembled(df, cols, target)
    return _scores(df, cols, forest(task, trees, depth).fit(data).featureImportances.toArray())


def permuted(df: DataFrame, cols: Sequence[str], seed: int, prefix: str = "__p_") -> DataFrame:
    """The rows with cols again under prefixed names, taken from another row each: a permutation of the rows by hash.

    Rows are numbered in two hash orders and joined by number, so every value is used as often as it occurs.
    """
    order = lambda salt: [F.xxhash64(F.lit(salt), *(F.col(f"`{c}`") for c in held.columns)), *(F.col(f"`{c}`") for c in held.columns)]
    held = df.drop("features")
    left = numbered(df, order(seed), "__rn")
    # rows of one hash and equal cols may stand for each other, so nothing else of them is sorted
    right = numbered(held.select(order(seed + 1)[0].alias("__h"), *(q(c).alias(f"{prefix}{c}") for c in cols)), ["__h", *(q(f"{prefix}{c}") for c in cols)], "__rn")
    return left.join(right.select("__rn", *(q(f"{prefix}{c}") for c in cols)), "__rn").drop("__rn")


def permutation_importance(df: DataFrame, cols: Sequence[str], target: str, repeats: int = 3, trees: int = 20, seed: int = 42) -> DataFrame:
    """Loss of score when the values of one column are permuted among the rows (see :func:`permuted`)."""
    data, task = assembled(df.select(q(target), *(q(c) for c in cols)), cols, target)
    data = checkpointed(data.drop("features"))
    vectors = VectorAssembler(inputCols=list(cols), outputCol="features")
    model, score = forest(task, trees).fit(vectors.transform(data)), evaluator(task)
    base = score.evaluate(model.transform(vectors.transform(data)))
    drops: dict[str, list[float]] = {c: [] for c in cols}
    for k in range(repeats):
        exchanged = checkpointed(permuted(data, cols, seed + 2 * k))
        for c in cols:
            shuffled = vectors.transform(exchanged.withColumn(c, q(f"__p_{c}")))
            drops[c].append(base - score.evaluate(model.transform(shuffled)))
    return df.sparkSession.createDataFrame([(c, float(np.mean(d)), float(np.std(d))) for c, d in drops.items()], "feature string, importance double, importance_std double")


def sparse_selection(df: DataFrame, cols: Sequence[str], target: str, mixing: float = 1.0, strength: float = 0.01) -> DataFrame:
    """|coefficient| on standardised columns of a linear model with L1 share mixing; above 1e-5 stays."""
    data, task = assembled(df, cols, target)
    data = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(data).transform(data)
    learner = LogisticRegression if task == "classification" else LinearRegression
    model = learner(featuresCol="z", elasticNetParam=mixing, regParam=strength, maxIter=50).fit(data)
    weight = np.abs(model.coefficientMatrix.toArray()).max(0) if task == "classification" else np.abs(model.coefficients.toArray())
    top = weight.max() or 1.0
    return df.sparkSession.createDataFrame([(c, float(w / top), bool(w > 1e-5)) for c, w in zip(cols, weight, strict=True)], "feature string, score double, kept boolean")


def recursive_elimination(df: DataFrame, cols: Sequence[str], target: str, keep: int, trees: int = 20, depth: int = 5) -> DataFrame:
    """Drops the least important column of a forest until keep are left: feature, ranking (1 stays)."""
    left, ranks, place = list(cols), {}, len(cols) - keep + 1
    while len(left) > keep:
        data, task = assembled(df, left, target)
        weight = forest(task, trees, depth).fit(data).featureImportances.toArray()
        worst = left[int(np.argmin(weight))]
        ranks[worst] = place
        place -= 1
        left.remove(worst)
    return df.sparkSession.createDataFrame([(c, int(ranks.get(c, 1))) for c in cols], "feature string, ranking int")


def boruta(df: DataFrame, cols: Sequence[str], target: str, rounds: int = 20, trees: int = 20, seed: int = 42) -> DataFrame:
    """Columns that beat the best shadow (the columns of permuted rows) in at least half of the rounds."""
    hits = dict.fromkeys(cols, 0)
    held = checkpointed(filled(df.where(q(target).isNotNull()), cols).select(q(target), *(q(c) for c in cols)))
    every, task = [*cols, *(f"__p_{c}" for c in cols)], infer_task(held, target)
    vectors = VectorAssembler(inputCols=every, outputCol="features")
    label = labelling(held, target, task)
    for k in range(rounds):
        data = vectors.transform(label(checkpointed(permuted(held, cols, seed + 2 * k)))).select("features", "label")
        weight = dict(zip(every, forest(task, trees, 7, seed + k).fit(data).featureImportances.toArray(), strict=True))
        best = max(weight[f"__p_{c}"] for c in cols)
        for c in cols:
            hits[c] += weight[c] > best
    return df.sparkSession.createDataFrame([(c, int(h), bool(h >= rounds / 2)) for c, h in hits.items()], "feature string, hits int, kept boolean")


def _binned_mi(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10) -> dict[str, float]:
    """Plug-in mutual information of binned columns with a binned or categorical target, from one grouped scan of all columns."""
    task = infer_task(df, target)
    if task != "classification":
        edges = sorted(set(exact_quantiles(df, [target], [i / bins for i in range(1, bins)])[target]) - {None})
        df = df.withColumn("__y", bucket_of(num(target), edges))
        target = "__y"
    got = {r["feature"]: r["mi"] or 0.0 for r in binned_information(df, cols, target, bins).collect()} if cols else {}
    return {c: got[c] for c in cols}


def mrmr(df: DataFrame, cols: Sequence[str], target: str, k: int = 5) -> DataFrame:
    """Greedy: mutual information with the target less the mean |r| with what is chosen: rank, feature, score."""
    mi = _binned_mi(df, cols, target)
    r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in fused(df, [row(a=F.lit(a), b=F.lit(b), r=corr(num(a), num(b))) for a, b in combinations(cols, 2)]).collect()}
    near = lambda a, b: r.get((a, b), r.get((b, a), 0.0))
    chosen: list[str] = []
    out = []
    while len(chosen) < min(k, len(cols)):
        score = {c: mi[c] - (sum(near(c, x) for x in chosen) / len(chosen) if chosen else 0.0) for c in cols if c not in chosen}
        best = max(score, key=lambda c: (score[c], c))
        chosen.append(best)
        out.append((len(chosen), best, float(score[best])))
    return df.sparkSession.createDataFrame(out, "rank int, feature string, score double")


def pca(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """component, explained share, cumulative share, the column of the largest |loading|."""
    held = filled(df, cols)
    data = VectorAssembler(inputCols=list(cols), outputCol="raw").transform(held)
    data = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(data).transform(data)
    k = min(k or 50, len(cols))
    model = PCA(k=k, inputCol="z", outputCol="p").fit(data)
    share, load = model.explainedVariance.toArray(), model.pc.toArray()
    rows = [(i + 1, float(share[i]), float(share[: i + 1].sum()), cols[int(np.abs(load[:, i]).argmax())]) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, top_feature string")


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True) -> PipelineModel:
    """A fitted preprocessing pipeline: median fill, index and one-hot codes, scaling, one feature vector."""
    from pyspark.ml.feature import OneHotEncoder

    stages = [Imputer(inputCols=list(numeric), outputCols=[f"{c}__f" for c in numeric], strategy="median")] if numeric else []
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__o" for c in categorical], dropLast=False, handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[*(f"{c}__f" for c in numeric), *(f"{c}__o" for c in categorical)], outputCol="raw"))
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withStd=scale, withMean=False))
    return Pipeline(stages=stages).fit(df)


def compare_models(df: DataFrame, cols: Sequence[str], target: str, folds: int = 3) -> DataFrame:
    """Cross-validated score of a linear model, a forest and boosted trees: model, mean, std."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data, task = assembled(df, cols, target)
    data = data.persist()
    models = {"linear": LogisticRegression(maxIter=20) if task == "classification" else LinearRegression(maxIter=20), "forest": forest(task, 20, 5)}
    if task != "classification" or data.select("label").distinct().count() == 2:
        models["boosted"] = GBTClassifier(maxIter=5) if task == "classification" else GBTRegressor(maxIter=5)
    out = []
    for name, m in models.items():
        got = CrossValidator(estimator=m, estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator(task), numFolds=folds, seed=42).fit(data)
        out.append((name, float(got.avgMetrics[0]), float(got.stdMetrics[0])))
    data.unpersist()
    return df.sparkSession.createDataFrame(out, "model string, mean_score double, std_score double")


def influential(df: DataFrame, key: str, cols: Sequence[str], target: str, k: int = 20) -> DataFrame:
    """Rows on which a forest is least sure (entropy of its probabilities) or most wrong."""
    data, task = assembled(df, cols, target)
    out = forest(task, 20, 5).fit(data).transform(data)
    if task == "classification":
        score = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    else:
        score = F.abs(F.col("prediction") - F.col("label"))
    return out.select(q(key).alias("row_key"), score.alias("influence")).orderBy(F.desc("influence"), "row_key").limit(k)


# --- models over a bounded sample, applied to all rows by Arrow batches --------------------------------------------------


def _standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    held = filled(df, cols)
    at = {r["feature"]: r for r in fused(held, [row(feature=F.lit(c), m=F.avg(num(c)), s=F.stddev_pop(num(c))) for c in cols]).collect()}
    return held.withColumns({c: (num(c) - F.lit(at[c]["m"])) / F.lit(at[c]["s"] or 1.0) for c in cols})


def _matrix(df: DataFrame, key: str, cols: Sequence[str], limit: int) -> np.ndarray:
    return bounded(df, [key], limit).select(*(q(c) for c in cols)).toPandas().to_numpy(float)


def _c(n):
    n = np.maximum(np.asarray(n, float), 2.0)
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator):
    if depth <= 0 or len(x) <= 1 or (x == x[0]).all():
        return len(x)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    f = int(rng.choice(spread))
    at = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < at
    return (f, at, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng))


def _path(tree, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if isinstance(tree, int):
        out[rows] += depth + (float(_c(tree)) if tree > 1 else 0.0)
        return
    f, at, left, right = tree
    below = x[rows, f] < at
    if below.any():
        _path(left, x, rows[below], depth + 1, out)
    if (~below).any():
        _path(right, x, rows[~below], depth + 1, out)


def isolation_forest(df: DataFrame, key: str, cols: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Isolation score of every row; the share contamination with the largest scores is flagged.

    Trees are grown on samples drawn from a bounded set of rows and broadcast; all rows are scored.
    """
    z = _standard(df, cols)
    base = _matrix(z, key, cols, trees * sample)
    rng = np.random.default_rng(seed)
    size = min(sample, len(base))
    grown = [_grow(base[rng.choice(len(base), size, replace=False)], max(1, math.ceil(math.log2(max(size, 2)))), rng) for _ in range(trees)] if size else []
    sent = df.sparkSession.sparkContext.broadcast((grown, size))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_, n = sent.value
        for b in batches:
            x = b[list(cols)].to_numpy(float)
            depth = np.zeros(len(x))
            for t in forest_:
                _path(t, x, np.arange(len(x)), 0, depth)
            yield pd.DataFrame({"row_key": b[key], "score": 2 ** (-depth / max(1, len(forest_)) / float(_c(n)))})

    kind = df.schema[key].dataType.simpleString()
    scored = dealt_to_cores(z.select(q(key), *(q(c) for c in cols))).mapInPandas(score, f"row_key {kind}, score double")
    return _above(scored, contamination)


def dealt_to_cores(df: DataFrame) -> DataFrame:
    """The rows, in as many parts as there are cores where a small table has fewer: for work that costs much a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _above(scored: DataFrame, contamination: float) -> DataFrame:
    """row_key, score and whether the score lies above its exact quantile; rows are scored once."""
    held = checkpointed(scored)
    cut = exact_quantiles(held, ["score"], [1 - contamination])["score"][0]
    return held.select("row_key", "score", (F.col("score") > F.lit(cut).cast("double")).alias("is_outlier"))


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """Noise and clusters of DBSCAN on standardised columns: row_key, is_core, cluster (a key of its component of core cells; -1 noise).

    Equal rows go as one point with a count. Points fall into grid cells of side eps / sqrt(dimensions), so rows of one cell
    are all neighbours: cells of least rows or more are core as a whole and never pair their rows. Other cells hold fewer than
    least rows, which meet the points of the cells around theirs. Core cells are joined by boxes (see :func:`_near_cells`).
    """
    z = _standard(df, cols)
    d = len(cols)
    side = eps / math.sqrt(d)
    reach = math.ceil(math.sqrt(d))
    cell = F.array(*(F.floor(num(c) / side).cast("long") for c in cols))
    held = z.select(q(key).alias("row_key"), F.array(*(num(c) for c in cols)).alias("x"), cell.alias("cell"))
    points = checkpointed(held.groupBy("cell", "x").agg(F.count("*").alias("n")))
    shifts = np.stack(np.meshgrid(*([np.arange(-reach, reach + 1)] * d)), -1).reshape(-1, d)
    shifts = [s for s in shifts.tolist() if sum(max(0, abs(v) - 1) ** 2 for v in s) * side * side <= eps * eps]
    around = F.explode(F.transform(F.array(*(F.array(*(F.lit(int(v)) for v in s)) for s in shifts)), lambda s: F.zip_with("cell", s, lambda a, b: a + b))).alias("at")
    near = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v) <= eps * eps
    sizes = points.groupBy("cell").agg((F.sum("n") >= least).alias("full"))
    big = points.join(sizes, "cell")
    asks = big.where("not full").select("cell", "x", around)
    met = asks.join(points.select(F.col("cell").alias("at"), F.col("x").alias("y"), "n"), "at")
    counts = met.where(near(F.col("x"), F.col("y"))).groupBy("cell", "x").agg(F.sum("n").alias("k"))
    core = checkpointed(big.join(counts, ["cell", "x"], "left").select("cell", "x", (F.col("full") | (F.coalesce("k", F.lit(0)) >= least)).alias("is_core")))
    cores = core.where("is_core").select("cell", "x")
    # cells that hold core rows are joined if two of their core rows are neighbours: the outermost rows of each cell are
    # tried first, and boxes of core rows only in cells that are still apart
    ids = checkpointed(cores.select("cell", F.xxhash64("cell").alias("id")).distinct())

    def labelled(edges: DataFrame) -> DataFrame:
        roots = components(edges)
        return checkpointed(ids.join(roots, F.col("id") == F.col("node"), "left").select("cell", "id", F.coalesce("root", "id").alias("label")))

    outer = F.array(*(f(F.col("x"), F.get(F.col("x"), F.lit(i))) for i in range(d) for f in (F.min_by, F.max_by)))
    edge = cores.groupBy("cell").agg(F.array_distinct(outer).alias("xs")).select("cell", F.explode("xs").alias("x"))
    tried = edge.select("cell", "x", around).where("cell < at").join(edge.select(F.col("cell").alias("at"), F.col("x").alias("y")), "at")
    first = labelled(tried.where(near(F.col("x"), F.col("y"))).select(F.xxhash64("cell").alias("a"), F.xxhash64("at").alias("b")).distinct())
    other = first.select(F.col("cell").alias("at"), F.col("label").alias("its"))
    apart = first.select("cell", "label", around).where("cell < at").join(other, "at").where(F.col("label") != F.col("its")).select(F.col("cell").alias("a"), F.col("at").alias("b"))
    found = _near_cells(cores, checkpointed(apart), d, side, eps)
    labels = first if found is None else labelled(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).union(first.select("id", "label")))
    of_core = cores.join(labels, "cell").select("cell", "x", F.lit(True).alias("is_core"), F.col("label").alias("cluster"))
    border = core.where("not is_core").select("cell", "x", around)
    reached = border.join(cores.select(F.col("cell").alias("at"), F.col("x").alias("y")), "at").where(near(F.col("x"), F.col("y")))
    hit = reached.join(labels.select(F.col("cell").alias("at"), "label"), "at").groupBy("cell", "x").agg(F.min("label").alias("c"))
    rest = core.where("not is_core").join(hit, ["cell", "x"], "left").select("cell", "x", F.lit(False).alias("is_core"), F.coalesce("c", F.lit(-1)).alias("cluster"))
    return held.join(of_core.unionByName(rest), ["cell", "x"]).select("row_key", "is_core", "cluster", (F.col("cluster") == -1).alias("is_noise"))


def _near_cells(points: DataFrame, pairs: DataFrame, d: int, side: float, eps: float, direct: int = 4_096) -> DataFrame | None:
    """The pairs (a, b) of cells that hold two points (cell, x) within eps of each other; None if there are no pairs.

    The tight boxes of both cells are compared: boxes farther apart than eps are left, boxes whose farthest corners are within
    eps are a hit, and so is one point of each. What stays undecided is compared point by point if that is at most so many
    comparisons, else halved along each dimension, round by round; a cell pair that is hit is not looked at again.
    """
    total = lambda terms: sum(terms[1:], F.lit(0.0) + terms[0])
    square = lambda x: x * x
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    hits, level = None, 0
    now = pairs.select("a", "b", F.col("a").alias("pa"), F.col("b").alias("pb"))
    while not now.isEmpty():
        wanted = checkpointed(now.select(F.col("a").alias("cell")).union(now.select("b")).distinct())
        part = F.transform("x", lambda v: F.floor(v * float(2**level) / side).cast("long"))  # noqa: B023
        placed = points.join(wanted, "cell", "left_semi").withColumn("part", part)
        ends = [F.array(*(f(at("x", i)) for i in range(d))) for f in (F.min, F.max)]
        boxes = checkpointed(placed.groupBy("cell", "part").agg(ends[0].alias("lo"), ends[1].alias("hi"), F.min("x").alias("one"), F.count("*").alias("m")))
        of = lambda c: boxes.select(F.col("cell").alias(c), F.col("part").alias(f"p{c}"), *(F.col(x).alias(f"{x}_{c}") for x in ("lo", "hi", "one", "m")))  # noqa: E731, B023
        both = now.join(of("a"), ["a", "pa"]).join(of("b"), ["b", "pb"])
        gap = total([square(F.greatest(at("lo_b", i) - at("hi_a", i), at("lo_a", i) - at("hi_b", i), F.lit(0.0))) for i in range(d)])
        wide = total([square(F.greatest(at("hi_b", i) - at("lo_a", i), at("hi_a", i) - at("lo_b", i))) for i in range(d)])
        ones = total([square(at("one_a", i) - at("one_b", i)) for i in range(d)])
        hit = (wide <= eps * eps) | (ones <= eps * eps)
        judged = checkpointed(both.where(gap <= eps * eps).select("a", "b", "pa", "pb", hit.alias("hit"), (F.col("m_a") * F.col("m_b") <= direct).alias("few")))
        found = judged.where("hit").select("a", "b").distinct()
        undecided = judged.where("not hit").join(found, ["a", "b"], "left_anti")
        x = placed.select(F.col("cell").alias("a"), F.col("part").alias("pa"), "x")
        y = placed.select(F.col("cell").alias("b"), F.col("part").alias("pb"), F.col("x").alias("y"))
        compared = undecided.where("few").join(x, ["a", "pa"]).join(y, ["b", "pb"]).where(total([square(at("x", i) - at("y", i)) for i in range(d)]) <= eps * eps)
        found = checkpointed(found.union(compared.select("a", "b").distinct()))
        hits = found if hits is None else hits.union(found)
        large = undecided.where("not few").join(found, ["a", "b"], "left_anti")
        level += 1
        # the halves of a part: an axis a step
        halves = lambda p: F.explode(F.expr(_halves(p, d)))
        now = checkpointed(large.select("a", "b", halves("pa").alias("pa"), "pb").select("a", "b", "pa", halves("pb").alias("pb")))
    return hits


def _halves(part: str, d: int) -> str:
    """SQL of the 2^d halves of a part of the grid, in a grid of half its side."""
    return "array(" + ", ".join("array(" + ", ".join(f"2 * {part}[{i}] + {j >> i & 1}L" for i in range(d)) + ")" for j in range(1 << d)) + ")"


def tsne(df: DataFrame, key: str, cols: Sequence[str], limit: int = 500, perplexity: float = 30.0, steps: int = 250, seed: int = 42) -> DataFrame:
    """Two coordinates of a bounded, hash-drawn sample of rows, by t-SNE on the driver."""
    got = bounded(_standard(df, cols), [key], limit, seed).select(q(key).alias("row_key"), *(q(c) for c in cols)).orderBy("row_key").toPandas()
    x = got[list(cols)].to_numpy(float)
    n = len(x)
    if n < 4:
        return df.sparkSession.createDataFrame([], "row_key string, x double, y double")
    d = np.square(x[:, None] - x[None]).sum(-1)
    p = np.zeros((n, n))
    goal = math.log(min(perplexity, (n - 1) / 3))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        own = np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(own - own.min()) * beta)
            e /= e.sum()
            h = -(e * np.log(np.maximum(e, 1e-300))).sum()
            if abs(h - goal) < 1e-5:
                break
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = e
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    move = np.zeros_like(y)
    for s in range(steps):
        w = 1 / (1 + np.square(y[:, None] - y[None]).sum(-1))
        np.fill_diagonal(w, 0)
        g = ((p * (4 if s < 100 else 1) - w / w.sum()) * w)[:, :, None] * (y[:, None] - y[None])
        move = (0.5 if s < 100 else 0.8) * move - 100 * 4 * g.sum(1)
        y = y + move
        y -= y.mean(0)
    return df.sparkSession.createDataFrame(pd.DataFrame({"row_key": got["row_key"].astype(str), "x": y[:, 0], "y": y[:, 1]}))


# --- Shapley values --------------------------------------------------------------------------------------------------


def shap_values(df: DataFrame, key: str, cols: Sequence[str], target: str, permutations: int = 8, background: int = 50, trees: int = 20, seed: int = 42) -> DataFrame:
    """Shapley values by sampled permutations against a small background, of a forest read into numpy: row_key, feature, shap.

    For each row the values sum to the prediction less the mean background prediction, exactly.
    """
    data, task = assembled(df, cols, target)
    model = forest(task, trees, 5).fit(data)
    flat = [_flatten(t, task) for t in model.trees]
    base = bounded(data.select(q(key), *(q(c) for c in cols)), [key], background, seed).select(*(q(c) for c in cols)).toPandas().to_numpy(float)
    sent = df.sparkSession.sparkContext.broadcast((flat, base))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_, ref = sent.value
        rng = np.random.default_rng(seed)
        orders = [rng.permutation(len(cols)) for _ in range(permutations)]
        for b in batches:
            x = b[list(cols)].to_numpy(float)
            phi = np.zeros(x.shape)
            for order in orders:
                for r in ref:
                    now = np.repeat(r[None], len(x), 0)
                    before = _predict(trees_, now)
                    for j in order:
                        now[:, j] = x[:, j]
                        after = _predict(trees_, now)
                        phi[:, j] += after - before
                        before = after
            phi /= len(orders) * max(1, len(ref))
            for j, c in enumerate(cols):
                yield pd.DataFrame({"row_key": b[key], "feature": c, "shap": phi[:, j]})

    kind = df.schema[key].dataType.simpleString()
    return data.select(q(key), *(q(c) for c in cols)).mapInPandas(explain, f"row_key {kind}, feature string, shap double")


def _flatten(tree, task: str):
    """(feature, threshold, left, right, value) arrays of a fitted tree; categories do not occur in numeric columns."""
    feature, at, left, right, value = [], [], [], [], []

    def walk(node) -> int:
        i = len(feature)
        leaf = node.numDescendants() == 0
        feature.append(-1 if leaf else node.split().featureIndex())
        at.append(0.0 if leaf else node.split().threshold())
        left.append(0)
        right.append(0)
        stats = list(node.impurityStats().stats())
        value.append((stats[1] / sum(stats) if len(stats) > 1 else 0.0) if task == "classification" else node.prediction())
        if not leaf:
            left[i] = walk(node.leftChild())
            right[i] = walk(node.rightChild())
        return i

    walk(tree._call_java("rootNode"))
    return tuple(map(np.array, (feature, at, left, right, value)))


def _predict(trees, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for feature, at, left, right, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(64):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            below = x[np.arange(len(x)), np.maximum(f, 0)] <= at[node]
            node = np.where(inner, np.where(below, left[node], right[node]), node)
        out += value[node]
    return out / max(1, len(trees))


def shap_summary(values: DataFrame) -> DataFrame:
    return values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("shap").alias("mean_shap"))


def rank_by(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "feature")))


def fold_score(df: DataFrame, cols: Sequence[str], target: str, folds: int = 5, trees: int = 20, seed: int = 42) -> float:
    """Mean cross-validated score of a forest (accuracy, or R2 of a numeric target); folds by a hash of the row."""
    data, task = assembled(df, cols, target)
    data = checkpointed(data.select("features", "label", F.pmod(F.xxhash64(F.lit(seed), "label", vector_to_array("features")), F.lit(folds)).alias("__fold")))
    got = []
    for k in range(folds):
        train, test = data.where(F.col("__fold") != k), data.where(F.col("__fold") == k)
        if not test.isEmpty() and not train.isEmpty():
            got.append(evaluator(task).evaluate(forest(task, trees).fit(train).transform(test)))
    return float(np.mean(got)) if got else 0.0


def removal_impact(df: DataFrame, cols: Sequence[str], target: str, suspects: Sequence[str], folds: int = 5, trees: int = 20) -> DataFrame:
    """How the cross-validated score changes without each suspect: feature, baseline, score, change, change_pct, verdict."""
    base, out = fold_score(df, cols, target, folds, trees), []
    for c in (s for s in suspects if s in cols and len(cols) > 1):
        score = fold_score(df, [x for x in cols if x != c], target, folds, trees)
        change = base - score
        out.append((c, base, score, change, change / abs(base) * 100 if base else 0.0, "likely leakage" if change > 0.1 else "probably fine"))
    return df.sparkSession.createDataFrame(out, "feature string, baseline double, score double, change double, change_pct double, verdict string")


def select_features(df: DataFrame, cols: Sequence[str], target: str, methods: Sequence[str] | None = None, keep: int | None = None, share: float = 0.5, rounds: int = 20, trees: int = 20) -> DataFrame:
    """Runs selection methods and votes: feature, votes, methods (that keep it), selected.

    methods: any of boruta, rfe, lasso, elastic_net, mrmr, variance, correlation (default: all but elastic_net). A feature
    is selected if max(int(methods * share), 1) of them keep it.
    """
    keep = keep or max(1, len(cols) // 2)
    names = lambda rows, test: [r["feature"] for r in rows.collect() if test(r)]
    known = {
        "boruta": lambda: names(boruta(df, cols, target, rounds, trees), lambda r: r["kept"]),
        "rfe": lambda: names(recursive_elimination(df, cols, target, keep, trees), lambda r: r["ranking"] == 1),
        "lasso": lambda: names(sparse_selection(df, cols, target), lambda r: r["kept"]),
        "elastic_net": lambda: names(sparse_selection(df, cols, target, 0.5), lambda r: r["kept"]),
        "mrmr": lambda: names(mrmr(df, cols, target, keep), lambda r: True),
        "variance": lambda: names(variance_filter(df, cols), lambda r: r["kept"]),
        "correlation": lambda: names(correlation_filter(df, cols), lambda r: r["kept"]),
    }
    chosen = list(methods or (m for m in known if m != "elastic_net"))
    if unknown := [m for m in chosen if m not in known]:
        raise ValueError(f"unknown methods {unknown}; expected some of {', '.join(known)}")
    by = {m: known[m]() for m in chosen}
    least = max(int(len(by) * share), 1)
    rows = [(c, v := [m for m in by if c in by[m]]) for c in cols]
    return df.sparkSession.createDataFrame([(c, len(v), v, len(v) >= least) for c, v in rows], "feature string, votes int, methods array<string>, selected boolean")
