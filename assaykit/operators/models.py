"""Models beside Spark's own: users' models in plans, elimination with cross-validation, a linear support-vector regression, neighbours as a model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import infer_task, num, q
from ..plans.neighbours import knn_join, taken
from ..plans.ordering import checkpointed, numbered
from .linear import _batch, summed
from .modelling import assembled, evaluator, filled, forest, permuted

# --- users' models -----------------------------------------------------------------------------------------------------


def predictor(model: object, width: int, classes: int = 0, batch: int = 4096):
    """A column function around an object with predict(matrix) or, for so many classes, predict_proba(matrix): an array of
    width features in, a double or an array of probabilities out. The object is sent to the tasks and asked by batches."""

    def make():
        ask = model.predict_proba if classes else model.predict
        return lambda x: np.asarray(ask(np.asarray(x, float).reshape(-1, width)), float)

    return predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()) if classes else T.DoubleType(), batch_size=batch, input_tensor_shapes=[[width]])


def with_predictions(df: DataFrame, cols: Sequence[str], model: object, output: str = "prediction", classes: int = 0) -> DataFrame:
    """The rows with the model's prediction (or probabilities) from numeric columns; gaps are filled by medians for it."""
    held = filled(df.select("*", *(num(c).alias(f"__m_{c}") for c in cols)), [f"__m_{c}" for c in cols])
    return _predicted(held, [q(f"__m_{c}") for c in cols], model, output, classes).drop(*(f"__m_{c}" for c in cols))


def _predicted(df: DataFrame, inputs: Sequence[Column], model: object, output: str, classes: int = 0) -> DataFrame:
    return df.withColumn(output, predictor(model, len(inputs), classes)(F.array(*inputs)))


def scores_of(df: DataFrame, target: str, predictions: Sequence[str], task: str) -> list[float]:
    """Accuracy, or R squared of a numeric target, of each prediction, all in one scan."""
    rows = df.where(q(target).isNotNull())
    if task == "classification":
        return [float(v or 0.0) for v in rows.agg(*(F.avg((q(p).cast("double") == num(target)).cast("double")).alias(f"s{i}") for i, p in enumerate(predictions))).first()]
    y = num(target)
    *left, spread = rows.agg(*(F.sum((y - num(p)) * (y - num(p))).alias(f"s{i}") for i, p in enumerate(predictions)), (F.var_pop(y) * F.count(y)).alias("spread")).first()
    return [1 - v / spread if spread else 0.0 for v in left]


def score_of(df: DataFrame, target: str, prediction: str, task: str) -> float:
    return scores_of(df, target, [prediction], task)[0]


def model_importance(df: DataFrame, cols: Sequence[str], target: str, model: object, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Loss of the user model's score when one column is permuted among the rows: feature, importance, importance_std. A classifier predicts the target's numbers.

    The permuted rows of a repeat are read once, for the scores of all columns.
    """
    task = infer_task(df, target)
    data = checkpointed(filled(df.where(q(target).isNotNull()).select(q(target), *(q(c) for c in cols)), cols))
    base = score_of(_predicted(data, [q(c) for c in cols], model, "__p"), target, "__p", task)
    drops: dict[str, list[float]] = {c: [] for c in cols}
    ask, names = predictor(model, len(cols)), [f"__s{i}" for i in range(len(cols))]
    for k in range(repeats):
        exchanged = permuted(data, cols, seed + 2 * k)
        inputs = [F.array(*(q(f"__p_{x}") if x == c else q(x) for x in cols)) for c in cols]
        scored = exchanged.select(q(target), *(ask(x).alias(n) for x, n in zip(inputs, names)))
        for c, score in zip(cols, scores_of(scored, target, names, task)):
            drops[c].append(base - score)
    return df.sparkSession.createDataFrame([(c, float(np.mean(d)), float(np.std(d))) for c, d in drops.items()], "feature string, importance double, importance_std double")


# --- elimination with cross-validation ---------------------------------------------------------------------------------


def eliminate_cv(df: DataFrame, cols: Sequence[str], target: str, folds: int = 5, trees: int = 50, depth: int = 5, least: int = 1, seed: int = 42) -> DataFrame:
    """Recursive elimination whose number of columns is chosen by cross-validation: feature, ranking (1 stays), kept, size, cv_score.

    In each fold a forest drops its least important column again and again, and is scored on the rows left out at every
    number of columns. The number of the best mean score (ties: the smaller) is then reached on all rows. cv_score is the mean at the number chosen,
    scores are all means by falling number: accuracy, or less the mean squared error. Gaps are filled once; the folds, which
    share nothing but the rows, are worked out side by side.
    """
    data, task = assembled(df.select(q(target), *(q(c) for c in cols)), cols, target)
    fold = F.pmod(F.xxhash64(F.lit(seed), "label", *(num(c) for c in cols)), F.lit(folds)).cast("int")
    rows = checkpointed(data.select("label", *(num(c).alias(c) for c in cols), fold.alias("__fold")))
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="mse")

    def fitted(train: DataFrame, left: list[str]):
        vectors = VectorAssembler(inputCols=left, outputCol="features")
        return vectors, forest(task, trees, depth, seed).fit(vectors.transform(train))

    def dropped(train: DataFrame, left: list[str], to: int, test: DataFrame | None = None) -> tuple[list[str], list[str], list[float]]:
        left, gone, scores = list(left), [], []
        while True:
            if test is None and len(left) <= to:
                return left, gone, scores
            vectors, model = fitted(train, left)
            if test is not None:
                value = judge.evaluate(model.transform(vectors.transform(test)))
                scores.append(value if task == "classification" else -value)
            if len(left) <= to:
                return left, gone, scores
            worst = left[int(np.argmin(model.featureImportances.toArray()))]
            left.remove(worst)
            gone.append(worst)

    def one(k: int) -> list[float] | None:
        train, test = rows.where(F.col("__fold") != k), rows.where(F.col("__fold") == k)
        return None if test.isEmpty() or train.isEmpty() else dropped(train, list(cols), least, test)[2]

    with ThreadPoolExecutor(folds) as pool:
        got = [s for s in pool.map(one, range(folds)) if s]
    sizes = list(range(len(cols), least - 1, -1))
    means = np.mean(got, 0) if got else np.zeros(len(sizes))
    best = max(range(len(sizes)), key=lambda i: (means[i], -sizes[i]))
    left, gone, _ = dropped(rows, list(cols), sizes[best]) if got else (list(cols), [], [])
    rank = {c: len(gone) - i + 1 for i, c in enumerate(gone)}
    lines = [(c, rank.get(c, 1), c in left, len(left), float(means[best]), [float(m) for m in means]) for c in cols]
    return df.sparkSession.createDataFrame(lines, "feature string, ranking int, kept boolean, size int, cv_score double, scores array<double>")


# --- support vectors ---------------------------------------------------------------------------------------------------


def svr_weights(data: DataFrame, names: Sequence[str], y: str, cost: float = 1.0, slack: float = 0.1, steps: int = 30) -> np.ndarray:
    """Intercept and coefficients of the linear support-vector regression with squared slack loss:
    |w|^2 / 2 + cost x the sum of squares of what errors exceed slack by; the intercept is free.

    Each scan adds up the second-order sums of the rows outside the tube; few Newton steps settle which these are.
    """
    k, spark, w = len(names), data.sparkSession, np.zeros(len(names) + 1)
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(w.copy())

        def products(b: pa.RecordBatch, sent=sent) -> Iterator[tuple[int, np.ndarray]]:
            z = np.column_stack([np.ones(b.num_rows), _batch(b, names)])
            error = z @ sent.value - np.asarray(b.column(y).to_numpy(), float)
            over = np.sign(error) * np.maximum(np.abs(error) - slack, 0)
            on = over != 0
            yield 0, np.column_stack([z[on].T @ z[on], z.T @ over, np.full(k + 1, (over**2).sum())])

        got = summed(data.select(*names, y), 1, (k + 1, k + 3), products)[0]
        ridge = np.eye(k + 1)
        ridge[0, 0] = 1e-9
        slope = ridge @ w + 2 * cost * got[:, -2]
        step = np.linalg.solve(ridge + 2 * cost * got[:, :-2], -slope)
        w = w + step
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(w).max()):
            break
    return w


def knn_predictions(train: DataFrame, test: DataFrame, names: Sequence[str], y: str, task: str, k: int = 5) -> DataFrame:
    """The test rows with the mean, or the most frequent label (ties: the smallest), of the k nearest training rows, all of them searched.

    Rows at one place count each; where they are more than are needed, they give their share.
    """
    x = F.array(*(num(c) + 0.0 for c in names))
    places = train.select(x.alias("x"), num(y).alias("__y"))
    points = checkpointed(numbered(places.groupBy("x").agg(F.count("*").alias("weight")), ["x"], "id"))
    asked = checkpointed(numbered(test.select(x.alias("x")).distinct(), ["x"], "qid"))
    near = knn_join(asked, points, k).select("qid", F.inline(taken(k)))
    labels = places.groupBy("x", "__y").agg(F.count("*").alias("n")).join(points, "x").select("id", "__y", (F.col("n") / F.col("weight")).alias("share"))
    votes = near.join(labels, "id").groupBy("qid", "__y").agg(F.sum(F.col("times") * F.col("share")).alias("votes"))
    if task == "classification":
        best = Window.partitionBy("qid").orderBy(F.desc(F.round("votes", 9)), "__y")
        given = votes.withColumn("n", F.row_number().over(best)).where("n = 1").select("qid", F.col("__y").alias("prediction"))
    else:
        given = votes.groupBy("qid").agg((F.sum(F.col("__y") * F.col("votes")) / F.sum("votes")).alias("prediction"))
    return test.withColumn("x", x).join(asked.join(given, "qid").select("x", "prediction"), "x").drop("x")


def compare_kernels(df: DataFrame, cols: Sequence[str], target: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Cross-validated score of a linear support-vector machine (of two classes, or a number) and of the nearest neighbours: model, mean_score, std_score.

    Columns are standardised; folds go by a hash of the row. Scores are accuracy or R squared.
    """
    data, task = assembled(df.select(q(target), *(q(c) for c in cols)), cols, target)
    at = data.agg(*(f(num(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    names = [f"z{i}" for i in range(len(cols))]
    z = [((num(c) - F.lit(at[f"m{i}"])) / F.lit(at[f"s{i}"] or 1.0)).alias(names[i]) for i, c in enumerate(cols)]
    fold = F.pmod(F.xxhash64(F.lit(seed), "label", *(num(c) for c in cols)), F.lit(folds)).cast("int")
    rows = checkpointed(data.select("label", *z, fold.alias("fold")))
    two = task == "classification" and rows.select("label").distinct().count() == 2
    scores: dict[str, list[float]] = {}
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if train.isEmpty() or test.isEmpty():
            continue
        if two:
            vectors = VectorAssembler(inputCols=names, outputCol="features")
            out = LinearSVC(maxIter=50, regParam=0.01).fit(vectors.transform(train)).transform(vectors.transform(test))
            scores.setdefault("svm", []).append(evaluator(task).evaluate(out))
        elif task != "classification":
            mean, spread = train.agg(F.avg("label"), F.stddev_pop("label")).first()
            unit = train.withColumn("unit", (F.col("label") - F.lit(mean)) / F.lit(spread or 1.0))
            w = svr_weights(unit, names, "unit")
            guess = sum((F.col(n) * float(v) for n, v in zip(names, w[1:])), F.lit(float(w[0]))) * F.lit(spread or 1.0) + F.lit(mean)
            scores.setdefault("svr", []).append(score_of(test.withColumn("__p", guess), "label", "__p", task))
        scores.setdefault("neighbours", []).append(score_of(knn_predictions(train, test, names, "label", task), "label", "prediction", task))
    return df.sparkSession.createDataFrame([(m, float(np.mean(s)), float(np.std(s))) for m, s in scores.items()], "model string, mean_score double, std_score double")
