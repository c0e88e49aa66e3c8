"""Scores, votes and advice over small result tables, on the driver."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import q
from .modelling import filled


def combined_importance(*scores: Mapping[str, float]) -> dict[str, float]:
    """Mean of the scores that are known of each feature; below 0.001 it is irrelevant."""
    names = dict.fromkeys(n for s in scores for n in s)
    return {n: sum(s[n] for s in scores if n in s) / sum(n in s for s in scores) for n in names}


def feature_score(low_variance=False, redundant=False, high_cardinality=False, irrelevant=False, unstable=False, importance: float | None = None) -> float:
    score = 100 - 30 * low_variance - 25 * redundant - 20 * high_cardinality - 40 * irrelevant - 15 * unstable
    if importance is not None:
        score += 10 if importance > 0.1 else 5 if importance > 0.05 else 0
    return float(min(100, max(0, score)))


def table_score(has_target: bool, low_variance: int, redundant: int, high_cardinality: int, irrelevant: int, unstable: int, type_issues: int) -> float:
    return float(min(100, max(0, 100 + 5 * has_target - 5 * low_variance - 8 * redundant - 6 * high_cardinality - 10 * irrelevant - 4 * unstable - 3 * type_issues)))


def consensus(selected: Mapping[str, Iterable[str]], scores: Mapping[str, Mapping[str, float]] | None = None, share: float = 0.5) -> dict:
    """Features that max(int(methods * share), 1) of the selection methods keep, ranked by votes, then mean score."""
    votes: dict[str, int] = {}
    for names in selected.values():
        for n in names:
            votes[n] = votes.get(n, 0) + 1
    least = max(int(len(selected) * share), 1)
    mean = {n: (lambda v: sum(v) / len(v) if v else 0.0)([s[n] for s in (scores or {}).values() if n in s]) for n in votes}
    ranked = sorted(votes, key=lambda n: (-votes[n], -mean[n], n))
    return {"votes": votes, "selected": [n for n in ranked if votes[n] >= least], "ranking": ranked}


def optimal_features(selected: Mapping[str, Iterable[str]], min_methods: int = 2) -> list[str]:
    votes = consensus(selected)["votes"]
    return sorted(n for n, v in votes.items() if v >= min_methods)


def reduction_score(n_features: int, for_80: int | None, for_95: int | None, separated: bool, enough_rows: bool) -> float:
    """30, plus up to 25 for few components at 80 and at 95 % of variance, plus 10 each for a clear map and enough rows."""
    def part(k: int | None) -> int:
        share = 1.0 if k is None else k / max(1, n_features)
        return 25 if share <= 0.3 else 20 if share <= 0.5 else 15 if share <= 0.7 else 10

    return float(min(100, 30 + part(for_80) + part(for_95) + 10 * separated + 10 * enough_rows))


def components_for(cumulative: Sequence[float], share: float) -> int | None:
    """How many components explain the share; None if all together do not."""
    return next((i for i, c in enumerate(cumulative, 1) if c >= share - 1e-12), None)


def feature_explanation(name: str, importance: float, r: float | None) -> str:
    weight = "strong" if importance > 0.2 else "moderate" if importance > 0.05 else "weak"
    way = "a mixed" if r is None or abs(r) < 0.1 else "a rising" if r > 0 else "a falling"
    return f"{name} has {weight} importance and {way} relation with the target"


def distribution_issues(summary: Iterable[Mapping]) -> list[dict]:
    """Issues and what to do about them, from numeric summaries."""
    out = []
    for r in summary:
        if r["skew"] is not None and abs(r["skew"]) >= 1:
            out.append({"feature": r["feature"], "issue": "skewed", "advice": "log, Box-Cox or Yeo-Johnson transform"})
        if r["std"] == 0:
            out.append({"feature": r["feature"], "issue": "constant", "advice": "drop the column"})
        if r["kurtosis"] is not None and r["kurtosis"] > 3:
            out.append({"feature": r["feature"], "issue": "heavy tails", "advice": "clip or use robust scaling"})
    return out


def gap_predictability(df: DataFrame, column: str, others: Sequence[str]) -> dict:
    """How well the other columns tell where a column is missing: accuracy and balanced accuracy of a logistic model."""
    held = VectorAssembler(inputCols=list(others), outputCol="features").transform(filled(df.withColumn("label", q(column).isNull().cast("double")), others))
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    if len(counts) < 2 or sum(counts.values()) <= 20:
        return {"accuracy": 0.5, "balanced_accuracy": 0.5}
    out = LogisticRegression(maxIter=30).fit(held).transform(held)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out)
    recalls = out.groupBy("label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("r")).collect()
    return {"accuracy": accuracy, "balanced_accuracy": sum(r["r"] for r in recalls) / len(recalls)}


def classify_mechanism(accuracy: float, significant_share: float, mean_p: float, alpha: float = 0.05) -> tuple[str, float]:
    """MCAR, MAR or MNAR with a confidence, from predictability (balanced accuracy, say) and t-tests."""
    if accuracy > 0.7:
        return "MAR", accuracy
    if significant_share < 0.2 and mean_p > alpha:
        return "MCAR", 1 - significant_share
    return ("MAR", significant_share) if significant_share > 0.5 else ("MNAR", 0.6)


def reservoir(items: Iterator, k: int, seed: int = 42) -> list:
    """k items of an iterator of unknown length, each as likely as any."""
    rng, held = random.Random(seed), []
    for n, x in enumerate(items):
        if n < k:
            held.append(x)
        elif (at := rng.randint(0, n)) < k:
            held[at] = x
    return held
