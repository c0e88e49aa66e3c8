"""The assessment pipeline: ordered steps over one table, with recommendations, alerts and exports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .columns import CATEGORICAL, NUMERIC, columns_of, infer_task, normalise_missing
from .operators import drift, ensemble, fairness, features, leakage, leakage_report, missing, modelling, outlier, profile
from .reports import html_report, text_report
from .sources.loader import plain, write_json


#: Rows of one table in a report.
REPORTED = 1000


@dataclass
class Step:
    module: str
    name: str
    config: dict = field(default_factory=dict)
    enabled: bool = True


@dataclass
class Result:
    steps: dict = field(default_factory=dict)
    recommendations: list = field(default_factory=list)
    alerts: list = field(default_factory=list)
    errors: dict = field(default_factory=dict)
    seconds: float = 0.0

    def summary(self) -> dict:
        return {"steps": len(self.steps), "failed": len(self.errors), "recommendations": len(self.recommendations), "alerts": len(self.alerts), "seconds": self.seconds}


def _all(df: DataFrame) -> list[dict]:
    """Rows of a result that has a few for each column."""
    return [plain(r) for r in df.collect()]


def _rows(df: DataFrame, limit: int = REPORTED) -> list[dict]:
    """Rows for a report; where a result has more than limit, the last one says so."""
    got = [plain(r) for r in df.limit(limit + 1).collect()]
    return got if len(got) <= limit else [*got[:limit], {"truncated": f"more than {limit} rows; call the operator for all"}]


def _completeness(df, target, **_):
    per = missing.by_column(df)
    return {"by_column": _rows(per), "score": _rows(missing.score(df, target))[0], "recommendations": _rows(missing.recommendations(per))}


def _distribution(df, target, **_):
    nums = columns_of(df, NUMERIC)
    out = {"numeric": _rows(profile.numeric_summary(df, nums))} if nums else {}
    cats = columns_of(df, CATEGORICAL)
    return out | ({"categorical": _rows(profile.categorical_summary(df, cats))} if cats else {})


def _outliers(df, target, key=None, methods=ensemble.METHODS, context=None, **_):
    """Fences and z-scores by column; with a key column also the votes of all detectors."""
    nums = columns_of(df, NUMERIC, but=tuple(c for c in (target, key) if c))
    out = {"iqr": _rows(outlier.iqr_outliers(df, nums)), "zscore": _rows(outlier.zscore_outliers(df, nums))}
    if key:
        got = ensemble.detect(df, key, nums, methods, context=context)
        out |= {"summary": got["summary"], "by_method": _all(got["by_method"]), "outliers": _rows(got["rows"].where("is_outlier").orderBy("row_key"))}
        out |= {"contextual": _rows(got["contextual"])} if "contextual" in got else {}
    return out


def _drift(df, target, baseline=None, **_):
    if baseline is None:
        raise ValueError("drift needs a baseline")
    base = normalise_missing(baseline)
    both = [c for c in df.columns if c in base.columns and c != target]
    return drift.analyze(base, df, [c for c in columns_of(df, NUMERIC) if c in both], [c for c in columns_of(df, CATEGORICAL) if c in both])


def _leakage(df, target, as_of=None, train=None, entity=None, **_):
    """One table's report; with a training table also what passes between the two."""
    report = leakage_report.table_report(df, target, as_of)
    found = _all(report["findings"])
    kinds = {"perfect_correlations": "perfect_correlation", "duplicates": "duplicate", "predictors": "perfect_predictor", "suspicious_names": "suspicious_name", "temporal": "temporal"}
    out = {"findings": found, **{name: [f for f in found if f["kind"] == kind] for name, kind in kinds.items()}, "counts": report["counts"], "target": report["target"], "score": report["score"], "recommendations": [{"advice": r} for r in report["recommendations"]]}
    if train is not None:
        between = leakage.detect_all(normalise_missing(train), df, target, entity)
        out["between"] = {"findings": _all(between), "severities": _all(leakage.severity_counts(between))[0]}
    return out


def _fairness(df, target, protected=(), **_):
    if not target:
        raise ValueError("fairness needs a target")
    out = {"imbalance": _rows(fairness.class_imbalance(df, target))[0], "groups": {}}
    biased = False
    for g in protected:
        rates = fairness.group_rates(df, g, target)
        p = _rows(fairness.parity(rates))[0]
        biased |= bool(p["biased"])
        out["groups"][g] = {"rates": _rows(rates), "parity": p, "distances": _rows(fairness.group_distances(df, g, target))}
    if len(protected) > 1:
        out["intersections"] = _rows(fairness.intersections(df, protected[0], protected[1], target))
    out["risk"] = fairness.risk((out["imbalance"]["imbalance"] or 0) > 0.2, biased, False)
    return out


def _features(df, target, **_):
    nums = columns_of(df, NUMERIC, but=(target,) if target else ())
    return {"cardinality": _rows(profile.cardinalities(df, df.columns)), "constants": _rows(profile.constants(df, df.columns)), "variance": _rows(profile.variances(df, nums)), "correlation": _rows(features.correlation_filter(df, nums)) if nums else []}


def _explain(df, target, trees=20, **_):
    nums = columns_of(df, NUMERIC, but=(target,))
    return {"task": infer_task(df, target), "importance": _rows(modelling.forest_importance(df, nums, target, trees, 5))}


def _advice(df, target, **_):
    return {"advice": _rows(profile.advise(df))}


MODULES: dict[str, Callable] = {
    "completeness": _completeness, "distribution": _distribution, "outlier_detection": _outliers, "drift_detection": _drift, "leakage_detection": _leakage,
    "fairness": _fairness, "feature_quality": _features, "explainability": _explain, "advice": _advice,
}


class Pipeline:
    """Steps run in order over one cached, normalised table; a step that fails is reported and the rest go on."""

    def __init__(self):
        self.steps: list[Step] = []
        self.result: Result | None = None

    def add_step(self, module: str, name: str | None = None, **config) -> Pipeline:
        if module not in MODULES:
            raise ValueError(f"unknown module {module}; expected one of {', '.join(MODULES)}")
        self.steps.append(Step(module, name or module, config))
        return self

    def remove_step(self, name: str) -> Pipeline:
        self.steps = [s for s in self.steps if s.name != name]
        return self

    def enable(self, name: str, on: bool = True) -> Pipeline:
        for s in self.steps:
            if s.name == name:
                s.enabled = on
        return self

    def run(self, df: DataFrame, target: str | None = None) -> Result:
        began, out = time.time(), Result()
        held = normalise_missing(df).persist()
        for s in (s for s in self.steps if s.enabled):
            try:
                out.steps[s.name] = MODULES[s.module](held, target, **s.config)
            except Exception as e:  # a failed step is part of the result
                out.errors[s.name] = f"{type(e).__name__}: {str(e)[:300]}"
        held.unpersist()
        for name, r in out.steps.items():
            out.recommendations += [{"step": name, **x} for x in r.get("recommendations", []) + r.get("advice", [])]
            out.alerts += [{"step": name, "feature": f, "alerts": m["alerts"]} for f, m in r.get("features", {}).items() if isinstance(m, dict) and m.get("alerts")]
        out.seconds = time.time() - began
        self.result = out
        return out

    def export(self, path: str, style: str = "json") -> None:
        if self.result is None:
            raise RuntimeError("run the pipeline first")
        body = {"summary": self.result.summary(), "steps": self.result.steps, "errors": self.result.errors, "recommendations": self.result.recommendations}
        if style == "json":
            write_json(body, path)
            return
        with open(path, "w") as f:
            f.write({"html": html_report, "text": text_report}[style]("Data quality", body))


def quick_analyze(df: DataFrame, target: str | None = None, baseline: DataFrame | None = None, protected: tuple[str, ...] = ()) -> Result:
    p = Pipeline().add_step("completeness").add_step("distribution").add_step("outlier_detection").add_step("leakage_detection").add_step("advice")
    if baseline is not None:
        p.add_step("drift_detection", baseline=baseline)
    if target and protected:
        p.add_step("fairness", protected=protected)
    return p.run(df, target)
