"""Quality gates and alerts over metric tables."""

from __future__ import annotations

import json
import time
import urllib.request
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}
FAILING = ("critical", "error")


@dataclass(frozen=True)
class Check:
    metric: str
    operator: str
    threshold: float
    severity: str = "error"


def evaluate(metrics: DataFrame, checks: list[Check]) -> DataFrame:
    """metric, value against the checks: one row a check with passed (null where the metric is absent) and status."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame([(c.metric, c.operator, float(c.threshold), c.severity) for c in checks], "metric string, operator string, threshold double, severity string")
    met = rules.join(metrics.select("metric", F.col("value").cast("double").alias("value")), "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    passed = F.when(F.col("operator") == "gt", v > t).when(F.col("operator") == "lt", v < t).when(F.col("operator") == "gte", v >= t).when(F.col("operator") == "lte", v <= t).when(F.col("operator") == "eq", v == t).when(F.col("operator") == "ne", v != t)
    return met.withColumn("passed", passed).withColumn("status", F.when(v.isNull(), "skipped").when(F.col("passed"), "passed").otherwise("failed"))


class QualityGate:
    """Checks over a dict of metrics; the gate fails on failed critical or error checks."""

    def __init__(self, checks: list[Check] | None = None):
        self.checks = list(checks or [])

    def add_check(self, metric: str, operator: str, threshold: float, severity: str = "error") -> QualityGate:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}")
        self.checks.append(Check(metric, operator, threshold, severity))
        return self

    def evaluate(self, metrics: dict[str, float]) -> dict:
        results = []
        for c in self.checks:
            value = metrics.get(c.metric)
            status = "skipped" if value is None else "passed" if OPERATORS[c.operator](value, c.threshold) else "failed"
            results.append(asdict(c) | {"value": value, "status": status})
        failed = [r for r in results if r["status"] == "failed"]
        return {"passed": not any(r["severity"] in FAILING for r in failed), "results": results, "failed": failed, "exit_code": int(any(r["severity"] in FAILING for r in failed))}


def ci_check(completeness: float, missing_pct: float, leakage: float, style: str = "text") -> tuple[str, int]:
    """The pull-request gate: completeness >= 95, missing <= 10, leakage <= 30."""
    out = QualityGate([Check("completeness", "gte", 95), Check("missing_pct", "lte", 10), Check("leakage", "lte", 30)]).evaluate({"completeness": completeness, "missing_pct": missing_pct, "leakage": leakage})
    if style == "json":
        return json.dumps(out), out["exit_code"]
    mark = {"text": "[{s}] {m} = {v}", "github": "::{g} ::{m} = {v}"}[style]
    lines = [mark.format(s=r["status"], g="notice" if r["status"] == "passed" else "error", m=r["metric"], v=r["value"]) for r in out["results"]]
    return "\n".join(lines), out["exit_code"]


@dataclass
class Alert:
    title: str
    message: str
    severity: str = "warning"
    category: str = "quality"
    metric: str | None = None
    value: float | None = None
    at: float = field(default_factory=time.time)


class Channel:
    """Where alerts go; subclasses override send."""

    def send(self, alert: Alert) -> bool:
        raise NotImplementedError


class WebhookChannel(Channel):
    """Posts JSON; a dry run, the default, only keeps the payloads."""

    def __init__(self, url: str, template: str | None = None, dry_run: bool = True):
        self.url, self.template, self.dry_run, self.sent = url, template, dry_run, []

    def payload(self, alert: Alert) -> dict:
        return json.loads(self.template.format(**asdict(alert))) if self.template else asdict(alert)

    def send(self, alert: Alert) -> bool:
        body = json.dumps(self.payload(alert)).encode()
        self.sent.append(body)
        if not self.dry_run:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=10) as r:
                return r.status < 300
        return True


class SlackChannel(WebhookChannel):
    def payload(self, alert: Alert) -> dict:
        return {"text": f"[{alert.severity}] {alert.title}: {alert.message}"}


class AlertManager:
    """Thresholds, history and channels; an alert like one within the window before is not sent again."""

    def __init__(self, window_minutes: float = 60):
        self.window, self.history, self.channels, self.rules = window_minutes * 60, [], [], []

    def add_threshold(self, metric: str, operator: str, value: float, severity: str = "warning", category: str = "quality") -> None:
        self.rules.append((metric, operator, value, severity, category))

    def check(self, metrics: dict[str, float], now: float | None = None) -> list[Alert]:
        found = [
            Alert(f"{m} {op} {t}", f"{m} is {metrics[m]}", severity, category, m, metrics[m], time.time() if now is None else now)
            for m, op, t, severity, category in self.rules
            if metrics.get(m) is not None and OPERATORS[op](metrics[m], t)
        ]
        return [a for a in found if self.send(a)]

    def send(self, alert: Alert) -> bool:
        key = (alert.title, alert.severity, alert.category)
        if any((a.title, a.severity, a.category) == key and 0 <= alert.at - a.at < self.window for a in self.history):
            return False
        self.history.append(alert)
        for c in self.channels:
            c.send(alert)
        return True

    def summary(self) -> dict:
        return {"total": len(self.history), "by_severity": dict(Counter(a.severity for a in self.history)), "by_category": dict(Counter(a.category for a in self.history))}
