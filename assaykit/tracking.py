"""Experiment records, data fingerprints, configuration and timing."""

from __future__ import annotations

import copy
import functools
import json
import os
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"missing": {"high_pct": 50.0}, "outlier": {"iqr": 1.5, "zscore": 3.0}, "drift": {"psi": 0.2, "js": 0.1, "alpha": 0.05}, "leakage": {"correlation": 0.95}}


def fingerprint(df: DataFrame) -> str:
    """A digest of all rows that does not depend on their order."""
    h = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{r['n']}-{int(r['s'] or 0) & (2**64 - 1):016x}-{(r['x'] or 0) & (2**64 - 1):016x}"


@dataclass
class Experiment:
    name: str
    data: str
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    at: float = field(default_factory=time.time)

    def save(self, folder: str) -> str:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{self.name}-{int(self.at * 1000)}.json")
        with open(path, "w") as f:
            json.dump(asdict(self), f)
        return path


class Config:
    """Nested settings with dotted access; each instance has its own copy of the defaults."""

    def __init__(self, path: str | None = None):
        self.values, self.path = copy.deepcopy(DEFAULTS), path
        if path and os.path.exists(path):
            with open(path) as f:
                self.merge(json.load(f))

    def get(self, name: str, default=None):
        at = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value) -> None:
        *parents, last = name.split(".")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def merge(self, other: dict, into: dict | None = None) -> None:
        into = self.values if into is None else into
        for k, v in other.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                self.merge(v, into[k])
            else:
                into[k] = v

    def save(self) -> None:
        with open(self.path, "w") as f:
            json.dump(self.values, f)


def timed(func):
    """Keeps the seconds of the last call as func.seconds."""

    @functools.wraps(func)
    def run(*args, **kwargs):
        began = time.time()
        try:
            return func(*args, **kwargs)
        finally:
            run.seconds = time.time() - began

    run.seconds = None
    return run
