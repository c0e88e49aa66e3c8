"""Streaming profile, drift against a baseline, alert de-duplication, sessions.

Event times without a zone are read in the session's zone first: a watermark needs a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import num, q
from ..operators import drift


def timed(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, q(ts).cast("timestamp")).withWatermark(ts, late)


def profile(stream: DataFrame, ts: str, cols: Sequence[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, gaps and moments a window; works on a static table too."""
    aggs = []
    for c in cols:
        aggs += [F.count(num(c)).alias(f"{c}_n"), F.count_if(q(c).isNull()).alias(f"{c}_missing"), F.avg(num(c)).alias(f"{c}_mean"), F.stddev_samp(num(c)).alias(f"{c}_std"), F.min(num(c)).alias(f"{c}_min"), F.max(num(c)).alias(f"{c}_max")]
    got = timed(stream, ts, late).groupBy(F.window(q(ts), width).alias("w")).agg(F.count("*").alias("n_rows"), *aggs)
    return got.select(F.unix_seconds("w.start").alias("window_start"), *(c for c in got.columns if c != "w"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    got = timed(stream, ts, late).groupBy(F.session_window(q(ts), gap).alias("w"), q(key)).agg(F.count("*").alias("n"))
    return got.select(key, F.unix_seconds("w.start").alias("session_start"), F.unix_seconds("w.end").alias("session_end"), "n")


def dedupe_alerts(stream: DataFrame, ts: str, keys: Sequence[str], window: str = "60 minutes") -> DataFrame:
    """Alerts of one kind within the window are one."""
    return timed(stream, ts, window).dropDuplicatesWithinWatermark(list(keys))


def drift_sink(baseline: DataFrame, numeric: Sequence[str], categorical: Sequence[str], handle: Callable[[dict, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the drift of each micro-batch against the baseline goes to handle."""

    def run(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            handle(drift.analyze(baseline, batch, numeric, categorical), n)

    return run
