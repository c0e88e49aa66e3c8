"""Exact order statistics from counts of distinct values: sorted ranges, running counts only where a wanted rank lies."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import q
from .ordering import checkpointed


class Histogram:
    """Counts of the distinct non-null values of numeric columns, for each group of by, in sorted ranges.

    The table is read once and shuffled as (column, value) counts; no task holds all values of a column. Groups of by
    may be null.
    """

    def __init__(self, df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()):
        self.cols, self.by = list(cols), list(by)
        keys = [F.col(f"__b{i}") for i in range(len(by))]
        entries = F.array(*(F.struct(F.lit(c).alias("__f"), q(c).cast("double").alias("__v")) for c in cols))
        long = df.select(*(q(b).alias(f"__b{i}") for i, b in enumerate(by)), F.inline(entries)).where(F.col("__v").isNotNull())
        counts = long.select(F.struct("__f", *keys).alias("__g"), "__v").groupBy("__g", "__v").agg(F.count("*").alias("__n"))
        spread = counts.repartitionByRange("__g", "__v").sortWithinPartitions("__g", "__v")
        self.held = checkpointed(spread.withColumn("__part", F.spark_partition_id()))
        group, so_far = Window.partitionBy("__g"), Window.partitionBy("__g").orderBy("__part")
        totals = self.held.groupBy("__g", "__part").agg(F.sum("__n").alias("__k"))
        self.ranges = totals.select("__g", "__part", "__k", (F.sum("__k").over(so_far) - F.col("__k")).alias("__before"), F.sum("__k").over(group).alias("__all"))

    def _named(self, df: DataFrame, *more: Column | str) -> DataFrame:
        return df.select(*(F.col(f"__g.__b{i}").alias(b) for i, b in enumerate(self.by)), F.col("__g.__f").alias("feature"), *more)

    def _at(self, ranks: Column) -> DataFrame:
        """__g, __all and a map from each wanted rank (from 0; ranks may use __g and __all) to its value."""
        near = self.ranges.withColumn("__r", F.array_distinct(ranks)).withColumn("__r", F.filter("__r", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__k"))))
        near = near.where(F.size("__r") > 0).select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), "__before", "__all", "__r")
        both = self.held.join(near, (F.col("__g") == F.col("__h")) & (F.col("__part") == F.col("__p")))
        upto = F.col("__before") + F.sum("__n").over(Window.partitionBy("__g", "__part").orderBy("__v"))
        met = both.withColumn("__to", upto).withColumn("__r", F.filter("__r", lambda r: (r >= F.col("__to") - F.col("__n")) & (r < F.col("__to")))).where(F.size("__r") > 0)
        found = met.select("__g", "__all", "__v", F.explode("__r").alias("__r"))
        return found.groupBy("__g", "__all").agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"))

    def quantiles(self, points: Sequence[float]) -> DataFrame:
        """Group columns, feature, n and the exact quantiles with linear interpolation; columns without values have no row."""
        place = lambda p: F.lit(float(p)) * (F.col("__all") - 1)
        low, high = (lambda p: F.floor(place(p)).cast("long")), (lambda p: F.ceil(place(p)).cast("long"))
        got = self._at(F.array(*(f(p) for p in points for f in (low, high))))

        def value(p: float) -> Column:
            a, b = F.element_at("__m", low(p)), F.element_at("__m", high(p))
            return F.when(a == b, a).otherwise((high(p) - place(p)) * a + (place(p) - low(p)) * b)

        return self._named(got, F.col("__all").alias("n"), F.array(*(value(p) for p in points)).alias("at"))

    def grid(self, k: int) -> dict[str, list[float]]:
        """The exact quantiles at 0, 1 / k, ..., 1 of each column that has values, with linear interpolation; without groups of by."""
        place = lambda i: i * (F.col("__all") - 1) / F.lit(float(k))
        ranks = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.array(F.floor(place(i)).cast("long"), F.ceil(place(i)).cast("long")))
        out = {}
        for r in self._named(self._at(F.flatten(ranks)), F.col("__all").alias("n"), F.col("__m").alias("m")).collect():
            at, last = dict(r["m"]), r["n"] - 1
            places = [i * last / float(k) for i in range(k + 1)]
            out[r["feature"]] = [at[lo] + (p - lo) * (at[math.ceil(p)] - at[lo]) for p in places for lo in (math.floor(p),)]
        return out

    def modes(self) -> DataFrame:
        """Group columns, feature and the most frequent value (ties: the smallest)."""
        got = self.held.groupBy("__g").agg(F.max(F.struct("__n", (-F.col("__v")).alias("__v"))).alias("__m"))
        return self._named(got, (-F.col("__m.__v") + F.lit(0.0)).alias("mode"))

    def filled_medians(self, fills: Mapping[str, Mapping[str, float | None]], missing: Mapping[str, int]) -> dict[tuple[str, str], float]:
        """Median of each column with its missing values filled, by (column, name of the fill); without groups of by."""
        wanted = [(c, m, float(v)) for c, named in fills.items() for m, v in named.items() if v is not None]
        if not wanted:
            return {}
        here = lambda c: F.col("__g.__f") == c
        sums = [F.struct(F.coalesce(F.sum(F.when(here(c) & (F.col("__v") < v), F.col("__n"))), F.lit(0)), F.coalesce(F.sum(F.when(here(c) & (F.col("__v") <= v), F.col("__n"))), F.lit(0)), F.sum(F.when(here(c), F.col("__n")))) for c, _, v in wanted]
        counted = self.held.agg(F.array(*sums).alias("s")).first()["s"]
        plan, ranks = [], {c: set() for c in fills}
        for (c, m, v), (below, upto, n) in zip(wanted, counted):
            size = (n or 0) + missing[c]
            pair = []
            for r in ((size - 1) // 2, size // 2):
                own = r if r < below else r - missing[c] if r >= upto + missing[c] else None
                pair.append(own)
                ranks[c] |= {own} - {None}
            plan.append((c, m, v, pair))
        lists = reduce(lambda other, c: F.when(here(c), F.array(*(F.lit(r).cast("long") for r in sorted(ranks[c])))).otherwise(other), [c for c in ranks if ranks[c]], F.array().cast("array<bigint>"))
        at = {r["feature"]: dict(r["m"]) for r in self._named(self._at(lists), F.col("__m").alias("m")).collect()}
        return {(c, m): sum(v if r is None else at[c][r] for r in pair) / 2 for c, m, v, pair in plan}


def exact_quantiles(df: DataFrame, cols: Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column; nulls for a column without values."""
    got = {r["feature"]: list(r["at"]) for r in Histogram(df, cols).quantiles(points).collect()} if cols else {}
    return {c: got.get(c, [None] * len(points)) for c in cols}


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
