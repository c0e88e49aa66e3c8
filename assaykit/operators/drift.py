"""Drift between a baseline and a current table.

Both sides are tagged and scanned together; histograms come from bin edges and conditional counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import num, q
from ..functions.distributions import chi2_sf, ks_p
from ..functions.exprs import div, ladder
from ..plans.fuse import fused, long_values, row
from ..plans.ordering import bucket_of, prefix_sums
from ..plans.ranks import Histogram, exact_quantiles

EPS = 1e-10


def tagged(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    side = lambda df, s: df.select(*(q(c) for c in cols), F.lit(s).alias("__side"))
    return side(baseline, "baseline").unionByName(side(current, "current"))


def _shares(counts: DataFrame, by: str, of: DataFrame | None = None) -> DataFrame:
    """base and cur counts of each bin or value."""
    return counts.groupBy(by).agg(F.sum(F.when(F.col("__side") == "baseline", F.col("n")).otherwise(0)).alias("base"), F.sum(F.when(F.col("__side") == "current", F.col("n")).otherwise(0)).alias("cur"))


def _histogram(both: DataFrame, at: Column, bins: int) -> DataFrame:
    """Counts of every bin, empty ones too, with the totals of the sides."""
    counts = _shares(both.groupBy(at.alias("bin"), "__side").agg(F.count("*").alias("n")), "bin")
    every = both.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").fillna(0)
    totals = full.agg(F.sum("base").cast("double").alias("nb"), F.sum("cur").cast("double").alias("nc")).withColumn("one", F.lit(1))
    return full.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")


def psi(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over quantile bins of the baseline, closed on the right, widened to hold both sides."""
    held = tagged(baseline, current, [column]).select(num(column).alias("x"), "__side").where("x is not null")
    in_base = F.when(F.col("__side") == "baseline", F.col("x"))
    edges = sorted(set(exact_quantiles(held.select(in_base.alias("x")), ["x"], [i / bins for i in range(bins + 1)])["x"]) - {None})
    inner = edges[1:-1]
    full = _histogram(held, bucket_of(F.col("x"), inner), len(inner) + 1)
    p, c = div(F.col("base"), F.col("nb")) + EPS, div(F.col("cur"), F.col("nc")) + EPS
    return full.agg(F.sum((c - p) * F.ln(c / p)).alias("psi"), F.count("*").alias("n_bins")).select(F.lit(column).alias("feature"), "psi", "n_bins", (F.col("psi") > 0.2).alias("drift"))


def ks(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic; running totals are summed over ranges of distinct values."""
    held = tagged(baseline, current, [column]).select(num(column).alias("x"), "__side").where("x is not null")
    counts = held.groupBy("x").agg(F.count_if(F.col("__side") == "baseline").alias("b"), F.count_if(F.col("__side") == "current").alias("c"))
    run = prefix_sums(counts, "x", {"cb": F.col("b"), "cc": F.col("c")})
    # the last running totals are the sizes of the sides
    sizes = counts.agg(F.sum("b").cast("double").alias("nb"), F.sum("c").cast("double").alias("nc")).withColumn("one", F.lit(1))
    met = run.withColumn("one", F.lit(1)).join(F.broadcast(sizes), "one")
    got = met.agg(F.max(F.abs(F.col("cb") / F.col("nb") - F.col("cc") / F.col("nc"))).alias("ks_stat"), F.first("nb").cast("long").alias("n_baseline"), F.first("nc").cast("long").alias("n_current"))
    return got.select(F.lit(column).alias("feature"), "ks_stat", "n_baseline", "n_current")


def _js(shares: DataFrame) -> Column:
    p, c = F.col("p"), F.col("c")
    m = (p + c) / 2
    return F.sqrt(F.greatest(F.sum(F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(c > 0, c * F.ln(c / m)).otherwise(0.0)) / 2, F.lit(0.0)))


def js_numeric(baseline: DataFrame, current: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Jensen-Shannon distance over equal-width bins that both sides share."""
    held = tagged(baseline, current, [column]).select(num(column).alias("x"), "__side").where("x is not null")
    r = held.agg(F.min("x"), F.max("x")).first()
    lo, hi = float(r[0]), float(r[1])
    at = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1)) if hi > lo else F.lit(0)
    full = _histogram(held, at, bins).select((F.col("base") / F.col("nb") + EPS).alias("p"), (F.col("cur") / F.col("nc") + EPS).alias("c"))
    sums = full.agg(F.sum("p").alias("sp"), F.sum("c").alias("sc")).withColumn("one", F.lit(1))
    norm = full.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one").select((F.col("p") / F.col("sp")).alias("p"), (F.col("c") / F.col("sc")).alias("c"))
    return norm.agg(_js(norm).alias("js_distance")).select(F.lit(column).alias("feature"), "js_distance", (F.col("js_distance") > 0.1).alias("drift"))


def category_shares(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """value, base, cur, nb, nc."""
    held = tagged(baseline, current, [column]).select(q(column).cast("string").alias("value"), "__side").where("value is not null")
    counts = _shares(held.groupBy("value", "__side").agg(F.count("*").alias("n")), "value")
    totals = counts.agg(F.sum("base").cast("double").alias("nb"), F.sum("cur").cast("double").alias("nc")).withColumn("one", F.lit(1))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").drop("one")


def chi2(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Chi-square of the current counts (plus 1) against the baseline's, scaled to the same total."""
    both = category_shares(baseline, current, column).select((F.col("cur") + 1.0).alias("o"), (F.col("base") + 1.0).alias("e"))
    sums = both.agg(F.sum("o").alias("so"), F.sum("e").alias("se")).withColumn("one", F.lit(1))
    met = both.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one").withColumn("x", F.col("e") * F.col("so") / F.col("se"))
    return met.agg(F.sum((F.col("o") - F.col("x")) ** 2 / F.col("x")).alias("chi2"), (F.count("*") - 1).alias("dof")).select(F.lit(column).alias("feature"), "chi2", "dof")


def js_categorical(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    both = category_shares(baseline, current, column).select((F.col("base") / F.col("nb")).alias("p"), (F.col("cur") / F.col("nc")).alias("c"))
    return both.agg(_js(both).alias("js_distance")).select(F.lit(column).alias("feature"), "js_distance", (F.col("js_distance") > 0.1).alias("drift"))


def category_changes(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values that only one side has."""
    both = category_shares(baseline, current, column)
    return both.where("base = 0 or cur = 0").select(F.lit(column).alias("feature"), "value", F.when(F.col("base") == 0, "new").otherwise("missing").alias("change"))


def side_stats(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    both = tagged(baseline, current, cols).withColumnRenamed("__side", "side")
    sums = fused(both, [row(feature=F.lit(c), n=F.count(num(c)), mean=F.avg(num(c)), std=F.stddev_samp(num(c)), min_value=F.min(num(c)), max_value=F.max(num(c))) for c in cols], by=["side"])
    mids = Histogram(both, cols, ["side"]).quantiles([0.5]).select("side", "feature", F.col("at")[0].alias("median"))
    return sums.join(mids, ["side", "feature"], "left").select("side", "feature", "n", "mean", "std", "median", "min_value", "max_value")


def concept(baseline: DataFrame, current: DataFrame, target: str, limit: float = 0.1) -> DataFrame:
    """Change of the share of each class of a categorical target."""
    both = category_shares(baseline, current, target)
    change = F.abs(div(F.col("cur"), F.col("nc")) - div(F.col("base"), F.col("nb")))
    return both.select("value", div(F.col("base"), F.col("nb")).alias("baseline_share"), div(F.col("cur"), F.col("nc")).alias("current_share"), change.alias("change"), (change > limit).alias("drift"))


def drift_score(metrics: dict[str, float]) -> float:
    """0 to 100: mean of the metrics that are there, each scaled to its own alarm."""
    parts = []
    if metrics.get("psi") is not None:
        parts.append(min(metrics["psi"] / 0.25, 1.0))
    if metrics.get("ks_pvalue") is not None:
        parts.append(1 - metrics["ks_pvalue"])
    if metrics.get("js_distance") is not None:
        parts.append(min(metrics["js_distance"] / 0.5, 1.0))
    if metrics.get("chi_square_pvalue") is not None:
        parts.append(1 - metrics["chi_square_pvalue"])
    return 100 * sum(parts) / len(parts) if parts else 0.0


def severity(score: float) -> str:
    return next((name for limit, name in ((10, "none"), (30, "low"), (50, "medium"), (70, "high")) if score < limit), "critical")


def severity_column(score: Column) -> Column:
    return ladder(score, [(10.0, "none"), (30.0, "low"), (50.0, "medium"), (70.0, "high")], "critical")


def analyze(baseline: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    """All drift metrics of the given columns, scores, severities and alerts."""
    out: dict = {"features": {}}
    for c in numeric:
        m = {"psi": psi(baseline, current, c).first()["psi"], "js_distance": js_numeric(baseline, current, c).first()["js_distance"]}
        r = ks(baseline, current, c).first()
        m |= {"ks_statistic": r["ks_stat"], "ks_pvalue": ks_p(r["ks_stat"], r["n_baseline"], r["n_current"])}
        alerts = [n for n, hit in (("psi", m["psi"] > 0.2), ("ks", m["ks_pvalue"] < 0.05), ("js", m["js_distance"] > 0.1)) if hit]
        out["features"][c] = m | {"alerts": alerts}
    for c in categorical:
        r = chi2(baseline, current, c).first()
        m = {"chi_square": r["chi2"], "chi_square_pvalue": chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0, "js_distance": js_categorical(baseline, current, c).first()["js_distance"]}
        new = category_changes(baseline, current, c).where("change = 'new'").limit(20).collect()
        alerts = [n for n, hit in (("chi_square", m["chi_square_pvalue"] < 0.05), ("js", m["js_distance"] > 0.1), ("new_categories", bool(new))) if hit]
        out["features"][c] = m | {"new_categories": [x["value"] for x in new], "alerts": alerts}
    for m in out["features"].values():
        m["score"] = drift_score(m)
        m["severity"] = severity(m["score"])
    scores = [m["score"] for m in out["features"].values()]
    out["overall_score"] = sum(scores) / len(scores) if scores else 0.0
    out["severity"] = severity(out["overall_score"])
    return out


def long_counts(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, value, side counts of several categorical columns in one scan."""
    return long_values(tagged(baseline, current, cols), cols, keep=["__side"]).groupBy("feature", "value", "__side").agg(F.count("*").alias("n"))
