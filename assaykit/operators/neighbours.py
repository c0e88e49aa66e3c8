"""Operators on exact nearest neighbours of all rows: local outlier factor, gaps filled from donors, information by neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import num, q
from ..plans.fuse import fused, row
from ..plans.neighbours import counts_upto, knn_join, own_neighbours, own_sums, taken
from ..plans.ordering import checkpointed, numbered
from .modelling import _above, _standard

#: Steps of a standard deviation in which coordinates are counted where distances are compared with each other.
FINE = float(1 << 36)


def _places(rows: DataFrame, key: str, x: str = "x") -> DataFrame:
    """One row for each distinct x: id (by the smallest key), x, weight (rows)."""
    each = rows.groupBy(x).agg(F.count("*").alias("weight"), F.min(key).alias("__first"))
    return checkpointed(numbered(each, ["__first", x], "id").select("id", F.col(x).alias("x"), "weight"))


def local_outliers(df: DataFrame, key: str, cols: Sequence[str], neighbours: int = 20, contamination: float = 0.05) -> DataFrame:
    """Local outlier factor of every row among all rows: row_key, score, is_outlier (the share contamination of largest scores).

    Columns are filled by medians and standardised. A row's neighbours are the k nearest other rows, k being neighbours or
    a fifth of the rows, 5 at least; of rows equally far, those of the smaller key. Equal rows are combined first and count
    as often as they occur, so they cost one search.
    """
    z = _standard(df, cols).select(q(key).alias("row_key"), F.array(*(num(c) + 0.0 for c in cols)).alias("x"))
    rows = checkpointed(z)
    n = rows.count()
    k = max(1, min(max(5, min(neighbours, n // 5)), n - 1))
    places = _places(rows, "row_key")
    state, lists = own_neighbours(places, k)
    dense = own_sums(state, lists, k, "kdist", above=True).withColumn("density", 1 / (F.col("s") / k + 1e-10)).drop("s")
    summed = own_sums(checkpointed(dense), lists, k, "density")
    of = summed.select("x", F.coalesce(F.col("s") / k / F.col("density"), F.lit(1.0)).alias("score"))
    return _above(rows.join(of, "x").select("row_key", "score"), contamination)


def _has(pattern: int, n: int) -> list[int]:
    return [i for i in range(n) if not pattern >> i & 1]


def knn_impute(df: DataFrame, key: str, cols: Sequence[str], neighbours: int = 5) -> DataFrame:
    """Gaps filled by the mean of the nearest donors among all rows: key and the columns.

    A donor of a column has a value there. Distances go over the columns that both rows have, scaled by the share of
    these; of donors equally far, those of the smallest keys give. A row that shares no column with any donor gets the
    column's mean, and a column without values stays empty. Rows are searched by pattern of gaps: one join for each pair
    of patterns that occur, so work grows with the patterns, not with the square of the rows.
    """
    n = len(cols)
    mask = reduce(lambda a, b: a + b, (F.when(num(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols))).cast("long")
    rows = checkpointed(df.select(q(key), *(num(c).alias(c) for c in cols)).withColumns({"__mask": mask, "__row": F.monotonically_increasing_id()}))
    patterns = sorted(r[0] for r in rows.select("__mask").distinct().collect())
    means = rows.agg(*(F.avg(q(c)).alias(c) for c in cols)).first()
    out = rows.where("__mask = 0").select(q(key), *(q(c) for c in cols))
    for p in (p for p in patterns if p):
        asking, parts = rows.where(F.col("__mask") == p), []
        for d in patterns:
            shared, gives = [i for i in _has(p, n) if i in _has(d, n)], [i for i in _has(d, n) if p >> i & 1]
            if shared and gives:
                parts.append(_donated(asking, rows.where(F.col("__mask") == d), key, [cols[i] for i in shared], [cols[i] for i in gives], n, neighbours))
        filled = {c: q(c) for c in cols}
        for i in (i for i in range(n) if p >> i & 1):
            own = [part.select("__row", "dist", "giver", q(cols[i]).alias("v")) for part, names in parts if cols[i] in names]
            mean = F.lit(means[cols[i]]).cast("double")
            filled[cols[i]] = mean
            if own:
                nearest = F.slice(F.array_sort(F.collect_list(F.struct("dist", "giver", "v"))), 1, neighbours)  # of at most neighbours rows for each pair of patterns
                got = reduce(DataFrame.unionByName, own).groupBy("__row").agg(nearest.alias("near"))
                value = F.aggregate("near", F.lit(0.0), lambda s, e: s + e["v"]) / F.size("near")
                asking = asking.join(got.select("__row", value.alias(f"__v{i}")), "__row", "left")
                filled[cols[i]] = F.coalesce(F.col(f"__v{i}"), mean)
        out = out.unionByName(asking.select(q(key), *(filled[c].alias(c) for c in cols)))
    return out


def _donated(asking: DataFrame, donors: DataFrame, key: str, shared: list[str], gives: list[str], n: int, k: int) -> tuple[DataFrame, list[str]]:
    """__row, dist, giver and the given columns of the k nearest donors of each asking row; donors at one place give in the order of keys."""
    x = F.array(*(q(c) + 0.0 for c in shared))
    place = Window.partitionBy("x").orderBy("giver", *(f"__g{i}" for i in range(len(gives))))
    first = donors.select(x.alias("x"), q(key).alias("giver"), *(q(c).alias(f"__g{i}") for i, c in enumerate(gives)))
    first = first.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k)  # no more of a place are ever needed
    held = first.groupBy("x").agg(F.min("giver").alias("__first"), F.collect_list(F.struct("giver", *(F.col(f"__g{i}").alias(c) for i, c in enumerate(gives)))).alias("donors"))
    points = checkpointed(numbered(held, ["__first", "x"], "id"))
    places = checkpointed(numbered(asking.select(x.alias("x")).distinct(), ["x"], "qid"))
    near = knn_join(places, points.select("id", "x", F.lit(1).cast("long").alias("weight")), k)
    met = near.select("qid", F.inline("near")).join(points.select("id", "donors"), "id").select("qid", (F.col("dist") * (n / len(shared)) ** 0.5).alias("dist"), F.inline("donors"))
    order = Window.partitionBy("qid").orderBy("dist", "giver", *(q(c) for c in gives))
    best = met.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")
    rows = asking.select("__row", x.alias("x")).join(places, "x").join(best, "qid")
    return rows.select("__row", "dist", "giver", *(q(c) for c in gives)), gives


def digamma(n: Column) -> Column:
    """Of a whole number from 1: sums below 8, the asymptotic series above."""
    sums = [-0.5772156649015329]
    for i in range(1, 7):
        sums.append(sums[-1] + 1 / i)
    x = n.cast("double")
    r = 1 / (x * x)
    return F.when(n < 8, F.get(F.array(*(F.lit(s) for s in sums)), (n - 1).cast("int"))).otherwise(F.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252)))


def neighbour_information(df: DataFrame, features: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """Information of each numeric feature with a numeric target by k nearest neighbours, over all rows that have both:
    feature, n, mi (nats), normalised (min(mi / 2, 1)).

    The distance to a row's k-th neighbour in the maximum norm of the standardised pair comes from the neighbour join; how
    many rows lie nearer in either column alone comes from running counts over sorted ranges. Coordinates are whole
    multiples of 2^-36 standard deviations, so that nearer and equally far are told apart exactly. Fewer than 10 rows have
    no information.
    """
    at = {r["feature"]: r for r in fused(df.where(num(target).isNotNull()), [
        row(feature=F.lit(c), n=F.count(num(c)), mx=F.avg(num(c)), sx=F.stddev_samp(num(c)), my=F.avg(F.when(num(c).isNotNull(), num(target))), sy=F.stddev_samp(F.when(num(c).isNotNull(), num(target)))) for c in features
    ]).collect()}
    parts = []
    for c in features:
        s = at[c]
        if s["n"] < max(10, k + 2):
            parts.append(df.sparkSession.createDataFrame([(c, s["n"], 0.0)], "feature string, n long, mi double"))
            continue
        fine = lambda v, m, d: F.round((v - F.lit(m)) / F.lit(d or 1.0) * FINE)
        both = df.where(num(c).isNotNull() & num(target).isNotNull()).select(F.array(fine(num(c), s["mx"], s["sx"]) + 0.0, fine(num(target), s["my"], s["sy"]) + 0.0).alias("x"))
        places = checkpointed(numbered(both.groupBy("x").agg(F.count("*").alias("weight")), ["x"], "id"))
        near = knn_join(places.select(F.col("id").alias("qid"), "x"), places, k + 1, "max")
        reach = near.select("qid", F.element_at(taken(k, own="qid"), -1)["dist"].alias("reach")).join(places.withColumnRenamed("id", "qid"), "qid")
        reach = checkpointed(reach)
        total = F.lit(0.0)
        for side in (0, 1):
            data = places.groupBy(F.col("x")[side].alias("v")).agg(F.sum("weight").alias("weight"))
            ends = F.array(F.struct(F.lit(0).alias("which"), (F.col("x")[side] - F.col("reach")).alias("v")), F.struct(F.lit(1).alias("which"), (F.col("x")[side] + F.col("reach") - 1).alias("v")))
            counted = counts_upto(data, reach.where("reach > 0").select("qid", F.inline(ends)))
            inside = counted.groupBy("qid").agg(F.sum(F.when(F.col("which") == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"n{side}"))
            reach = reach.join(inside, "qid", "left")
            total = total + digamma(F.coalesce(f"n{side}", F.lit(1)))  # the row itself is among them, and alone where k rows equal it
        n = F.lit(s["n"])
        mi = digamma(F.lit(k)) + digamma(n) - F.sum(total * F.col("weight")) / n
        parts.append(reach.agg(F.greatest(mi, F.lit(0.0)).alias("mi")).select(F.lit(c).alias("feature"), n.cast("long").alias("n"), "mi"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("normalised", F.least(F.col("mi") / 2, F.lit(1.0)))
