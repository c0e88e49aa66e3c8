"""Exact nearest neighbours of all rows among all rows: a partitioned join in three steps.

Space is cut into cells by medians of a bounded sample, so that cells hold about as many points each, and points and
queries are dealt to their cells. In its own cell a query finds k points; the distance of the k-th bounds where nearer ones
may lie. The boxes of the cells' points (one row for each cell, broadcast: there are at most MAX_CELLS) then tell which
other cells reach into that distance, and the query visits these. The nearest of all visits are merged. Within a cell,
points lie in leaves with boxes, and a run of neighbouring queries reads only the leaves that reach into its distance.

A cell that many queries visit is dealt to several tasks, each with the cell's points. Points that repeat should be
combined beforehand (with their number as weight), for no cut tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import checkpointed

#: Points of a cell, about, and the most cells; beyond, cells grow.
CELL_POINTS, MAX_CELLS = 16_384, 1 << 15
#: Sampled points for each cell, queries of one task, points of a leaf.
SAMPLED, QUERY_BLOCK, LEAF = 24, 32_768, 96


def norm(gap: np.ndarray, metric: str) -> np.ndarray:
    """Length of differences along the last axis: euclidean or max."""
    if gap.ndim == 1:  # sums are taken in place, which a number has not
        return norm(gap[None], metric)[0]
    return _length((gap[..., d] for d in range(gap.shape[-1])), metric)


def _length(gaps: Iterable[np.ndarray], metric: str) -> np.ndarray:
    """Length of differences, given side by side: a pass over whole arrays for each side."""
    out = None
    for g in gaps:
        g = np.abs(g) if metric == "max" else g * g
        out = g if out is None else np.maximum(out, g, out=out) if metric == "max" else np.add(out, g, out=out)
    return out if metric == "max" else np.sqrt(out, out=out)


def between(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, metric: str) -> np.ndarray:
    """Least distance between boxes."""
    return norm(np.maximum(np.maximum(low - other_high, other_low - high), 0), metric)


def _leaves(x: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows in groups of up to size that lie close together, by median cuts of the widest side."""
    out, stack = [], [np.arange(len(x))] if len(x) else []
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        side = int(np.argmax(np.ptp(x[rows], axis=0)))
        half = len(rows) // 2
        rows = rows[np.argpartition(x[rows, side], half)]
        stack += [rows[:half], rows[half:]]
    return out


def nearest(points: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, far: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k points nearest to each row of x (ties: the smaller id) no farther than far; -1 and inf where there are fewer."""
    at, dist = np.full((len(x), k), -1), np.full((len(x), k), np.inf)
    if not len(points) or not len(x):
        return at, dist
    leaves = _leaves(points)
    low, high = np.stack([points[r].min(0) for r in leaves]), np.stack([points[r].max(0) for r in leaves])
    sizes = np.array([len(r) for r in leaves])
    sides = np.ascontiguousarray(points.T)
    for rows in _leaves(x):
        own = x[rows]
        a, b = own.min(0), own.max(0)
        gap = between(a, b, low, high, metric)
        most = far[rows].max()
        # the farthest that a row of the run can be from a point of each leaf: leaves that hold k points bound the search
        reach = norm(np.maximum(np.abs(low - b), np.abs(high - a)), metric)
        order = np.argsort(reach)
        enough = np.searchsorted(np.cumsum(sizes[order]), k)
        if enough < len(order):
            most = min(most, reach[order[enough]])
        met = np.flatnonzero(gap <= most)
        for narrower in (True, False):  # the nearest leaves first: their k-th distances spare most of the others
            chosen = met[np.argsort(gap[met], kind="stable")]
            if narrower:
                chosen = chosen[: int(np.searchsorted(np.cumsum(sizes[chosen]), 2 * k)) + 2]
                if len(chosen) == len(met):
                    continue
            there = np.concatenate([leaves[i] for i in chosen]) if len(chosen) else np.empty(0, int)
            if not narrower and len(there):
                p = sides[:, there]
                there = there[_length((np.maximum(np.maximum(u - c, c - v), 0) for c, u, v in zip(p, a, b, strict=True)), metric) <= most]
            take = min(k, len(there))
            p = sides[:, there]
            d = _length((np.subtract.outer(o, c) for o, c in zip(own.T, p, strict=True)), metric)
            if narrower:
                if len(there) >= k:
                    # rows that have k points within far are bounded by them, the others by far
                    bound = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1], far[rows]).max()
                    most = min(most, bound)
                    met = met[gap[met] <= most]
                continue
            if not take:
                continue
            limit = np.minimum(np.partition(d, take - 1, axis=1)[:, take - 1], far[rows])
            row, col = np.nonzero(d <= limit[:, None])
            best = d[row, col]
            order = np.lexsort((ids[there[col]], best, row))  # of equal distances the smaller ids
            row, col, best = row[order], col[order], best[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < take
            at[rows[row[kept]], place[kept]] = there[col[kept]]
            dist[rows[row[kept]], place[kept]] = best[kept]
    return at, dist


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Side and value of each cut of a full binary tree; node i has children 2i + 1 (up to the value) and 2i + 2."""
    side, value = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1)
    parts = {0: sample}
    for i in range(len(side)):
        rows = parts.pop(i)
        if len(rows):
            side[i] = int(np.argmax(np.ptp(rows, axis=0)))
            value[i] = np.median(rows[:, side[i]])
        left = rows[:, side[i]] <= value[i]
        parts[2 * i + 1], parts[2 * i + 2] = rows[left], rows[~left]
    return side, value


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """The arrays of a column that has rows, all of one length."""
    return _matrix(column, len(column[0]))


def _dealt(df: DataFrame, cuts: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """With the cell of x."""
    sent = df.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, value = sent.value
        for b in batches:
            x = _matrix(b.column("x"), width)
            node = np.zeros(len(x), int)
            for _ in range((len(side) + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[np.arange(len(x)), side[node]] > value[node])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((node - len(side)).astype(np.int32))], names=[*b.schema.names, "cell"])

    return df.mapInArrow(deal, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", cell int")


_NEAR = "array<struct<dist:double,id:long,weight:long>>"


def _near_array(ids: np.ndarray, weights: np.ndarray, at: np.ndarray, dist: np.ndarray) -> pa.Array:
    there = at >= 0
    ends = np.concatenate([[0], np.cumsum(there.sum(1))])
    flat = at[there]
    parts = pa.StructArray.from_arrays([pa.array(dist[there]), pa.array(ids[flat]), pa.array(weights[flat])], names=["dist", "id", "weight"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)


class _Cells:
    """Points (id, x, weight), read several times, in their cells: held, with the column cell, and the boxes of the cells."""

    def __init__(self, points: DataFrame, n: int, metric: str):
        spark, self.metric, self.width = points.sparkSession, metric, len(points.first()["x"])
        depth = max(0, min((-(-n // CELL_POINTS) - 1).bit_length(), MAX_CELLS.bit_length() - 1))
        share = min(1.0, SAMPLED * (1 << depth) / n)
        drawn = points.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x") if depth else points.limit(0).select("x")
        sample = np.array([r["x"] for r in drawn.collect()], float).reshape(-1, self.width)  # about SAMPLED x MAX_CELLS rows at most
        self.cuts = _cuts(sample, depth)
        self.held = checkpointed(_dealt(points, self.cuts, self.width))
        sides = [f(F.col("x")[d]).alias(f"{name}{d}") for d in range(self.width) for name, f in (("low", F.min), ("high", F.max))]
        boxes = self.held.groupBy("cell").agg(F.count("*").alias("n"), *sides).orderBy("cell").collect()
        cells, counts = np.array([r["cell"] for r in boxes]), np.array([r["n"] for r in boxes])
        low, high = (np.array([[r[f"{name}{d}"] for d in range(self.width)] for r in boxes]) for name in ("low", "high"))
        self.sent = spark.sparkContext.broadcast((cells, counts, low, high))

    def met(self, asked: DataFrame, visit: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
        """What visit returns for the points of each cell and the queries that asked (qid, x, far, cell) has for it, or a share of these."""
        tasks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("tasks"))
        here = self.held.join(F.broadcast(tasks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        there = asked.join(F.broadcast(tasks), "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("tasks")).cast("int")).drop("tasks")
        return here.groupBy("cell", "block").cogroup(there.groupBy("cell", "block")).applyInArrow(visit, kinds)

    def visited(self, asked: DataFrame, k: int) -> DataFrame:
        """qid and near, of each cell that a query visits."""
        width, metric = self.width, self.metric

        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, weights, _, at, dist = _searched(left, right, k, width, metric)
            return pa.table({"qid": right.column("qid"), "near": _near_array(ids, weights, at, dist)})

        return self.met(asked, visit, f"qid long, near {_NEAR}")


def _longs(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name).to_numpy(), np.int64)


def _searched(left: pa.Table, right: pa.Table, k: int, width: int, metric: str) -> tuple[np.ndarray, ...]:
    """Ids and weights of the points, the queries, and places and distances of what is nearest to these."""
    x, far, ids = _matrix(right.column("x"), width), np.asarray(right.column("far").to_numpy(), float), _longs(left, "id")
    return ids, _longs(left, "weight"), x, *nearest(_matrix(left.column("x"), width), ids, x, k, far, metric)


def _others(x: np.ndarray, dist: np.ndarray, own: int, boxes: tuple[np.ndarray, ...], k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far a query has to look after its own cell, and the other cells that reach into that: how many a query, and all of them."""
    names, n_points, a, b = boxes
    reach = dist[:, -1].copy()
    for i in np.flatnonzero(~np.isfinite(reach)):  # too few points here: the boxes that surely hold k
        most = norm(np.maximum(np.abs(x[i] - a), np.abs(b - x[i])), metric)
        order = np.argsort(most)
        enough = int(np.searchsorted(np.cumsum(n_points[order]), k))
        if enough < len(order):
            reach[i] = most[order[enough]]
    counts, more = [np.empty(0, int)], [np.empty(0, np.int32)]
    if len(x):
        close = np.flatnonzero((between(x.min(0), x.max(0), a, b, metric) <= reach.max()) & (names != own))
        for s in range(0, len(x), 1024):
            met = between(x[s : s + 1024, None], x[s : s + 1024, None], a[close][None], b[close][None], metric) <= reach[s : s + 1024, None]
            counts.append(met.sum(1))
            more.append(names[close[np.nonzero(met)[1]]].astype(np.int32))
    return reach, np.concatenate(counts), np.concatenate(more)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _merged(parts: DataFrame, k: int) -> DataFrame:
    return parts.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def knn_join(queries: DataFrame, points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """qid and near: the k points nearest to each query, as an array of (dist, id, weight) by distance, then id.

    queries: qid (long, one row each), x (array of doubles); points: id (long, one row each), x, weight (long), read
    several times; no gaps in x. A query has fewer entries only where there are fewer points. Exact for any data; with many
    dimensions balls meet most cells, and the work tends to that of all pairs.
    """
    points, queries = points.select("id", "x", "weight"), queries.select("qid", "x")
    n = points.count()
    if not n:
        return queries.select("qid", F.array().cast(_NEAR).alias("near"))
    cells = _Cells(points, n, metric)
    width, sent = cells.width, cells.sent

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, weights, x, at, dist = _searched(left, right, k, width, metric)
        own = right.column("cell")[0].as_py() if len(x) else -1
        reach, counts, more = _others(x, dist, own, sent.value, k, metric)
        return pa.table({"qid": right.column("qid"), "near": _near_array(ids, weights, at, dist), "x": right.column("x"), "far": pa.array(reach), "more": _lists(counts, more)})

    asked = _dealt(queries, cells.cuts, width).withColumn("far", F.lit(float("inf"))).select("qid", "x", "far", "cell")
    found = checkpointed(cells.met(asked, first, f"qid long, near {_NEAR}, x array<double>, far double, more array<int>"))
    again = found.where(F.size("more") > 0).select("qid", "x", "far", F.explode("more").alias("cell"))
    both = found.where(F.size("more") > 0).select("qid", "near").unionByName(cells.visited(checkpointed(again), k))
    return found.where(F.size("more") == 0).select("qid", "near").unionByName(_merged(both, k))


def _times(at: np.ndarray, ids: np.ndarray, weights: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """How many rows of each place found are among the k rows nearest to a row of the place own; as :func:`taken`."""
    w = np.where(at >= 0, weights[at] - (ids[at] == own[:, None]), 0)
    return np.clip(k - (np.cumsum(w, axis=1) - w), 0, w)


def own_neighbours(places: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k other rows nearest to each row, rows of one place (id, x, weight; read several times) being equal.

    Returns the places (id, x, weight, cell, inner, kdist: the distance of the k-th) and the lists (id, near: entries as
    those of :func:`taken`) of places that are not inner. An inner place has all its neighbours in its own cell: its
    list is not written, as :func:`own_sums` finds it again within kdist.
    """
    n = places.count()
    if not n:
        empty = places.select("id", "x", "weight", F.lit(0).alias("cell"), F.lit(True).alias("inner"), F.lit(0.0).alias("kdist"))
        return empty, places.select("id", F.array().cast("array<struct<id:bigint,dist:double,times:bigint>>").alias("near"))
    cells = _Cells(places.select("id", "x", "weight"), n, "euclidean")
    width, sent = cells.width, cells.sent

    def search(t: pa.Table) -> pa.Table:
        x, ids, weights = _matrix(t.column("x"), width), _longs(t, "id"), _longs(t, "weight")
        at, dist = nearest(x, ids, x, k + 1, np.full(len(x), np.inf), "euclidean")
        reach, counts, more = _others(x, dist, t.column("cell")[0].as_py(), sent.value, k + 1, "euclidean")
        kdist = np.where(_times(at, ids, weights, ids, k) > 0, dist, 0.0).max(1)
        at[counts == 0] = -1
        return t.append_column("kdist", pa.array(kdist)).append_column("far", pa.array(reach)).append_column("more", _lists(counts, more)).append_column("near", _near_array(ids, weights, at, dist))

    found = checkpointed(cells.held.groupBy("cell").applyInArrow(search, f"id long, x array<double>, weight long, cell int, kdist double, far double, more array<int>, near {_NEAR}"))
    inner, outer = found.where(F.size("more") == 0), found.where(F.size("more") > 0)
    again = checkpointed(outer.select(F.col("id").alias("qid"), "x", "far", F.explode("more").alias("cell")))
    both = outer.select(F.col("id").alias("qid"), "near").unionByName(cells.visited(again, k + 1))
    lists = checkpointed(_merged(both, k + 1).select(F.col("qid").alias("id"), taken(k, own="qid").alias("near")))
    last = lists.select("id", F.coalesce(F.try_element_at("near", F.lit(-1))["dist"], F.lit(0.0)).alias("kdist"))
    state = inner.select("id", "x", "weight", "cell", F.lit(True).alias("inner"), "kdist")
    return state.unionByName(outer.drop("kdist").join(last, "id").select("id", "x", "weight", "cell", F.lit(False).alias("inner"), "kdist")), lists


def own_sums(state: DataFrame, lists: DataFrame, k: int, value: str, above: bool = False) -> DataFrame:
    """The places of :func:`own_neighbours` with s: the sum of the column value (above: of the distance, if that is larger) over the k neighbours,
    null without any."""
    names, kinds = state.columns, ", ".join(f"{c} {t}" for c, t in state.dtypes)

    def add(t: pa.Table) -> pa.Table:
        x, ids, weights = _rows(t.column("x")), _longs(t, "id"), _longs(t, "weight")
        v, far = (np.asarray(t.column(c).to_numpy(), float) for c in (value, "kdist"))
        asks = np.flatnonzero(np.asarray(t.column("inner").to_numpy(), bool))
        at, dist = nearest(x, ids, x[asks], k + 1, far[asks], "euclidean")
        times = _times(at, ids, weights, ids[asks], k)
        got = np.maximum(dist, v[at]) if above else v[at]
        s = np.where(times > 0, times * np.where(times > 0, got, 0.0), 0.0).sum(1)
        return t.take(pa.array(asks)).select(names).append_column("s", pa.array(s, mask=times.sum(1) == 0))

    of_inner = state.groupBy("cell").applyInArrow(add, f"{kinds}, s double")
    each = lists.select(F.col("id").alias("qid"), F.inline("near"))
    entry = F.greatest("dist", "v") if above else F.col("v")
    sums = each.join(state.select("id", F.col(value).alias("v")), "id").groupBy("qid").agg(F.sum(F.col("times") * entry).alias("s"))
    of_outer = state.where("not inner").join(sums.withColumnRenamed("qid", "id"), "id").select(*names, "s")
    return of_inner.unionByName(of_outer)


def taken(k: int, near: str = "near", own: str | None = None) -> Column:
    """The entries that make up the k nearest rows, each as (id, dist, times): weights count as so many rows; own: the
    query's id, of whose entry one row is the query itself."""
    weight = lambda e: e["weight"] - (e["id"] == F.col(own)).cast("long") if own else e["weight"]
    kind = "array<struct<id:bigint,dist:double,times:bigint>>"
    start = F.struct(F.lit(k).cast("bigint").alias("left"), F.expr(f"cast(array() as {kind})").alias("got"))

    def step(acc, e):
        times = F.least(weight(e), acc["left"])
        entry = F.array(F.struct(e["id"].alias("id"), e["dist"].alias("dist"), times.alias("times")))
        return F.struct((acc["left"] - times).alias("left"), F.when(times > 0, F.concat(acc["got"], entry)).otherwise(acc["got"]).alias("got"))

    return F.aggregate(F.col(near), start, step, lambda acc: acc["got"])


def counts_upto(data: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, which and n: the summed weight of the data whose value v is at most the asked value v.

    data: v, weight, one row for each value; asked: qid, which, v. Both are sorted in ranges together; a range adds the
    totals of the ranges before it, so nothing meets in one task but one row for each range.
    """
    lines = data.select("v", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("qid"), F.lit(None).cast("int").alias("which"), "weight")
    lines = lines.unionByName(asked.select("v", F.lit(1).alias("tag"), "qid", "which", F.lit(0).cast("long").alias("weight")))
    order = ["v", "tag", "qid"]  # the last splits an often asked value
    held = checkpointed(lines.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("part").agg(F.sum("weight").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    run = F.sum("weight").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.withColumn("run", run).where("tag = 1").join(F.broadcast(starts), "part").select("qid", "which", (F.col("run") + F.col("start")).alias("n"))
