"""N-gram Jaccard join: documents whose sets of word n-grams are similar, and the components of their links.

1. Texts of equal sets fall into one class; a class goes on as one set.
2. Sets are ordered globally: n-grams that are frequent somewhere come last, by level of frequency, then by hash. Two
   similar sets share c n-grams among the first ``n - ceil(t n) + c`` of either, so these prefixes are joined by n-gram
   and pairs that share fewer are dropped; c is a small part of n, so sets with a passage in common do not qualify.
3. Lists of an n-gram may hold a third of all classes, so not all their pairs are formed. First every class meets only
   the first class of its lists. Links found that way are united. Then only lists that still hold several components
   are taken up, and in them only pairs across components; that loses no link between different components.
4. Candidates are verified by a prefix-tree (:class:`Trie`): the sets that meet one class stand in a trie; its traversal
   shares the overlap of a common path and leaves a subtree as soon as the length that remains cannot make up for what
   is missing. Groups of a class are split into blocks.
5. Classes in long lists, such as a large group of near copies, are not paired as rows: their families are cut into
   blocks by size, and each two blocks of sizes that may be similar meet in one task as a trie and its probes. A class
   in fewer long lists than similar sets share is in no family, so n-grams that meet by chance join no families.

Frequencies only shape the order, which changes no result; they are counted over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, small_batches, table
from .components import linked
from .textnp import set_key, shingles, slices, word_hashes

#: N-grams buffered in a task before their frequencies are handed on, and the least local frequency that is.
BUFFER, LEAST_COUNT = 2_000_000, 2
#: Frequencies matter for n-grams that may come to stand in a prefix: so many percent of a set, by hash.
COUNTED_PCT = 40
#: N-grams whose frequency shapes the order: 2^ORDER_BITS at most are sent to the executors, the most frequent ones.
ORDER_BITS = 20
#: Prefixes are so many percent of a set longer than they need be to share one n-gram, and so must share as many.
COMMON_PCT = 5
#: Sets of one block of a verified group; a family's sizes are cut into so many blocks of them, then blocks grow up to so many n-grams.
BLOCK, FEW_BLOCKS, BLOCK_GRAMS = 256, 2, 1 << 21


def least_common(n):
    """So many n-grams at least do the prefixes of two similar sets share, if n is the size of the smaller one (an int or a column)."""
    if isinstance(n, int):
        return max(1, n * COMMON_PCT // 100)
    return F.greatest(F.lit(1), F.floor(n * COMMON_PCT / 100).cast("long"))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, offsets, data in slices(column):
        yield first, shingles(*word_hashes(data, offsets), k)


def text_hash(text_col: str) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def profile(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows of documents (id, of: a hash of the text, key of the set, n) and, with null id and n = -count, of locally frequent
    n-grams (key)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        held = 0

        def frequent() -> pa.RecordBatch:
            grams, count = np.unique(np.concatenate([*kept.values(), np.zeros(0, np.uint64)]), return_counts=True)
            grams, count = grams[count >= LEAST_COUNT], count[count >= LEAST_COUNT]
            return pa.RecordBatch.from_arrays([pa.nulls(len(grams), id_type), pa.nulls(len(grams), pa.int64()), pa.array(grams.view(np.int64)), pa.array(-count.astype(np.int64))], names=["id", "of", "key", "n"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            keys, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, sets in _sets(batch.column(2), k):
                for at, s in enumerate(sets, first):
                    keys[at], sizes[at] = key, _ = set_key(s), len(s)
                    if len(s) and key not in kept:
                        kept[key] = s[: len(s) * COUNTED_PCT // 100 + 1].copy()
                        held += len(kept[key])
                if held >= BUFFER:
                    yield frequent()
                    kept.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(sizes)], names=["id", "of", "key", "n"])
        if held:
            yield frequent()

    return docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("of"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind.simpleString()}, of long, key long, n long")


def order_hint(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by the leading 32 bits of their hash and their levels of frequency, of the most frequent 2^ORDER_BITS at most. counts: key, n."""
    levels = counts.groupBy("key").agg(F.sum("n").alias("c")).select("key", F.floor(F.log2("c") * 2).cast("int").alias("level"))
    levels = cut(levels)
    least, total = 0, 0
    for r in sorted(levels.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > 1 << ORDER_BITS:
            least = r["level"] + 1
            break
    # the leading halves of hashes and one byte a level keep what the driver holds small; a clash changes an order only
    got = levels.where(F.col("level") >= least).select(F.shiftright("key", 32).cast("int").alias("key"), F.col("level").cast("byte").alias("level")).toArrow()
    grams = got.column("key").to_numpy().view(np.uint32)
    by = np.argsort(grams).astype(np.int32)
    hint = grams[by], got.column("level").to_numpy()[by].view(np.uint8)
    del got, grams, by
    pa.default_memory_pool().release_unused()
    return hint


def ordered(s: np.ndarray, grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set, given by hash, in global order: rare first."""
    if not len(grams):
        return s
    lead = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(grams, lead), len(grams) - 1)
    level = np.where(grams[at] == lead, levels[at], 0)
    return s[np.argsort(level, kind="stable")] if level.any() else s


def prefixes(docs: DataFrame, text_col: str, k: int, num: int, den: int, hint: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The n-grams of each set's prefix: gram, key, n."""
    sent = docs.sparkSession.sparkContext.broadcast(hint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, levels = sent.value
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                seen, parts, keys, sizes = set(), [np.zeros(0, np.uint64)], [], []
                for s in sets:
                    n, key = len(s), set_key(s)
                    if n and key not in seen:
                        seen.add(key)
                        parts.append(ordered(s, grams, levels)[: n + (-n * num // den) + least_common(n)])
                        keys.append(key)
                        sizes.append(n)
                many = [len(p) for p in parts[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many))], names=["gram", "key", "n"]
                )

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "gram long, key long, n int")


def shared(rows: DataFrame) -> DataFrame:
    """The rows of n-grams that several classes have, each with the first class of its list: gram, key, n, head, head_n.

    Lists stream by in order, so a list of any length takes constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (gram, head, head's n, has the head's own row gone out)
        for batch in batches:
            gram, key, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(gram):
                continue
            fresh = np.ones(len(gram), bool)
            fresh[1:] = gram[1:] != gram[:-1]
            open_head = last is not None and gram[0] == last[0]
            fresh[0] = not open_head
            run_id = np.cumsum(fresh) - 1
            starts = np.flatnonzero(fresh)
            head, head_n = np.empty(len(gram), np.int64), np.empty(len(gram), np.int64)
            inside = run_id >= 0
            head[inside], head_n[inside] = key[starts][run_id[inside]], n[starts][run_id[inside]]
            if open_head:
                head[~inside], head_n[~inside] = last[1], last[2]
            other = key != head
            several = np.zeros(len(starts) + 1, bool)  # the last entry is that of the run carried on, run_id -1
            np.logical_or.at(several, run_id, other)
            again = np.zeros(len(gram), bool)
            again[1:] = (key[1:] == key[:-1]) & ~fresh[1:]
            out = several[run_id] & ~again & (inside | other)
            cols = [gram[out], key[out], n[out], head[out], head_n[out]]
            if open_head and several[-1] and not last[3]:
                cols = [np.append(c, x) for c, x in zip(cols, (last[0], last[1], last[2], last[1], last[2]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["gram", "key", "n", "head", "head_n"])
            if len(starts) and run_id[-1] >= 0:
                last = (gram[-1], head[-1], head_n[-1], bool(several[run_id[-1]]))
            else:
                last = (last[0], last[1], last[2], last[3] or bool(several[-1]))

    dealt = rows.repartition(F.col("gram")).sortWithinPartitions("gram", "key")
    return dealt.mapInArrow(run, "gram long, key long, n long, head long, head_n long")


class Trie:
    """Sets as paths of a prefix-tree, and the search for those similar to a probe.

    N-grams are ranked by how many of the sets hold them, most first, and every set is a path in rank order, so that
    near copies share their beginnings. Chains without branches are one edge. A search counts, edge by edge from the
    root, the n-grams that the probe lacks; all sets below an edge share that count. A subtree is left as soon as its
    path lacks more than any set below may lack, given the lengths that remain.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.grams, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(self.grams), np.int64)
        rank[np.lexsort((self.grams, -count))] = np.arange(len(self.grams))
        self.by_rank = np.argsort(rank)
        cuts = np.cumsum([0, *map(len, sets)])
        ranks = rank[inverse]
        paths = [np.sort(ranks[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        # nodes: (parent, depth, path that runs through it); node 0 is the root
        parent, depth, through = [0], [0], [0]
        self.ends = np.zeros(len(sets), np.int64)
        stack, last = [0], np.zeros(0, np.int64)
        for i in sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes()):
            path = paths[i]
            both = min(len(last), len(path))
            differs = last[:both] != path[:both]
            common = int(differs.argmax()) if differs.any() else both
            below = -1
            while depth[stack[-1]] > common:
                below = stack.pop()
            if depth[stack[-1]] < common:  # a branch in the middle of an edge
                parent.append(stack[-1])
                depth.append(common)
                through.append(through[below])
                parent[below] = len(parent) - 1
                stack.append(len(parent) - 1)
            if len(path) > common:
                parent.append(stack[-1])
                depth.append(len(path))
                through.append(i)
                stack.append(len(parent) - 1)
            self.ends[i] = stack[-1]
            last = path
        level = np.zeros(len(parent), np.int64)
        order = sorted(range(1, len(parent)), key=lambda n: depth[n])
        for n in order:
            level[n] = level[parent[n]] + 1
        order.sort(key=lambda n: level[n])
        place = np.zeros(len(parent), np.int64)
        place[order] = np.arange(1, len(parent))
        self.parent = place[np.array([parent[n] for n in order], np.int64)] if order else np.zeros(0, np.int64)
        edges = [paths[through[n]][depth[parent[n]] : depth[n]] for n in order]
        self.edge_grams = np.concatenate([*edges, np.zeros(0, np.int64)])
        self.edge_cuts = np.cumsum([0, *map(len, edges)])[:-1]
        self.levels = np.searchsorted(level[order], np.arange(1, (level.max() if order else 0) + 2)) if order else np.zeros(1, np.int64)
        self.ends = place[self.ends]
        # the largest set below each node bounds what its subtree may lack
        self.largest = np.zeros(len(parent), np.int64)
        np.maximum.at(self.largest, self.ends, self.sizes)
        for lo, hi in reversed(list(zip(self.levels[:-1], self.levels[1:], strict=True))):
            np.maximum.at(self.largest, self.parent[lo:hi], self.largest[lo + 1 : hi + 1])

    def near(self, probe: np.ndarray) -> np.ndarray:
        """Which sets have a Jaccard similarity of num/den or more with the probe (sorted by hash)."""
        m = len(probe)
        at = np.minimum(np.searchsorted(probe, self.grams), m - 1)
        missing = (probe[at] != self.grams)[self.by_rank]
        lacks = np.zeros(len(self.largest), np.int64)
        edge = np.add.reduceat(missing[self.edge_grams], self.edge_cuts) if len(self.edge_cuts) else np.zeros(0, np.int64)
        # |x & y| (den + num) >= num (|x| + |y|): a set of n may lack n - ceil(num (m + n) / (den + num)), rising with n
        may = lambda n: n - -(-self.num * (m + n) // (self.den + self.num))
        most = may(self.largest)
        for lo, hi in zip(self.levels[:-1], self.levels[1:], strict=True):
            now = lacks[self.parent[lo:hi]] + edge[lo:hi]
            now[now > most[lo + 1 : hi + 1]] = 1 << 40
            lacks[lo + 1 : hi + 1] = now
            if now.min() >= 1 << 40:
                lacks[hi + 1 :] = 1 << 40
                break
        return lacks[self.ends] <= may(self.sizes)


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The sets (key, grams) of the wanted classes, each read from one of its documents, whose id may be null."""
    ids = broadcast_if_small(classes.join(wanted, "key", "left_semi").select(F.col("first.id").alias("__id"), F.col("first.of").alias("__of")).distinct())
    rows = docs.select(F.col(id_col).alias("__i"), text_hash(text_col).alias("__o"), F.col(text_col).alias("__t"))
    texts = rows.join(ids, (F.col("__o") == F.col("__of")) & F.col("__i").eqNullSafe(F.col("__id")), "left_semi").select("__t")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "grams"])

    return texts.mapInArrow(read, "key long, grams binary")


def verify(pairs: DataFrame, read: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """The pairs (a, b) of keys that are links; read(keys) gives the sets (key, grams) of keys."""
    sets = read(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / float(BLOCK)).cast("int").alias("blocks"))
    probes = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(-1).cast("long").alias("b"), F.col("a").alias("key"))
    met = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", F.col("b").alias("key"))
    rows = sets.join(broadcast_if_small(probes.union(met)), "key").select("a", "block", "b", "grams")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, probe, others, found = None, None, {}, []

        def close() -> None:
            if others and probe is not None:
                names = list(others)
                near = Trie([others[x] for x in names], num, den).near(probe)
                found.extend((group[0], b) for b, hit in zip(names, near, strict=True) if hit)

        for batch in batches:
            for a, block, b, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (a, block) != group:
                    close()
                    group, probe, others = (a, block), None, {}
                s = np.frombuffer(grams.as_buffer(), np.uint64)
                if b == -1:
                    probe = s.copy()
                else:
                    others[b] = s.copy()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
                found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(check, "a long, b long")


def size_bucket(n: Column, num: int, den: int) -> Column:
    """Two sets that are similar lie in one bucket of sizes or in neighbouring ones."""
    return F.floor(F.log(n) / (math.log(den / num) * 1.0001)).cast("long") if num < den else n.cast("long")


def tiles(members: DataFrame, num: int, den: int, block_sets: int = BLOCK, few: int = FEW_BLOCKS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Which two blocks each member meets in: key, family, i, j, block (i or j); members: key, family, minor, n.

    Blocks hold sets of one bucket of sizes, so only blocks of one bucket or of neighbouring ones meet. A bucket is cut into
    blocks of block_sets sets until they are few; beyond, blocks grow up to block_grams n-grams before there are more of them,
    for every member is sent once for each block that its own meets.
    """
    placed = members.withColumn("bucket", size_bucket(F.col("n"), num, den))

    def blocks(kind: Column) -> Column:
        by_grams = F.ceil(F.sum(F.when(kind, F.col("n")).otherwise(0)) / float(block_grams))
        return F.greatest(by_grams, F.least(F.ceil(F.count_if(kind) / float(block_sets)), F.lit(few))).cast("int")

    sizes = cut(placed.groupBy("family", "bucket").agg(blocks(~F.col("minor")).alias("old"), blocks(F.col("minor")).alias("new")))
    # a bucket goes on if it or a neighbour has minor members
    near = sizes.select("family", F.col("old").alias("old_there"), F.col("new").alias("new_there"), F.col("bucket").alias("there"), F.explode(F.array(*(F.col("bucket") + s for s in (-1, 0, 1)))).alias("bucket"))
    mine = F.when(F.col("minor"), F.col("old") + F.pmod(F.xxhash64("key"), F.greatest("new", F.lit(1)))).otherwise(F.pmod(F.xxhash64("key"), F.greatest("old", F.lit(1))))
    dealt = placed.join(broadcast_if_small(sizes), ["family", "bucket"]).withColumn("mine", F.shiftleft("bucket", 32) + mine).drop("old", "new")
    met = dealt.join(broadcast_if_small(near), ["family", "bucket"])
    first, last = F.when(F.col("minor"), F.lit(0)).otherwise(F.col("old_there")), F.col("old_there") + F.col("new_there") - 1
    others = F.transform(F.sequence(first, last), lambda x: F.shiftleft("there", 32) + x)
    pairs = met.where(first <= last).select("key", "family", "mine", F.explode(others).alias("other"))
    return pairs.select("key", "family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("block"))


def verify_families(members: DataFrame, read: Callable[[DataFrame], DataFrame], num: int, den: int, block_sets: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what is similar within each family; members: key, family, minor, n; read as in :func:`verify`.

    The members of a family are dealt to blocks (see :func:`tiles`), and every two blocks that may hold similar sets (or a
    block and itself) meet in one task, one block as a trie, the other as probes: no pair of members is a row. Members
    that are not minor are in one component already, so their blocks meet those of minor members only: a family of near
    copies with few stragglers costs about its size. Of a task's links those that join two of its parts are handed on, so
    there are fewer than members.
    """
    rows = read(members.select("key")).join(broadcast_if_small(tiles(members, num, den, block_sets)), "key")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides, found = None, ({}, {}), []

        def close() -> None:
            if tile is None:
                return
            left, right = sides[0], sides[1] or sides[0]
            names = [*left, *([] if right is left else right)]
            root = {x: x for x in names}

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            if not left:
                return
            keys = list(left)
            trie = Trie(list(left.values()), num, den)
            for b, probe in right.items():
                for n in np.flatnonzero(trie.near(probe)):
                    x, y = top(keys[n]), top(b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((keys[n], b))

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
            found.clear()
            return got

        for batch in batches:
            for family, i, j, block, key, grams in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5), strict=True):
                if (family, i, j) != tile:
                    close()
                    tile, sides = (family, i, j), ({}, {})
                sides[int(block != i)][key] = np.frombuffer(grams.as_buffer(), np.uint64).copy()
            yield out()
        close()
        yield out()

    tiled = rows.select("family", "i", "j", "block", "key", "grams").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "key")
    return tiled.mapInArrow(check, "a long, b long")


def document_components(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """id, of (a hash of the text), n (set size), component_id, comp: a key of the component, null where the set is empty."""
    with small_batches(docs.sparkSession):
        found = cut(profile(docs, id_col, text_col, k))
        rows = found.where(F.col("n") >= 0)
        hint = order_hint(found.where(F.col("n") < 0).select("key", (-F.col("n")).alias("n")))
        some = rows.where(F.col("n") > 0).groupBy("key")
        classes = cut(some.agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "of")).alias("first")))
        lists = cut(shared(prefixes(docs, text_col, k, num, den, hint)))

        def fits(a: str, b: str):
            return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)

        def read(keys: DataFrame) -> DataFrame:
            return sets_of(keys, classes, docs, id_col, text_col, k)

        roots = linked(lists, fits, lambda n, m: least_common(F.least(n, m)), lambda pairs: verify(pairs, read, num, den), lambda members: verify_families(members, read, num, den), smallest=lambda n: F.ceil(n * num / den))
    smallest = roots.join(classes, F.col("node") == F.col("key")).groupBy("root").agg(F.min("first.id").alias("component"))
    of_component = roots.join(smallest, "root").select(F.col("node").alias("key"), "component", "root")
    named = classes.join(of_component, "key", "left").select("key", F.coalesce("component", "first.id").alias("component"), F.coalesce("root", "key").alias("comp"))
    out = rows.join(named, "key", "left")
    return out.select("id", "of", "n", F.coalesce("component", "id").alias("component_id"), "comp")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Component of each document under links of similarity num/den or more: doc_id, n_shingles, component_id.

    A set holds the distinct k-word shingles of the text with ASCII capitals in lower case; a text of fewer words is
    one shingle; a null, empty or blank text has an empty set and links to nothing, not even its like. Rows that repeat
    an id are documents of one id; component_id is the smallest id of the component. Rows of null id link as others do
    and take part in a component's id only if it has no other. An empty table gives an empty result. Only the two named
    columns are read.
    """
    found = document_components(docs, id_col, text_col, k, num, den)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Documents to drop so that one of each component stays: id, of (see :func:`text_hash`).

    The one that stays has the smallest id (null last), then hash of the text; rows equal to it in both stay with it.
    """
    found = document_components(docs, id_col, text_col, k, num, den).where(F.col("comp").isNotNull())
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "of")
    stays = broadcast_if_small(found.groupBy("comp").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("comp", "first"))
    return found.join(stays, "comp").where(~rank.eqNullSafe(F.col("first"))).select("id", "of").distinct()


def op9_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
