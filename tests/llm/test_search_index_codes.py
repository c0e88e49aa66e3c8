"""Ranked search, the exact index and vector codes against plain versions and on edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import exactdedup, ranked, veccodes

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def plain_ranks(docs, items, k):
    """docs, items: (id, text) rows -> rows of item, rank, doc, score."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    full = [c for _, c in counts if c]
    df = Counter(t for c in full for t in c)
    n, total = len(full), sum(sum(c.values()) for c in full)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


# --- 11 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("postings", "rows", "words"), [(ranked.SHARD_POSTINGS, ranked.SHARD_DOCS, ranked.BLOCK_WORDS), (300, 7, 900)])
def test_ranks_match_a_plain_version(spark, docs, texts, monkeypatch, postings, rows, words):
    """Whatever the size of shards and of blocks of queries."""
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked, "SHARD_DOCS", rows)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(40)
    got = ranked.search(docs, items, block_words=words).collect()
    want = plain_ranks(list(texts.items()), [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == want


def test_maxscore_drops_nothing_that_qualifies():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, terms = 200, int(rng.integers(1, 9))
        lists = []
        for _ in range(terms):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.8]))
            docs = docs if len(docs) else np.array([0])
            lists.append((docs, rng.integers(0, 40, len(docs))))
        whole = np.zeros(n, int)
        for d, a in lists:
            whole[d] += a
        floor = int(np.sort(whole)[-rng.integers(1, 50)])
        at, score = ranked.maxscore(lists, np.array([a.max() for _, a in lists]), n, floor)
        assert at.tolist() == np.flatnonzero(whole >= max(1, floor)).tolist() and (score == whole[at]).all()


def test_terms_agree_between_bytes_and_expressions(spark):
    samples = ["A-b C9", "Éa\x85b c d", "", "\x7f\x1f", "Straße İX 10_20", "\U0001f600a z"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for s, r in zip(samples, df.select(ranked.words_in(F.col("t")).alias("w")).collect()):
        assert [t.decode() for t in ranked.terms_of(s.encode())] == plain_terms(s) == r["w"]


def test_ranked_search_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, "..."), (4, "X"), (4, "X"), (5, "absent"), (6, edge.where("doc_id = 1").first()["text"])], "item_id long, text string")
    got = defaultdict(list)
    for r in sorted(ranked.search(edge, items, k=5).collect()):
        got[r["item_id"]].append((r["rank"], r["doc_id"]))
    plain = plain_ranks([(r["doc_id"], r["text"]) for r in edge.collect()], [(1, "one two"), (4, "X")], 5)
    assert got[1] == [(1, None)] == [(r, i) for item, r, i, _ in plain if item == 1]
    assert got[4] == [(1, 7)] and set(got) == {1, 4, 6}
    assert got[6] == [(1, 5), (2, 1), (3, 6), (4, 6), (5, 8)]  # equal scores by id, repeated rows one after the other
    assert ranked.search(empty, items).count() == 0 and ranked.search(edge, items.where("item_id = 2")).count() == 0


def test_ties_go_to_smaller_ids_across_tasks(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 3 else "other text") for i in range(600, 0, -1)], "doc_id long, text string").repartition(7)
    got = ranked.search(docs, spark.createDataFrame([("q", "same same")], "item_id string, text string"), k=5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 4, 5, 7] and len({r["score"] for r in got}) == 1


# --- 12 ----------------------------------------------------------------------------------------------------------------


def plain_groups(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[t or ""].append(i)
    return sorted((i, max(ids := of[t or ""], key=lambda x: (x is not None, x)), len(ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize(("bits", "capacity"), [(64, exactdedup.CAPACITY), (64, 5), (5, 3), (1, 1)])
def test_exact_groups_match_a_plain_version(spark, docs, texts, bits, capacity):
    """Also where texts collide, so that entries are chained and bytes decide."""
    got = exactdedup.deduplicate(docs, key_bits=bits, capacity=capacity).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == plain_groups(texts.items())
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    if bits == 64 and capacity == 5:
        assert max(Counter(r["bucket"] for r in {x["keep_id"]: x for x in got}.values()).values()) <= 5


def test_directory_doubles_where_a_bucket_is_overfull():
    d = exactdedup.Directory.grown({0: 9, 1: 1, 2: 1, 7: 1}, 3, 4)
    assert d.depth == 3 and d.slots == (0, 1, 2, 2, 3, 3, 3, 3)  # prefix 0 alone stays overfull at full depth
    assert exactdedup.Directory.grown({0: 4}, 3, 4) == exactdedup.Directory(0, (0,))
    assert exactdedup.Directory.grown({}, 0, 4) == exactdedup.Directory(0, (0,))
    even = exactdedup.Directory.grown({i: 1 for i in range(64)}, 6, 8)
    assert even.depth == 3 and even.slots == tuple(range(8))


def test_bucket_files_lie_in_the_shared_folder_by_key_range(spark, docs):
    keyed = docs.select(F.col("doc_id").alias("id"), exactdedup.key_of(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"))
    d = exactdedup.Directory(3, tuple(range(8)))
    index = exactdedup.build(keyed, None, d, path := exactdedup.shared_folder(spark))
    assert path.startswith(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    got = index.entries(spark).collect()
    assert len(got) == keyed.select("key").distinct().count()
    assert all((r["key"] % 2**64) >> 61 == r["bucket"] for r in got)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup_edges(spark, edge, empty, bits):
    got = exactdedup.deduplicate(edge, key_bits=bits).collect()
    key = lambda r: (r[0] is not None, *(str(x) for x in r))
    want = plain_groups([(r["doc_id"] if r["doc_id"] is not None else -(10**6), r["text"]) for r in edge.collect()])
    want = [tuple(None if x == -(10**6) else x for x in r) for r in want]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})  # one of repeated rows, too
    assert exactdedup.deduplicate(empty).count() == 0


def test_a_hot_text_and_null_ids(spark):
    rows = [(None if i % 4 == 0 else i, "hot" if i % 3 else f"t{i}") for i in range(1, 400)]
    got = exactdedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hot = [r for r in got if r["group_size"] > 1]
    assert len(hot) == 266 and {r["keep_id"] for r in hot} == {398} and sum(r["kept"] for r in got) == 1 + 133


# --- 13 ----------------------------------------------------------------------------------------------------------------


def plain_codes(rows, rounds=2):
    """rows: (id, vector, label), ids unique -> id: (code, error, label error), digest."""
    kept = sorted((i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    best = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                groups[p, best(v, p)[1]].append(part(v, p))
        for (p, k), vs in groups.items():
            books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out, of = {}, Counter()
    for i, v, lab in kept:
        found = [best(v, p) for p in range(16)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab)
        of[lab] += out[i][1]
    return {i: (c, e, of[lab]) for i, (c, e, lab) in out.items()}, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_match_a_plain_version(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, sha = plain_codes(rows)
    got = veccodes.op13_vector_codes(spark, DATA).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {sha}


def test_codes_edges(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5]) for _ in range(32)], None if i % 3 == 0 else i % 2) for i in range(90)]
    rows += [(90, None, 1), (91, [], 1), (92, [float("nan")] * 32, 1), (93, [float("inf")] * 32, 0), (94, [None] + [0.0] * 31, 0)]
    schema = "vec_id long, embedding array<float>, label int, code string, x int, id string"
    df = spark.createDataFrame([(*r, "c", 7, "i") for r in rows], schema)
    want, sha = plain_codes(rows)
    out, books = veccodes.compress(df)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in out.collect()} == want and veccodes.digest(books) == sha
    few = df.where("vec_id < 3").union(df.where("vec_id < 3"))  # repeated rows, fewer than entries
    out, books = veccodes.compress(few)
    assert out.count() == 6 and books.shape == (16, 6, 2) and out.agg(F.sum("error")).first()[0] == 0
    assert veccodes.compress(df.where("vec_id > 89"))[0].count() == 0
    odd = spark.createDataFrame([(1, [1e300, -1e300, 0.5], None), (None, [0.0, 0.0, 0.0], None), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"] for r in veccodes.compress(odd)[0].collect()} == {1, None}


def test_bounds_enclose_distances_and_spare_entries():
    rng = np.random.default_rng(5)
    entries, x = rng.integers(-100, 100, (64, 4)), rng.integers(-120, 120, (500, 4))
    code, error, refined = veccodes.Cells(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (error == every.min(1)).all()
    assert refined < 0.4 * every.size
    same = np.repeat(entries[:1], 64, 0)
    code, error, _ = veccodes.Cells(same).nearest(x)
    assert (code == 0).all()
