"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np

from assaykit.llm import linededup


# --- 8 -----------------------------------------------------------------------------------------------------------------


def components_of(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    return {r["doc_id"]: r["component"] for r in linededup.line_components(df).collect()}


def test_long_lines_without_spaces_meet(spark):
    """200 characters without a space, the copy with one of the first nine changed: Jaccard 0.91 or more."""
    rng = np.random.default_rng(3)
    lines = []
    for i in range(100):
        a = rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 200)
        b = a.copy()
        b[i % 9] = "#"
        lines += ["".join(a), "".join(b)]
    got = components_of(spark, lines)
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(100)) >= 98


def test_prefix_pairs_lose_no_link(spark):
    """Lines put together from few passages: every pair of similarity 0.8 or more comes out, those of one component do not."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(60)]
    passages = [" ".join(rng.choice(words, 5)) for _ in range(12)]
    lines = sorted({" ".join(passages[i] for i in sorted(rng.choice(12, rng.integers(6, 11), replace=False))) for _ in range(160)})
    sets = [{x[i : i + 9] for i in range(max(len(x) - 8, 1))} for x in lines]
    comp = [i // 2 for i in range(len(lines))]
    near = {(i, j) for i in range(len(lines)) for j in range(i) if comp[i] != comp[j] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    rows = [(i, comp[i], x) for i, x in enumerate(lines)]
    got = {(r["b"], r["a"]) for r in linededup.prefix_pairs(spark.createDataFrame(rows, "key long, comp long, line string")).collect()}
    assert len(near) > 20 and near <= got and all(comp[i] != comp[j] for i, j in got)


def test_lines_that_share_a_passage_and_are_too_far_apart_make_no_pairs(spark):
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    passage = "".join(rng.choice(letters, 180))
    rows = [(i, i, passage + "".join(rng.choice(letters, 30))) for i in range(1_000)]
    assert linededup.prefix_pairs(spark.createDataFrame(rows, "key long, comp long, line string")).count() == 0
