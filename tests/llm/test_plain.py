"""Language, licenses and shards against versions that take one text or key at a time."""

import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

from assaykit.llm import langid, licenses, sharding

DATA = "/root/testdata/sf0.001"


# --- 1 -----------------------------------------------------------------------------------------------------------------


def plain_buckets(text):
    """Buckets of the 1- to 3-grams of the letters, words with one space between."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    line = " ".join(words)
    if (text or "")[:1] and not text[0].isalpha():
        line = " " + line
    if words and not text[-1].isalpha():
        line += " "
    out = []
    for n in langid.ORDERS:
        for i in range(len(line) - n + 1):
            if line[i : i + n].strip():
                h = n
                for c in line[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out.append(int(langid.mixed(np.array([h], np.uint64))[0] >> np.uint64(64 - langid.BUCKET_BITS)))
    return out


def test_language_sums_logs_as_a_plain_learner(spark, docs):
    learned = docs.where("lang IS NOT NULL AND doc_id % 2 = 1")
    counts = defaultdict(Counter)
    for r in learned.collect():
        counts[r["lang"]].update(plain_buckets(r["text"]))
    names, size = sorted(counts), 1 << langid.BUCKET_BITS
    total = {x: sum(counts[x].values()) + langid.SMOOTHING * size for x in names}
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(learned)).collect()}
    for r in docs.collect():
        grams = plain_buckets(r["text"])
        mine = got[r["doc_id"]]
        if not grams:
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        z = np.array([sum(math.log(counts[x][g] + langid.SMOOTHING) - math.log(total[x]) for g in grams) for x in names]) / len(grams) * min(len(grams), langid.EVIDENCE)
        p = np.exp(z - z.max())
        assert mine["score"] == pytest.approx(p.max() / p.sum(), abs=1e-3)
        if np.sort(p)[-2] < 0.99:
            assert mine["lang_pred"] == names[int(z.argmax())]


# --- 2 -----------------------------------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_coverage_and_spans_are_those_of_what_was_planted():
    rng = random.Random(6)
    fill = [f"w{i}" for i in range(500)]
    scanner = licenses.Scanner()
    for name in sorted(licenses.TEMPLATES):
        template = licenses.tokenize(licenses.TEMPLATES[name])
        for _ in range(4):
            changed = [w if rng.random() > 0.08 else rng.choice(fill) for w in template]
            if changed[0] != template[0] or changed[-1] != template[-1]:
                changed[0], changed[-1] = template[0], template[-1]
            before = rng.randrange(40)
            words = [*rng.sample(fill, before), *changed, *rng.sample(fill, 20)]
            kept = sum(a == b for a, b in zip(changed, template))
            got = [m for m in scanner.matches(" ".join(words)) if m[0] == name]
            if kept >= licenses.COVERAGE * len(template):
                assert [(s, e) for _, s, e, _ in got] == [(before, before + len(template))], name
                share = longest_common(words[before : before + len(template)], template) / len(template)
                assert kept / len(template) - 1e-9 <= got[0][3] <= share + 1e-9
            elif got:
                assert got[0][3] <= longest_common(words, template) / len(template)


def test_a_template_that_repeats_right_away_is_matched_each_time():
    scanner = licenses.Scanner()
    notice = "Released under the MIT License."
    for before, n, after in (("", 2, ""), ("x y ", 2, " z"), ("x y ", 3, ""), ("", 4, " z z z"), ("a b c d e f g ", 2, " h")):
        got = scanner.matches(before + " ".join([notice] * n) + after)
        first = len(before.split())
        assert [m[:3] for m in got] == [("MIT-notice", first + 5 * i, first + 5 * i + 5) for i in range(n)], (before, n, after)


# --- 7 -----------------------------------------------------------------------------------------------------------------


def hashed(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), seed=h)
    return h


def plain_shard(key, tree):
    """Descends level by level; the largest ln(u) / weight wins."""
    weight = lambda leaves: sum(x[3] for x in leaves)
    draw = lambda level, name, w: math.log(((hashed(key, f"{level}/{name}") >> 12) + 0.5) / 2**52) / w

    def pick(level, groups):
        return next(iter(groups)) if len(groups) == 1 else max(groups, key=lambda g: draw(level, g, weight(groups[g])))

    def split(leaves, at):
        out = defaultdict(list)
        for x in leaves:
            out[str(x[at])].append(x)
        return out

    regions = split(tree, 0)
    region = pick("root", regions)
    racks = split(regions[region], 1)
    rack = pick(region, racks)
    return int(pick(f"{region}/{rack}", split(racks[rack], 2)))


def test_shards_and_slots_match_a_plain_version(spark, docs):
    tree = [*sharding.default_tree(13), ("region9", "rack9", 13, 2.5)]
    got = sharding.shard(docs, tree, rows_per_range=5).collect()
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (plain_shard(str(r["doc_id"]), tree), plain_shard(str(r["doc_id"]), sharding.grow(tree)))
    bits = sharding.range_bits(len(got) // len(tree), 5)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    place = lambda i: ((h := hashed(str(i), "slot")) >> (64 - bits) if bits else 0, signed(h))
    for s in range(14):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and [r["doc_id"] for r in own] == sorted((r["doc_id"] for r in own), key=place)
