"""Plain versions of the corpus operators."""

import hashlib
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text, k):
    w = SPACED.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def char_shingles(line, k):
    """Character shingles of a line; a shorter one is one shingle."""
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def jaccard_components(sets, num, den):
    """Smallest id reachable; sets: id -> set; an empty set links to nothing."""
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def benchmark_hits(texts, items):
    """id -> (words, hit words, items)."""
    windows = defaultdict(set)
    for item, text in items.items():
        w = ALNUM.findall((text or "").translate(FOLD))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in texts.items():
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                got = windows.get(tuple(w[p : p + k]))
                if got:
                    hit.update(range(p, p + k))
                    found |= got
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def mix(rows, weights=(1.0, 2.0, 3.0), cap=3):
    """rows: (id, text, source) -> id: (size, source size, target, taken)."""
    size = {i: len(SPACED.findall(t or "")) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    names = sorted({s for s in of.values() if s is not None}) + [None] * (None in of.values())
    total = {s: sum(size[i] for i in of if of[i] == s) for s in names}
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    target, left, free = {}, float(sum(total.values())), set(names)
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap * total[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = float(cap * total[s])
        left -= sum(target[s] for s in over)
        free -= over
    taken = {}
    for s in names:
        budget = int(target[s] + 1e-9)
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        order = sorted((i for i in of if of[i] == s), key=lambda i: (int(hashlib.md5(f"{i}#17".encode()).hexdigest()[:15], 16), i))
        for i in order:
            part = min(size[i], max(rest, 0))
            rest -= size[i]
            taken[i] = whole * size[i] + part
    return {i: (size[i], total[of[i]], target[of[i]], taken[i]) for i in of}
