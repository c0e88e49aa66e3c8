"""License scans by patience alignment.

The words of a text that belong to a template are found by hash; around the template's telling words the text is
aligned with the template: words unique to both sides anchor the alignment, the longest increasing subsequence of the
anchors is kept, and the gaps between anchors are aligned in the same way. The share of the template's words that are
matched is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textnp import slices, word_hashes

# Public license texts and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "BSD-notice": "Distributed under the BSD License.",
}
#: Least coverage of a match.
COVERAGE = 0.8
#: Words that say nothing about a license.
COMMON = frozenset("a all and any appear are as at be by do either for free in is it of on or other shall so that the this to use version with without you your work".split())
WORD = re.compile(r"[a-z0-9]+")


def tokenize(text: str) -> list[str]:
    """Runs of ASCII letters and digits, letters in lower case."""
    return WORD.findall(text.translate(_LOWER))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two word sequences, both rising."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        here, there = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {w: j for j, w in enumerate(b[blo:bhi], blo) if there[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(a[alo:ahi], alo) if here[w] == 1 and w in place])
        if not anchors:
            continue
        out.extend(anchors)
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True))
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second entries rise, by patience sorting; first entries rise already."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[n] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            last.append(n)
        else:
            tops[pile], last[pile] = j, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.templates = {name: tokenize(text) for name, text in templates.items()}
        self.coverage = coverage
        self.telling = {name: frozenset(words) - COMMON or frozenset(words) for name, words in self.templates.items()}
        every = sorted(set().union(*self.telling.values())) if templates else []
        raw = " ".join(every).encode()
        self.hashes = np.unique(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _BREAKS)[0])

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold a telling word of a template."""
        words, firsts = word_hashes(data, offsets, _BREAKS)
        hits = np.concatenate([[0], np.cumsum(np.isin(words, self.hashes))])
        return hits[firsts[1:]] > hits[firsts[:-1]]

    def aligned(self, words: Sequence[str], template: Sequence[str], lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """First word, end word and matched words of the copies of a template in a region, the last one first: an alignment takes one, and what lies before it is aligned again."""
        while len(pairs := patience(words[lo:hi], template)) >= max(1, self.coverage * len(template)):
            yield lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs)
            hi = lo + pairs[0][0]

    def matches(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, coverage) of the matches, by place. Of matches that overlap the one with more matched words stays, then the first, then the first name."""
        words = tokenize(text)
        found = []
        for name, template in self.templates.items():
            m, telling = len(template), self.telling[name]
            need = Counter(template)
            at = [i for i, w in enumerate(words) if w in telling]
            done = 0
            for i in at:
                if i < done:
                    continue
                lo, hi = max(done, i - m), min(len(words), i + 2 * m)
                there = Counter(words[lo:hi])
                if sum(min(c, there[w]) for w, c in need.items()) < self.coverage * m:
                    continue
                # the region begins with this telling word's own copy of the template
                lo = max(done, i - template.index(words[i]) - 2)
                for start, stop, n in self.aligned(words, template, lo, hi):
                    found.append((-n, start, name, stop, n / m))
                    done = max(done, stop)
        kept: list[tuple[str, int, int, float]] = []
        for _, start, name, stop, share in sorted(found):
            if all(stop <= s or e <= start for _, s, e, _ in kept):
                kept.append((name, start, stop, share))
        return sorted(kept, key=lambda x: x[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Licenses in each document: doc_id, licenses (array of name, start, stop, coverage in words).

    A null or empty text has none; repeated rows are scanned one by one; an empty table gives an empty result. A
    region that repeats a template right away is two matches.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    entry = pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, offsets, data in slices(batch.column(1)):
                for i in np.flatnonzero(scanner.candidates(data, offsets)):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    out[first + i] = [{"name": n, "start": s, "stop": e, "coverage": c} for n, s, e, c in scanner.matches(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(entry))], names=["doc_id", "licenses"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, licenses array<struct<name:string,start:int,stop:int,coverage:double>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["stop"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.col("licenses.name"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("licenses.coverage")), F.lit(0.0)).alias("coverage"), F.array_join(listed, ",").alias("spans"),
    )
