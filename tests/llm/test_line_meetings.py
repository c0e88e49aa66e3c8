"""Lines that share rare shingles meet at few of them."""

from __future__ import annotations

import numpy as np

from assaykit.llm import linededup


def test_lines_meet_at_few_of_the_shingles_they_share(spark):
    """Lines of two passages each share some forty rare shingles with others; they meet where the order is lowest nearby."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    passages = ["".join(rng.choice(letters, 50)) for _ in range(40)]
    lines = ["".join(passages[i] for i in rng.permutation(40)[:4]) for _ in range(400)]
    crowd = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "key long, comp long, line string")
    met = linededup._meetings(crowd, 80, 100)
    pairs = linededup.prefix_pairs(crowd, 80, 100)
    assert pairs.count() > 500 and met.count() <= 9 * pairs.count()
    assert met.distinct().exceptAll(pairs).count() == 0
