"""What the findings of round 4 asked for: less written, fewer scans, equal results."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import linededup
from assaykit.llm.common import cut
from assaykit.operators import ensemble, neighbours
from assaykit.plans import neighbours as plan


def test_ensemble_writes_few_lists_of_neighbours(spark, monkeypatch):
    """Of the nearest neighbours that a detector needs, only lists across cells reach the checkpoints."""
    monkeypatch.setattr(plan, "CELL_POINTS", 1000)
    written = []

    def counted(write):
        def checkpoint(df):
            held = write(df)
            written.append(held.agg(F.sum(F.size("near"))).first()[0] or 0 if "near" in held.columns else 0)
            return held

        return checkpoint

    for module in (plan, neighbours):
        monkeypatch.setattr(module, "checkpointed", counted(module.checkpointed))
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))], "k int, a double, b double")
    assert ensemble.detect(df, "k", ["a", "b"], ("lof", "zscore"))["rows"].count() == 3000
    assert sum(written) < 3000 * 21


def test_lines_let_go_of_the_files_that_are_not_needed(spark, monkeypatch):
    """Shuffle files of the signatures are gone when pairs across components are looked for."""
    places = [Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held = lambda: {f.name.split("_")[1] for p in places for f in p.glob("*/shuffle_*")}
    before, first, left = held(), set(), set()
    across = linededup._across

    def kept(df):  # the first to be written are the signatures
        out = cut(df)
        if not first:
            first.update(held() - before)
        return out

    def later(opened, *args):
        end = time.time() + 20
        while first & held() and time.time() < end:
            time.sleep(0.2)
        left.update(first & held())
        return across(opened, *args)

    monkeypatch.setattr(linededup, "cut", kept)
    monkeypatch.setattr(linededup, "_across", later)
    texts = [f"the line number {i % 9} of a text that is long enough to be like others, of kind {i % 4}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, line string").selectExpr("xxhash64(line) AS key", "line").distinct()
    linededup.linked_lines(df).count()
    assert first and not left
