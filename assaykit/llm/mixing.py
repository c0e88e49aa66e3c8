"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in key order; the key space of a source
is cut into ranges of about :data:`~.common.ROWS_PER_RANGE` documents, so a source with a third of all rows is sorted
by many tasks. Sizes are summed per range, ranges are summed up per source, and a document's running total is its
range's offset plus its place within the range. A source's budget is cut exactly: whole epochs first, then a prefix of
the order, the document on the cut counting in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_RANGE, cut, table

#: Weights that sources take in turn, by code point order of their names, null last.
WEIGHTS = (1.0, 2.0, 3.0)
#: No source gives more than so many times its words.
MAX_EPOCHS = 3
#: Changes the order in which documents are taken.
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60


def count_words(text: Column) -> Column:
    """Words of a text, those between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources, given one row a source: __source, __source_size, __rows.

    All sizes together are shared by weight. A target above max_epochs times its source's size stops there and the
    excess is shared among the others by weight, until none is above: sources fill in order of size / weight. With the
    first k full, the level of the others is known; it rises with k while the next source would overflow and falls
    after that, so the largest is the one that holds.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("__source_size").cast("double") * max_epochs
    named = sources.withColumn("__w", weight).withColumn("__cap", cap).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    before = Window.orderBy("__ratio", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = named.select(
        "*",
        F.sum("__source_size").over(every).cast("double").alias("__all"),
        F.sum("__w").over(every).alias("__all_w"),
        F.coalesce(F.sum("__cap").over(before), F.lit(0.0)).alias("__full"),
        F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__full_w"),
    ).withColumn("__level", (F.col("__all") - F.col("__full")) / (F.col("__all_w") - F.col("__full_w")))
    return filled.withColumn("__level", F.max("__level").over(every)).select("__source", "__source_size", "__rows", F.least("__cap", F.col("__w") * F.col("__level")).alias("__target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row a document: doc_id, source, size, source_size, target, taken, epochs. A null or empty text has
    size 0 and is taken 0 times; a null source is a source of its own, last in order; an empty table gives an empty
    result. Repeated rows are separate documents of one key; ties of the key fall back on id and size. Only the three
    named columns are read, so others may have any name.
    """
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    key = F.conv(F.substring(F.md5(F.concat(text_id, F.lit(f"#{seed}"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), count_words(F.col(text_col)).alias("__size"), key.alias("__key")))
    sources = sized.groupBy("__source").agg(F.sum("__size").alias("__source_size"), F.count("*").alias("__rows"))
    targets = source_targets(sources, weights, max_epochs).withColumn("__bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("__rows") / float(rows_per_range)))).cast("int"))
    targets = targets.withColumnRenamed("__source", "__of")
    same = F.col("__source").eqNullSafe(F.col("__of"))
    ranged = sized.join(targets, same).drop("__of").withColumn("__range", F.expr(f"shiftright(__key, cast({KEY_BITS} - __bits as int))"))
    sums = ranged.groupBy("__source", "__range").agg(F.sum("__size").alias("__sum"))
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__source").alias("__of"), F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__source", "__range").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("__upto", F.sum("__size").over(within)).join(offsets, same & (F.col("__range") == F.col("__at")))
    budget = F.floor("__target").cast("long")
    epochs = F.when(F.col("__source_size") > 0, F.expr("floor(__target) div __source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("__epochs") * F.col("__source_size")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - (F.col("__offset") + F.col("__upto") - F.col("__size"))))
    return placed.withColumn("__epochs", epochs).select(
        F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__epochs") * F.col("__size") + part).cast("long").alias("taken"), F.col("__epochs").alias("epochs"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB; the key ranges are only a way to sort, so plain windows give the same rows.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all({docs}.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat(doc_id::VARCHAR, '#17')), 1, 15))::BIGINT AS k
  FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), caps AS (
  SELECT *, source_size::DOUBLE * 3 AS cap, source_size::DOUBLE * 3 / w AS ratio FROM sources
), filled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS lvl
  FROM caps WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, w * max(lvl) OVER ()) AS target FROM filled
), placed AS (
  SELECT sized.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - (upto - size))))::BIGINT AS taken
FROM placed
"""
