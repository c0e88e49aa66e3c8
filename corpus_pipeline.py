"""The corpus pipeline: classify, deduplicate, decontaminate, mix and shard the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import decontam, mixing, ngram_join, quality, sharding
from assaykit.llm.common import broadcast_if_small, cut, table

#: Near duplicates share four fifths or more of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ids (a column __id), all their columns kept."""
    return docs.join(broadcast_if_small(ids), docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows of one id go or stay together, as its best text is scored."""
    weights = quality.train(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    rejected = quality.predict(docs, weights).groupBy("doc_id").agg(F.max("score").alias("score")).where(F.col("score") < quality.THRESHOLD)
    return _without(docs, rejected.select(F.col("doc_id").alias("__id")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates stays; ids may be null or repeat."""
    dropped = broadcast_if_small(ngram_join.copies(docs, k=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1]))
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["id"]) & (ngram_join.text_hash("text") == dropped["of"]), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("__id")).distinct()
    return _without(docs, hit)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole epochs, and the document on a source's cut once more.

    A document that the mix does not take is left out; copies follow each other with equal columns.
    """
    taken = mixing.mix(docs).where(F.col("taken") > 0)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    ids = taken.groupBy(F.col("doc_id").alias("__id")).agg(F.max(times).alias("__times"))
    repeated = docs.join(broadcast_if_small(ids), docs["doc_id"].eqNullSafe(F.col("__id")))
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*(repeated[c] for c in docs.columns))


def sharding_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row."""
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", sharding_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: A trained classifier is among the stages, so SQL can't give the rows; tests hold them against brute force.
ORACLE_SQL = None
