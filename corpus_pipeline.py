"""Training-data pipeline over documents: language, near duplicates, repeated passages, mixing, packing.

Each stage takes all that its predecessor kept, as a table with the columns of
documents; run() writes a stage's result to the shared folder and reads it again
before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import langid, mixing, packing, simhash, suffixes
from weftgraph.llm.common import Scratch, prepared, table

#: A text without a letter is rejected, and one whose best cosine is less than this.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: learned where lang is given, outside the held-out quarter.

    Rejected are null texts, texts without a letter and texts unlike every
    language; all others stay as they are. Where nothing can be learned, no text
    is rejected for its score.
    """
    prepared(spark)
    found = langid.identify(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    known = docs.where("lang is not null and text is not null").limit(1).count() > 0
    if not known:
        return docs.where("text is not null").where(F.col("text").rlike("\\p{L}"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five words, Jaccard similarity of 0.8 or more (see simhash.one_of_each)."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier; n_chars is counted anew. Documents with nothing left go."""
    left = suffixes.remove_repeats(docs)
    text = F.col("kept")
    changed = left.withColumn("text", F.when(F.col("n_removed") > 0, text).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    return changed.where(F.length(F.trim("text")) > 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, one of a shard in part; n_chars is counted anew."""
    mixed = mixing.mixed(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]
#: SQL can't express the fingerprints, profiles or merges of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.stored(docs)
    return docs
