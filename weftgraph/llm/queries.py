"""The training-data queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import ann, htmltext, langid, media, mixing, packing, simhash, suffixes, toxicity, warc
from weftgraph.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a lexicon learned from labels outside the held-out fifth."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of at least 100 bytes take from every document."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out()
    found = langid.identify(docs, ~held & F.col("doc_id").isNotNull())
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the paths that its host's pages agree on."""
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives it was written to."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as JPEG coefficients, and what reading those gives."""
    return media.described(media.media_column(table(spark, sf_dir, "documents")))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_toxicity, op3_suffix_dedup, op4_packing, op5_language, op6_html, op7_mixing, op8_warc, op9_media, op10_ann)
}
SQL: dict[str, str] = {
    "op8_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    """,
}
