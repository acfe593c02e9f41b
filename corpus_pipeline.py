"""From raw documents to a mixed corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns the mix: how many
words are taken of each document. Between stages the rows are written as Parquet to the shared folder and read again.

Every stage reads whole texts, however long, takes an empty table to an empty one, and keeps columns beyond those of documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bwt_dedup, decontam, jaccard_join, langid, mixing
from tessera.llm.durable import settle, together

#: Below this share of known n-grams a text is in none of the languages learned.
LEAST_COVERAGE = 0.25
#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; texts without letters or mostly of unknown n-grams go.

    So null and empty texts go, and all texts where no row has a language to learn from; repeated rows stay or go alike.
    """
    filters = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs, filters, keep_text=True).filter((F.col("lang_pred") != langid.UND) & (F.col("coverage") >= LEAST_COVERAGE))
    return together(found, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that with the smallest id.

    Null and empty texts are alone and stay; a row without an id stays unless a row with one has its set; of rows equal in id and text one stays.
    """
    return jaccard_join.keep_one(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that stand in the corpus more than once; those with no word left go.

    All copies of such a string are cut, so no order decides. Texts that lose nothing stay, null and empty ones too. ``n_chars`` follows the text.
    """
    found = bwt_dedup.dedup(docs, keep_text=True).filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    kept = together(found, docs.columns)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words. Null and empty texts stay; repeated rows stay or go alike."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, a row each; null and empty texts give none, null is a source of its own, rows without an id are dealt by their texts."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

#: Language ID and the components of the similarity join have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
