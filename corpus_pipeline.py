"""The corpus pipeline: stages that each take what the one before has kept.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of docs. A
stage is written as Parquet and read again before the next, so no stage plans over another's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, language_id, minhash_dedup, quality_qda, sentencepiece_codec
from loomgraph.llm.common import materialise, read_table

#: Score from which the classifier keeps a document.
QUALITY = 0.7
#: Nearness to the best language profile from which a document counts as text of a known language.
LANGUAGE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    stats = quality_qda.document_features(docs)
    model = quality_qda.fit(quality_qda.training_rows(stats), read_table(spark, sf_dir, "labels"))
    return docs.where(quality_qda.score_text(F.col("text"), model) >= QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    profiles = language_id.Profiles(language_id.train(language_id.training_rows(docs)))
    found = language_id.predict(F.col("text"), profiles)
    kept = docs.withColumn("_found", found)
    return kept.where(
        (F.col("_found.lang") != language_id.UNDETERMINED) & (F.col("_found.score") >= LANGUAGE)
    ).drop("_found")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash_dedup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each kept document, and whether they decode to its text."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: Neither the classifier nor the other stages can be stated in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
