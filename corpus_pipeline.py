"""From raw documents to token ids in five stages, each a whole pass over what the last one kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import decontaminate, near_dedup, quality, secrets, unigram
from linkweave.llm.support import forget, shared_folder, table

#: Near duplicates in the pipeline share five-word shingles to 80 % or more, the rule where no contract names others.
NEAR = near_dedup.NearDedup(words=5, percent=80)


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it is known, counted again: a stage may have cut the text."""
    if "n_chars" not in docs.columns or "text" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, of the smallest id; empty texts are no group and all stay.

    Ids need not be unique: different texts under one id are different documents.
    """
    return near_dedup.deduplicated(docs, NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return _sized(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _sized(secrets.redacted(docs))


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their counts and whether they decode to the text."""
    return unigram.encode_decode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece_codec),
]

#: A trained classifier, MinHash and a codec are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written as Parquet in the shared folder and read again.

    A stage's folder goes when the next one's is written; the last stays for the reader of the result.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if number:
            forget(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(path)
    return docs
