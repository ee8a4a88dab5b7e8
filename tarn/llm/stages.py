"""The stages of the corpus pipeline: each applies one operator to all documents it is given.

Each function takes (spark, docs, sf_dir). All but the last return the columns
of docs. A null or repeated doc_id, null texts and extra columns pass through as
the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import byte_bpe, decontamination, near_dedup
from tarn.llm import exact_dedup as exact
from tarn.llm import quality as weak
from tarn.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on docs, does not reject."""
    return weak.kept(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.kept(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: a Jaccard similarity of five-word shingles of 0.8 or more."""
    return near_dedup.kept(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item: no share of hit words is let through."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), coverage=0.0)


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, with the digests of ids and of the text decoded from them."""
    import public_tokenizers

    found = byte_bpe.encode_and_decode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )
