"""The corpus pipeline: each stage applies one operator of tarn.llm to all documents its predecessor kept.

Each stage's function takes (spark, docs, sf_dir). All but the last return the
columns of documents; docs may be any DataFrame with those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import deleted, stored, table, temporary
from tarn.llm.stages import (
    benchmark_decontamination,
    byte_bpe_encoding,
    exact_dedup,
    quality,
    simhash_near_dedup,
)

STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding", byte_bpe_encoding),
]

#: The classifier is fitted and the encoder replays merges; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage kept is written once and read by the next.

    Tables that a stage needed are deleted when its own is written, and that one
    when the next is. Only the input of the last stage stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES):
        if number == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with temporary(spark) as used:
            docs = stored(stage(spark, docs, sf_dir), "pipeline")
            own = [used.pop()]  # the stage's table is the last one written
        deleted(spark, before)
        before = own
    return docs
