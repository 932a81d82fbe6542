"""From raw documents to packed training sequences: five stages, each an operator of codecurves.llm over all that the one before kept.

Every stage but the last returns the columns of documents; its result is written as Parquet in the shared folder and read again, so a
lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codecurves.llm import decontam, near_copies, packing, suffix_dedup, toxicity
from codecurves.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard of 0.8 the document of the smallest id stays."""
    return near_copies.drop_near_copies(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 50-byte string of an earlier document covers are cut out of the texts."""
    return suffix_dedup.remove_repeats(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out of the texts."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document has its place in a sequence."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeats", remove_repeats), ("decontamination", remove_benchmark), ("packing", pack)]

#: Word restoration, SimHash over XXH64 and tokenization aren't SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
