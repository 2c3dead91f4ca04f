"""The corpus pipeline: from documents to packed sequences, each stage written and read again as Parquet.

Language ID drops documents without a recognised language; exact and near deduplication keep one document of each group;
personal data is replaced by its kind; what is left is packed.

All stages but the last hand on every column, whatever it is called. Null and empty texts, and texts without letters, have no language and
are dropped by the first stage; rows without doc_id are kept by the others, each of them once for each text. Of rows with one doc_id and
one text the first that is read stays. Of groups the row with the longest original text and then the smallest doc_id stays (exact), or
the smallest doc_id (near). Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import exact_dedup, jaccard_join, language, packing, pii
from cadenza.llm.shared import discard, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.kept_rows(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_deduplication), ("jaccard_join", near_deduplication), ("pii", personal_data), ("packing", packed)]

#: SQL can express neither the trained stages nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
