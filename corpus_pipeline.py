"""A corpus in five stages: from ``documents`` to packed training sequences.

Every stage is one operator of ``caseload.llm`` applied to all that its predecessor kept; its result is
written as Parquet and read again as the next one's documents. The first four return the columns of
``documents``:

1. quality classifier: documents it rejects (low quality or toxic) go;
2. line dedup: later copies of line runs are deleted, and documents of which no text is left go;
3. near dedup: of each group of near copies the smallest id stays;
4. benchmark decontamination: documents that hold an item go;
5. packing: one row per piece of a document in a sequence.

SQL cannot express the learned classifier, so there is no ORACLE_SQL; tests/llm compare the
stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.llm import decontaminate, line_dedup, near_dedup, packing, quality
from caseload.llm.common import drop_table, free_name, materialize, table

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_bad(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = free_name(docs, "_removed")
    out = line_dedup.drop_repeated_lines(docs, removed_col=removed)
    blank = F.btrim("text", F.lit(line_dedup.ENDS)) == ""
    left = out.where((F.col(removed) == 0) | ~blank)
    n_chars = F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).drop(removed)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole of ``documents``."""
    docs, stored = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        result = materialize(stage(spark, docs, sf_dir))
        if stored is not None:
            drop_table(stored)
        docs = stored = result
    return docs
