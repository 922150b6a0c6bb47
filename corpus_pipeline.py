"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage reads what the one before kept, as Parquet in the folder that all executors share. The stages take null
ids and texts, rows that repeat and extra columns as the operators say that they call; on an empty table each
returns no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, line_dedup, near_dedup, packing, quality
from quillgraph.llm.common import shared_dir, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the net learns from labelled documents that are not held out."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated runs of lines with five words and more."""
    return line_dedup.without_repeats(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: runs of five words, similarity 0.8 and more."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, parameters changed or not."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of 512 to 4,096 words."""
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("line dedup", without_repeated_lines), ("near-duplicates", one_of_each_group), ("decontamination", without_benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written and read again."""
    docs, top = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{top}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt classifier takes part, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None
