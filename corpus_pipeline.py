"""The corpus pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns of its input; the last one adds how often the mix takes each. A stage works on all that the one before it kept.

Null columns, empty and very long texts, ties and repeated rows have the results that the operators state: rows without text fail the quality rules, rows of equal text are one group of near copies of which those of the smallest id stay, the mix returns rows that agree in every column once with their copies added up. An empty table gives an empty result at every stage, and extra columns, whatever their names, stay to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockweave.llm import decontamination, line_dedup, ngram_join, quality_rules, source_mixing
from stockweave.llm.stage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs, min_docs=10, min_chars=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_copies(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]
#: Components, fingerprints and dependent rounding are beyond SQL. The tests hold line dedup, the join, decontamination and the sums and bounds of the mix against brute force, the quality rules against SQL, and run the stages on hard tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
