"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

The first four return the columns of documents; the last adds size, source_size,
target, copies and taken to the documents that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, line_dedup, mixing, near_dedup, quality_mil
from tidemill.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return quality_mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents that consist of nothing else; n_chars follows the text."""
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    return mixing.mixed(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark), ("mixing", mix)]
#: SQL expresses neither the classifier nor the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    s = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = s.save(out) if k < len(STAGES) - 1 else out
    return docs
