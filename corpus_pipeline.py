"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing and segmentation, over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm.common import shared_dir
from siteloom.llm.minhash import keep_one_of_each
from siteloom.llm.mixing import resample
from siteloom.llm.pieces import segment
from siteloom.llm.pii import sanitise
from siteloom.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it become tags or go; n_chars is left as it was."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The N best segmentations of each document."""
    return segment(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_dedup), ("PII", pii), ("mixing", mixing), ("SentencePiece", tokens)]

#: Iterative stages (components, Newton steps) and segmentation are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        docs = spark.read.parquet(path)
    return docs
