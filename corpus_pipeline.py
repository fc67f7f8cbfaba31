"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() writes each stage's result as Parquet in
the shared folder and reads it again as the next one's docs, so a lost executor
costs a stage's tasks at most and no lineage grows through the pipeline.

All stages take an empty table, which gives no rows, texts of any length, which are
read whole, and columns of any name beside doc_id and text, which all but the last
stage hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import Scratch
from spanforge.llm.decontamination import decontaminate
from spanforge.llm.near_duplicates import keep_one
from spanforge.llm.packing import pack
from spanforge.llm.quality import keep_clean
from spanforge.llm.substring_dedup import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go; null and empty texts have too few words; equal rows stay or go alike."""
    return keep_clean(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays.

    Texts without words and rows without an id are linked with nothing and stay; of
    rows that repeat both id and text one stays.
    """
    return keep_one(docs, k=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier too are cut out; a document that loses its last word goes.

    Rows from which nothing is cut stay as they are, null and empty texts too; of equal
    documents the smallest id keeps its words.
    """
    return drop_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go; null and empty texts hold none and stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a null or empty text is one end token; equal rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Token ids and near-duplicate components are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
