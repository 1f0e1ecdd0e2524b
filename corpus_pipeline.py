"""The corpus pipeline: five filtering and mixing stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, linededup, quality, simhash
from tessera.llm.common import fresh_path, table
from tessera.llm.queries import mixture
from tessera.session import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, all of hosts that mostly fail, and those that fail any
    rule unless their host vouches for them."""
    return quality.keep_good_hosts(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them."""
    return linededup.drop_frequent_lines(docs, min_docs=10)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, 128 bits; of texts that share one of their least shingle hashes (as
    those with a similarity of 0.8 do) fingerprints that agree in 0.8 of the bits or more are linked,
    and the document with the smallest id of each group stays. That is a Jaccard similarity of about
    0.69; shingles are not compared."""
    return simhash.drop_near_duplicates(docs, shingle=5, seeds=(42, 43), max_bits=25)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item, edited or not, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed to the target weights; mix_copies says in how many epochs."""
    return mixture(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
]

#: SimHash and the alignment are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read by the next. What a stage wrote
    on the way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
