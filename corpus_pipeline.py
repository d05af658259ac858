"""A corpus pipeline: reject bad texts, drop exact and near copies, drop test items, mix the sources.

Each stage takes (spark, docs, directory of the tables) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes what a stage returns and reads it again for the next one, so that a lost executor costs one
stage at most. Defined results for odd rows are those of the operators; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import decontam, exact, mixing, near, quality
from callscope.plans.storage import written


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one row of equal texts stays."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of linked texts stays."""
    return near.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks, with the figures of the mix."""
    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("quality classifier", drop_bad),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources", mix_sources),
]

#: Perplexities, similarity joins and passages have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
