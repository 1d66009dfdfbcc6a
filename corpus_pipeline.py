"""Corpus pipeline: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written and read again before the next. A stage keeps whole rows; mixing repeats those that it
takes twice; sharding adds the shard and the place in it. Nulls, ties, repeated rows and empty
tables are handled as each stage's operator says; columns beyond those of documents come along
whatever their names, but for those named shard, slot or grown_shard, which sharding replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import drop_table, shared_table
from framewright.llm.decontaminate import without_contaminated
from framewright.llm.mixing import mixed_rows
from framewright.llm.quality_classifier import fit_quality
from framewright.llm.sharding import sharded_rows
from framewright.llm.simhash import one_of_each

SHARDS = 24


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = fit_quality(docs)
    return docs.filter(model.score(F.col("text").cast("string")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id."""
    return one_of_each(docs, width=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, of 150 % of the words: each document as often as it is taken."""
    return mixed_rows(docs, share=1.5, weights=(3, 1, 2), cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and place."""
    return sharded_rows(docs, weights=(1.0,) * SHARDS)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: SQL can't express the trained and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of the tables between them only the last stays, which the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs)
            if before is not None:
                drop_table(before)
            before = docs
    return docs
