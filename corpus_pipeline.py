"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding, in that order.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the last: one row for each row with its shard).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, parity_join, shards, suffix_match, toxicity
from tessera.llm.queries import TARGETS, read
from tessera.plans.session import discard, mark, rest, scratch, sweep


def rested(stage: Callable) -> Callable:
    """A stage that begins once executors have given back the heap that those before it have grown."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


@rested
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles, exact copies included, the one of the smallest id stays."""
    return parity_join.keep_one(docs)


@rested
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a verbatim passage of thirteen words of a benchmark item go."""
    return suffix_match.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


@rested
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages under their target share are repeated until the shares fit; every document stays at least once."""
    return mixing.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")), TARGETS)


@rested
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of equal bytes."""
    return shards.assign(docs)


STAGES = [("toxicity", toxic), ("near duplicates", near), ("decontamination", leaks), ("mixing", mixture), ("sharding", sharding)]

#: Two stages are trained models and one iterates; none of them is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written only for itself, and its input, go once its output is there."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{scratch(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            sweep(spark, since)
            if before:
                discard(spark, before)
            before = path
    return docs
