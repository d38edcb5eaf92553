"""A corpus pipeline of five stages: language, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitesift.llm import language
from sitesift.llm.decontaminate import without_leaks
from sitesift.llm.kd_shards import kd_shards
from sitesift.llm.pfair import pfair_mix
from sitesift.llm.similar_texts import keep_one_of_similar
from sitesift.session import write_and_read

SHARDS = 40


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that no model explains go."""
    return language.keep_identified(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return keep_one_of_similar(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture."""
    return pfair_mix(docs).orderBy("seq").select(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it; slots keep the order of the mixture."""
    return kd_shards(docs, SHARDS, as_written=True)


STAGES = [
    ("language", keep_identified),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_unleaked),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Trained models, fingerprints and trees have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
