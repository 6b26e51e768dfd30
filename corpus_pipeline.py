"""The text pipeline: language, near copies, benchmark leaks, mixing, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's documents. All but the last
return the columns of `documents`; the last adds the shard and the place inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearframe.llm import decontaminate, language, mixing, sharding, simhash
from wearframe.llm.common import aside, staged, words_in


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose words agree on no language."""
    return language.keep_identified(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target words."""
    hidden, place, back = aside(docs)
    mixed = mixing.mix(hidden, words_in(F.col(place["text"])), id_col=place["doc_id"], source_col=place["source"])
    return back(mixing.emit(mixed))


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `shard` and `slot` (columns of these names are replaced)."""
    hidden, place, back = aside(docs)
    return back(sharding.shard(hidden, 8, id_col=place["doc_id"], text_col=place["text"]), "shard", "slot")


STAGES = [
    ("language", keep_known_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", deal_into_shards),
]

#: The language stage learns a model, which SQL cannot express; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
