"""From documents to shards of training text: quality rules, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns that they got.
A document may come out of the mixture more than once: as often as the epochs that take it. The last stage adds
``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate as _leaks
from evidentia.llm import minhash, mixing, quality, sharding
from evidentia.llm.common import cut, table, words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, F.size(words(F.col("text"))), mixing.domain_of(F.col("source")))
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Near-duplicates need connected components over hashed bands, which isn't SQL that runs in one statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
