"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` applies them to
``documents``, writing each result as Parquet in the shared folder and reading it again.

Every stage keeps whole rows of its input, with their own columns; the last adds shard, slot and
size.  What nulls, empty and very long texts, ties and repeated rows give is said by the operators:
texts without twenty words leave at the first stage, so do nulls; of rows with equal texts the one of
the least id goes on, null ids last; repeated rows of it are one.  A null language is not
compared with references, a null source or language has no target share.  An empty table
passes through all stages, and columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import bagminhash, decontaminate, mixing, quality, sharding
from gridspark.llm.common import settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs, quality.references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = settle(mixing.rows_of(docs), "mix-rows")  # texts are counted once, sums are taken of the counts
    return mixing.draw(docs, mixing.Mix(rows))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, with_columns=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("target mix", target_mix),
    ("shards", shards),
]

ORACLE_SQL = None  # trained references and signatures have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
