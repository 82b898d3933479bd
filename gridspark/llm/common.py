"""Reading the given tables, and small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.sources.shared import fresh_path, settle

_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say it, its SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, text``: the two keys name a row, also where ids are null or repeat.

    Rows that agree in both keys are equal documents and get equal results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB in this session, unless it has a size of its own: long rows would else fill a worker."""
    if spark.conf.get(_BATCH, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, "4m")


def ordered(df: DataFrame, keys: list[Column], chunk_rows: int, label: str) -> DataFrame:
    """``df`` written in the order of ``keys`` with ``ord`` (long, ascending) and ``chunk`` (runs of about ``chunk_rows`` rows).

    Chunks are ranges of a sampled sort; the row's own number ends the sort key, so that equal
    rows spread over chunks as others do.  The written table fixes ``ord`` for all later reads.
    """
    parts = max(1, -(-df.count() // chunk_rows))
    at = [*keys, F.col("_row")]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *at).sortWithinPartitions(*at).drop("_row")
    rows = settle(rows.withColumn("ord", F.monotonically_increasing_id()), label)
    return rows.withColumn("chunk", F.shiftright("ord", 33))


__all__ = ["ORACLES", "QUERIES", "fresh_path", "keyed", "ordered", "query", "same_row", "settle", "small_batches", "table"]
