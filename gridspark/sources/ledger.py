"""Appends that happen once, however often a job is run.

A table is a folder of attempts and a list of commits.  A job writes its rows to an attempt of its
own under its token and then adds one line to the commits.  Readers take, for each token, the
attempt that was committed first: a job that is repeated, killed half-way or raced by its own
copy adds its rows once, and rows of unfinished attempts are never seen.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_COMMIT = "token string, attempt string, at string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``token, attempt`` that count, one row per token."""
    try:
        rows = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException:  # nothing was committed yet
        rows = spark.createDataFrame([], _COMMIT)
    first = F.min_by("attempt", F.struct("at", "attempt"))
    return rows.groupBy("token").agg(first.alias("attempt"))


def committed(spark: SparkSession, path: str, token: str) -> bool:
    return commits(spark, path).where(F.col("token") == token).limit(1).count() > 0


def write_attempt(df: DataFrame, path: str, token: str, attempt: str) -> None:
    """Rows of an attempt; they are not read before ``commit``."""
    df.withColumns({"token": F.lit(token), "attempt": F.lit(attempt)}).write.partitionBy("token", "attempt").mode("append").parquet(path)


def commit(spark: SparkSession, path: str, token: str, attempt: str) -> None:
    row = [(token, attempt, datetime.now(timezone.utc).isoformat())]
    spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_once(df: DataFrame, path: str, token: str) -> bool:
    """Add ``df`` to the table at ``path`` unless ``token`` was committed before; whether it was added."""
    spark = df.sparkSession
    if committed(spark, path, token):
        return False
    attempt = uuid.uuid4().hex
    write_attempt(df, f"{path}/rows", token, attempt)
    commit(spark, path, token, attempt)
    return True


def read_committed(spark: SparkSession, path: str, schema: str | T.StructType, rows: str = "rows") -> DataFrame:
    """Rows of all committed attempts with their ``token``; files of others are not read."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    schema = T.StructType([*schema.fields, T.StructField("token", T.StringType()), T.StructField("attempt", T.StringType())])
    try:
        found = spark.read.schema(schema).parquet(f"{path}/{rows}")
    except AnalysisException:
        found = spark.createDataFrame([], schema)
    return found.join(commits(spark, path), ["token", "attempt"]).drop("attempt")
