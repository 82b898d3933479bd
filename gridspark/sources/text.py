"""Log and parameter text as ordered line tables.

``ord`` orders lines as (file, byte start of the file split, row within the task); Spark
reads a split sequentially, so this holds for files of any size without reading one as a
whole.  Several files of a run follow each other by name (numbered segments), or by
modification time where asked.  ``chunk`` is the split, the unit in which ordered
operators work (see ``operators.ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.functions.names import RUN_IN_PATH, run_of_path
from gridspark.sources import ledger


def split_order(by: str = "name") -> list[Column]:
    """What orders file splits: the file (``by`` its ``name`` or ``time``), then the place in it."""
    time = [F.col("_metadata.file_modification_time").alias("time")] if by == "time" else []
    return [*time, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]


def read_lines(spark: SparkSession, paths: str | list[str], run_in_path: str = RUN_IN_PATH,
               by: str = "name") -> DataFrame:
    """Lines of text files with their file, run (from the path), split and order."""
    lines = spark.read.text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.struct(*split_order(by)).alias("chunk"),
        F.struct(*split_order(by), F.monotonically_increasing_id().alias("seq")).alias("ord"),
        F.regexp_replace("value", r"\r$", "").alias("value"),
    ).withColumn("run", run_of_path("file", run_in_path))


def append_job_records(jobs: DataFrame, path: str, token: str) -> bool:
    """Append ``name status id id …`` lines to a job log, once for each ``token``; whether anything was written."""
    line = F.concat_ws(" ", "run", "status", F.array_join("job_ids", " "))
    return ledger.append_once(jobs.select(line.alias("value")), path, token)


def read_job_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a job log that ``append_job_records`` writes."""
    return ledger.read_committed(spark, path, "value string").select("value")
