"""Written intermediate tables in the cluster's shared folder.

A small reduced table that is joined back to cell rows is first written and
re-read ("settled").  That cuts its lineage durably, keeps the cells from being
re-reduced, and - because the re-read table has true file sizes - lets Spark's
own size check decide: at or below ``spark.sql.autoBroadcastJoinThreshold`` the
join is a broadcast, beyond it a shuffled join with adaptive skew handling.
No operator in this package forces a broadcast by hint.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="gridspark-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)  # scratch of local mode only
    return _local_dir


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one."""
    return f"{shared_dir(spark)}/gridspark-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's folder."""
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_settled(spark: SparkSession) -> bool:
    """Delete what this application settled; whether there was anything.

    For the end of a run, once its results are written elsewhere: tables that were read from settled ones cannot be read again.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the re-read table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
