"""Window averages kept as partial sums, so that new records cost only their own reading.

The table holds sums and counts by window and cell, one part per batch of records, and the
records of each part.  Adding takes the records that no committed part has, reads their cells
alone, and appends through the ledger: a repeated or killed job adds nothing twice.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark import constants as C
from gridspark.operators.timewin import event_time, time_window
from gridspark.sources import ledger
from gridspark.sources.shared import settle

_RECORD = ["run", "stream", "iter"]


def _sums_schema(fields: list[str]) -> str:
    return "t0 bigint, run string, k int, j int, i int, " + ", ".join(f"{f}__s double, {f}__n bigint" for f in fields) + ", n bigint"


def known_records(spark: SparkSession, path: str) -> DataFrame:
    """Records that the sums hold."""
    return ledger.read_committed(spark, path, "run string, stream string, iter bigint", "records").select(*_RECORD)


def add_records(cells: DataFrame, records: DataFrame, path: str, fields: list[str], period: float = C.TIDE_SECONDS, phase: float = 0.0) -> int:
    """Add the cells of all ``records`` (``run, stream, iter``) that the table at ``path`` lacks; their number.

    The part's name follows from its records, so two jobs that add the same ones add one part.
    """
    spark = cells.sparkSession
    new = settle(records.select(*_RECORD).distinct().join(known_records(spark, path), _RECORD, "left_anti"), "new-records")
    digest = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*_RECORD).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(*_RECORD, F.lit(1))).alias("b"),
                     F.min("iter").alias("low"), F.max("iter").alias("high")).first()
    if not digest["n"]:
        return 0
    token = hashlib.sha256(f"{digest['n']}:{digest['a']}:{digest['b']}".encode()).hexdigest()[:32]
    attempt = uuid.uuid4().hex
    # the range is a filter on both sides: files outside are left out at once, others by the records joined at run time
    near = F.col("iter").between(digest["low"], digest["high"])
    rows = cells.where(near).join(new.where(near), _RECORD, "left_semi").withColumn("ts", event_time())
    sums = [s for f in fields for s in (F.sum(f).alias(f"{f}__s"), F.count(f).alias(f"{f}__n"))]
    grouped = rows.groupBy(time_window("ts", period, phase).alias("w"), "run", *[F.col(a).cast("int").alias(a) for a in "kji"]).agg(*sums, F.count("*").alias("n"))
    part = grouped.select(F.unix_seconds("w.start").alias("t0"), "run", "k", "j", "i", *[f"{f}__{x}" for f in fields for x in "sn"], "n")
    ledger.write_attempt(part, f"{path}/sums", token, attempt)
    ledger.write_attempt(new, f"{path}/records", token, attempt)
    ledger.commit(spark, path, token, attempt)
    return digest["n"]


def averages(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """``t0, run, k, j, i``, the fields' means and the number of records, from all parts."""
    parts = ledger.read_committed(spark, path, _sums_schema(fields), "sums")
    merged = parts.groupBy("t0", "run", "k", "j", "i").agg(*[F.sum(f"{f}__{x}").alias(f"{f}__{x}") for f in fields for x in "sn"], F.sum("n").alias("n"))
    return merged.select("t0", "run", "k", "j", "i", *[F.try_divide(f"{f}__s", f"{f}__n").alias(f) for f in fields], "n")
