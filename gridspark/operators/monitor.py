"""Metrics from simulator monitor logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from gridspark.functions.scalars import days, last_number
from gridspark.operators.ordered import carry_forward

#: The name before the equals sign of any monitor line.
METRIC_PATTERN = r"%MON\s+(\w+)\s*="
# The lines shown in a status check.
STATUS_METRICS = "advcfl_wvel_max|time_seconds|dynstat_uvel_max"
BLOCK_METRIC = "time_tsnumber"
TIME_METRIC = "time_secondsf"
CFL_METRICS = {"cfl_u": "advcfl_uvel_max", "cfl_v": "advcfl_vvel_max", "cfl_w": "advcfl_wvel_max"}


def metrics(lines: DataFrame, families: tuple[str, ...] = ()) -> DataFrame:
    """Metric name and value of every monitor line; the value is the line's last token.

    ``families`` keeps only metrics whose name starts with one of them.
    """
    found = lines.withColumn("metric", F.regexp_extract("value", METRIC_PATTERN, 1)).where(F.col("metric") != "")
    if families:
        found = found.where(F.col("metric").rlike("^(?:" + "|".join(families) + ")_"))
    return found.withColumn("value", last_number("value"))


def matching_tail(lines: DataFrame, pattern: str = STATUS_METRICS, n: int = 9) -> DataFrame:
    """Each run's last ``n`` matching lines with their position from the end (1 = last)."""
    from_end = F.row_number().over(Window.partitionBy("run").orderBy(F.col("ord").desc()))
    return lines.where(F.col("value").rlike(pattern)).withColumn("from_end", from_end).where(F.col("from_end") <= n)


def latest(metric_rows: DataFrame) -> DataFrame:
    """Last value per run and metric."""
    return metric_rows.groupBy("run", "metric").agg(F.max_by("value", "ord").alias("value"))


def attach_block(metric_rows: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Adds ``block``: the time-step number whose monitor block each metric belongs to."""
    number = F.when(F.col("metric") == BLOCK_METRIC, F.col("value"))
    return carry_forward(metric_rows, number, ["run"], chunk, "ord", "block")


def blocks(metric_rows: DataFrame, names: list[str], chunk: str = "chunk") -> DataFrame:
    """One row per monitor block with the listed metrics as columns."""
    inside = attach_block(metric_rows, chunk).where(F.col("block").isNotNull())
    return inside.groupBy("run", "block").agg(
        *[F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("ord"))).alias(m)
          for m in names]
    )


def progress(metric_rows: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Latest model time (seconds, days) and CFL numbers per run; runs without output say so."""
    def last_of(metric):
        hit = F.col("metric") == metric
        return F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("ord")))

    out = metric_rows.groupBy("run").agg(
        last_of(TIME_METRIC).alias("model_seconds"), days(last_of(TIME_METRIC)).alias("model_days"),
        *[last_of(m).alias(c) for c, m in CFL_METRICS.items()],
    )
    if runs is not None:
        out = runs.select("run").distinct().join(out, "run", "left")
    note = F.when(F.col("model_days").isNull(), F.lit("no output yet")).otherwise(
        F.format_string("%1.2f days", F.col("model_days"))
    )
    return out.withColumn("note", note)
