"""Jobs and their accounting as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DELAY = "2 hours"


def job_reports(jobs: DataFrame, accounting: DataFrame, delay: str = DELAY) -> DataFrame:
    """Every logged job with the accounting rows that came within ``delay`` of it, or with NULLs once none can come.

    ``jobs`` is a stream of ``run, job_id, logged_at``, ``accounting`` one of ``job_id, state, reason,
    exit_code, elapsed, reported_at``.  Rows of both may be ``delay`` late against their own stream; state older than that is
    dropped, so it is bounded by what the delay holds.  A job that never reports is put out when
    both streams are past its delay: a stream that falls silent holds the other's answers back.
    """
    left = jobs.withWatermark("logged_at", delay).alias("j")
    right = accounting.withWatermark("reported_at", delay).alias("a")
    near = F.col("a.reported_at").between(F.col("j.logged_at"), F.col("j.logged_at") + F.expr(f"INTERVAL {delay}"))
    joined = left.join(right, (F.col("j.job_id") == F.col("a.job_id")) & near, "left_outer")
    return joined.select("j.run", "j.job_id", "j.logged_at", "a.state", "a.reason", "a.exit_code", "a.elapsed", "a.reported_at")
