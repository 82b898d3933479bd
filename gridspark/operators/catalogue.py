"""Run catalogue: run-log entries, job records, parameter files, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from gridspark.functions.names import (
    STAMP_PATTERN, comment_parameters, job_label, name_parameters, parse_stamp, run_of_path,
)
from gridspark.functions.scalars import inverse_froude, drag_first_order, drag_second_order
from gridspark.operators.ordered import carry_forward, previous
from gridspark.sources.shared import settle


# --- run log ---------------------------------------------------------------

def run_log_entries(lines: DataFrame, keys=("file",), chunk: str = "chunk", order: str = "ord") -> DataFrame:
    """Entries (timestamp line, path line, comment lines) from ordered log lines.

    An entry is known by the position of its timestamp line, carried forward to its
    other lines, so entries may straddle file splits and no file is read as a whole.
    """
    keys = list(keys)
    start = F.when(F.col("value").rlike(STAMP_PATTERN), F.struct(F.col(order).alias("at"), F.trim("value").alias("stamp")))
    marked = carry_forward(lines, start, keys, chunk, order, "entry")
    is_text = (F.col(order) > F.col("entry.at")) & (F.trim("value") != "")
    grouped = marked.where(F.col("entry").isNotNull()).groupBy(*keys, "entry").agg(
        F.array_sort(F.collect_list(F.when(is_text, F.struct(F.col(order).alias("o"), F.col("value").alias("v"))))).alias("text"),
    )
    # Only the line after the stamp is a path; a comment may mention one.
    first = F.get("text", F.lit(0))["v"]
    grouped = grouped.withColumn("path", F.when(first.rlike("results/[^/]+/"), first))
    words = F.filter("text", lambda t, n: (n > 0) | F.col("path").isNull())
    comment = F.array_join(F.transform(words, lambda t: F.trim(t["v"])), " ")
    return grouped.select(
        *keys, parse_stamp("entry.stamp").alias("logged_at"), run_of_path("path").alias("run"),
        comment.alias("comment"), F.col("entry.at").alias(order),
    )


def latest_entry(run_log: DataFrame) -> DataFrame:
    """Newest log entry of each run."""
    newest = F.max_by(F.struct("logged_at", "comment"), F.struct("logged_at", "comment"))
    return run_log.groupBy("run").agg(newest.alias("e")).select("run", "e.*")


def log_frequency(run_log: DataFrame) -> DataFrame:
    """Entries per run, first and last time seen, and number of different comments."""
    return run_log.groupBy("run").agg(
        F.count("*").alias("entries"), F.min("logged_at").alias("first_seen"),
        F.max("logged_at").alias("last_seen"), F.count_distinct("comment").alias("comments"),
    )


def comment_changes(run_log: DataFrame, place: str = "ord") -> DataFrame:
    """Entries whose comment differs from that of their run's entry before, with their number per run.

    ``A, B, A`` are three changes, the first entry being one.  Entries follow each other by time, then
    ``place``; they are compared in chunks of a day, so a run that holds most entries is no window.
    """
    order = F.struct("logged_at", place)
    rows = run_log.withColumns({"_at": order, "_day": F.to_date("logged_at")})
    rows = previous(rows, "comment", ["run"], "_day", "_at", "_before")
    kept = rows.where(F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("comment")))
    numbered = _numbered(kept)
    return numbered.select("run", "change", "logged_at", "comment", F.col("_before.value").alias("before"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``change``: position of each row in its run, counted by day and then within the day."""
    inside = F.row_number().over(Window.partitionBy("run", "_day").orderBy("_at"))
    days_ = rows.groupBy("run", "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("run").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days_.select(F.col("run").alias("_run"), F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    same = F.col("run").eqNullSafe(F.col("_run")) & F.col("_day").eqNullSafe(F.col("_d"))
    return rows.withColumn("_nth", inside).join(offsets, same).withColumn("change", F.col("_offset") + F.col("_nth"))


def decoded_comments(run_log: DataFrame) -> DataFrame:
    return run_log.select("*", *comment_parameters("comment"))


# --- job log ---------------------------------------------------------------

def job_records(lines: DataFrame) -> DataFrame:
    """``name status id id …`` lines as run, status and an array of job ids."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(parts) >= 2).select(
        *[c for c in lines.columns if c != "value"],
        F.element_at(parts, 1).alias("run"), F.element_at(parts, 2).alias("status"),
        F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("job_ids"),
    )


def job_status(jobs: DataFrame, accounting: DataFrame, line: str = "ord") -> DataFrame:
    """One status text and one id text per job-log line, ids in written order, with the
    elapsed time of the line's last running job.

    Grouping is by log line, so a group holds only the ids written on that line.  Lines
    without ids stay out of the join, where they would all meet under one missing key.
    Jobs travel as accounted and are worded once, after grouping.
    """
    ids = jobs.select(line, "run", F.posexplode("job_ids").alias("pos", "job_id"))
    known = ids.join(accounting.select("job_id", "state", "reason", "exit_code", "elapsed"), "job_id", "left")
    job = F.struct("pos", "job_id", "state", "reason", "exit_code", "elapsed")
    grouped = known.groupBy(line, "run").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    bare = jobs.where("coalesce(size(job_ids), 0) <= 0").select(line, "run")
    bare = bare.distinct().withColumn("jobs", F.array().cast(grouped.schema["jobs"].dataType))
    first = F.get(F.transform(F.filter("jobs", lambda x: x["state"] == "PENDING"), lambda x: x["pos"]), F.lit(0))
    running = F.filter("jobs", lambda x: x["state"] == "RUNNING")

    def text(x):
        return job_label(x["job_id"], x["state"], x["reason"], x["exit_code"], x["pos"].eqNullSafe(F.col("first")))

    rows = grouped.unionByName(bare).withColumns({"first": first, "_running": running})
    return rows.select(
        line, "run", F.array_join(F.transform("jobs", text), "  ").alias("job_states"),
        F.array_join(F.transform("jobs", lambda x: x["job_id"]), " ").alias("job_ids"), (F.size("_running") > 0).alias("running"),
        F.try_element_at("_running", F.lit(-1))["elapsed"].alias("elapsed"),
    )


def job_overview(jobs: DataFrame, accounting: DataFrame, progress: DataFrame, line: str = "ord") -> DataFrame:
    """Job status per line with the run's latest model time and CFL numbers where it is running."""
    status = job_status(jobs, accounting, line)
    return status.join(settle(progress, "progress"), "run", "left")  # a row per run: its true size decides the join


# --- parameter files -------------------------------------------------------

def harvest_parameters(lines: DataFrame, keys=("run", "file"), chunk: str = "chunk", order: str = "ord") -> DataFrame:
    """``name=value,`` lines of namelist files with their group; continuation lines are joined on.

    ``#`` starts a comment line, ``&GROUP`` opens a group and ``/`` closes it.
    """
    keys = list(keys)
    text = F.trim("value")
    live = lines.where(~text.startswith("#") & (text != ""))
    group = F.when(text.rlike(r"^[&/]"), F.regexp_extract(text, r"^&(\w+)", 1))
    named = r"^([A-Za-z]\w*(?:\([^)]*\))?)\s*=\s*(.*)$"
    begins = F.when(text.rlike(r"^[&/]"), F.struct(F.col(order).alias("at"), F.lit("").alias("name")))
    begins = begins.when(text.rlike(named), F.struct(F.col(order).alias("at"), F.regexp_extract(text, named, 1).alias("name")))
    marked = carry_forward(live, group, keys, chunk, order, "grp")
    marked = carry_forward(marked, begins, keys, chunk, order, "item")
    piece = F.when(text.rlike(named), F.regexp_extract(text, named, 2)).otherwise(text)
    rows = marked.where((F.col("grp") != "") & (F.col("item.name") != "") & ~text.rlike(r"^[&/]"))
    joined = rows.groupBy(*keys, "grp", "item").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("v")))).alias("pieces")
    )
    value = F.array_join(F.transform("pieces", lambda p: p["v"]), " ")
    return joined.select(*keys, "grp", F.col("item.name").alias("name"),
                         F.regexp_replace(F.trim(value), r"\s*[,/]\s*$", "").alias("value"))


def flag(value):
    """``.TRUE.``/``.FALSE.`` as a boolean, NULL for other text."""
    text = F.upper(F.trim(F.col(value) if isinstance(value, str) else value))
    return F.when(text == ".TRUE.", F.lit(True)).when(text == ".FALSE.", F.lit(False))


# --- sweeps ----------------------------------------------------------------

def decoded_names(runs: DataFrame, run: str = "run") -> DataFrame:
    return runs.select("*", *name_parameters(run))


def sweep(totals: DataFrame, parameters: DataFrame) -> DataFrame:
    """Reduced results beside the parameters of their run."""
    return totals.join(parameters, "run")


def drag_comparison(runs: DataFrame, stratification="N0", u0="U0", height="height", length="length") -> DataFrame:
    """First and second order drag scalings and inverse Froude number per run."""
    args = (stratification, u0, height, length)
    return runs.select(
        "*", drag_first_order(*args).alias("drag_1"), drag_second_order(*args).alias("drag_2"),
        inverse_froude(u0, stratification, height).alias("inverse_froude"),
    )
