"""Queries over scalar functions, names, comments and monitor logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import names, scalars
from gridspark.operators import catalogue, generate, monitor
from gridspark.plans.registry import query, rounded
from gridspark.plans.texts_sql import NAME_PARAMETERS_SQL, PROGRESS_SQL, STATUS_SQL
from gridspark.sources import text

_OMEGA = "(2 * pi() / 3600 / 12.4)"


@query("f01_elementary", uses="cells", sql="""
SELECT run, rec, k, j, i, round(exp(UVEL), 9) AS e, round(sin(UVEL * pi()), 9) AS s, round(sqrt(THETA), 9) AS r, round(log10(KLviscAr), 9) AS l, round(pow(10e0, UVEL), 9) AS p
FROM cells""")
def elementary(t):
    """Elementary functions of fields."""
    u = F.col("UVEL")
    return t.cells.select("run", "rec", "k", "j", "i", F.round(F.exp(u), 9).alias("e"), F.round(F.sin(u * F.pi()), 9).alias("s"),
                          F.round(F.sqrt("THETA"), 9).alias("r"), F.round(F.log10("KLviscAr"), 9).alias("l"),
                          F.round(F.pow(F.lit(10.0), u), 9).alias("p"))


@query("f02_clamps", uses="cells", sql="""
SELECT run, rec, k, j, i, CASE WHEN KLeps < 1e-5 THEN 1e-5 ELSE KLeps END AS floored, greatest(UVEL, -0.25) AS clipped FROM cells""")
def clamps(t):
    """Floor and clip."""
    return t.cells.select("run", "rec", "k", "j", "i", scalars.floor_at("KLeps", 1e-5).alias("floored"),
                          F.greatest("UVEL", F.lit(-0.25)).alias("clipped"))


@query("f03_rounding", uses="cells", sql="""
SELECT run, rec, k, j, i, round_even(THETA * 2, 0) AS even, ceil(THETA * 2) AS up FROM cells""")
def rounding(t):
    """Half-even rounding and ceiling."""
    return t.cells.select("run", "rec", "k", "j", "i", scalars.half_even(F.col("THETA") * 2).alias("even"),
                          scalars.ceiling(F.col("THETA") * 2).alias("up"))


@query("f04_wave_slope", uses="spec", sql=f"""
SELECT run, round({_OMEGA}, 12) AS omega, round(sqrt(({_OMEGA}*{_OMEGA} - 1e-4*1e-4) / (N0*N0 - {_OMEGA}*{_OMEGA})), 9) AS slope,
  round(steepness * sqrt(({_OMEGA}*{_OMEGA} - 1e-4*1e-4) / (N0*N0 - {_OMEGA}*{_OMEGA})), 9) AS dhdx FROM spec""")
def wave_slope(t):
    """Tidal frequency, ray slope and seafloor slope per run."""
    omega = scalars.tidal_frequency()
    slope = scalars.wave_slope(omega, F.lit(1e-4), "N0")
    return t.spec.select("run", F.round(omega, 12).alias("omega"), F.round(slope, 9).alias("slope"),
                         F.round(scalars.seafloor_slope("steepness", slope), 9).alias("dhdx"))


@query("f05_drag_scaling", uses="spec", sql="""
SELECT run, round(1e6 * N0 * u0*u0 * (H/10)*(H/10) * pi() / 2 / 1e5, 6) AS drag_1,
  round(1e6 * N0 * u0*u0 * (H/10)*(H/10) * pi() / 2 / 1e5 * (1 + pi() * u0 / N0 / (H/10)), 6) AS drag_2, round(u0 / N0 / (H/10), 9) AS inverse_froude FROM spec""")
def drag_scaling(t):
    """First and second order drag scaling."""
    runs = t.spec.select("run", "N0", "u0", (F.col("H") / 10).alias("h"), F.lit(1e5).alias("lam"))
    out = catalogue.drag_comparison(runs, "N0", "u0", "h", "lam")
    return out.select("run", F.round("drag_1", 6).alias("drag_1"), F.round("drag_2", 6).alias("drag_2"), F.round("inverse_froude", 9).alias("inverse_froude"))


@query("f06_wavelength", uses="spec", sql="""
SELECT run, round(2 * pi() / (nx * 1e-4 / 10) * 3, 6) AS lam, round(u0 / N0 / steepness, 9) AS fr FROM spec""")
def wavelength(t):
    """Wavelength of a wavenumber index and inverse Froude number."""
    return t.spec.select("run", F.round(scalars.wavelength("nx"), 6).alias("lam"),
                         F.round(scalars.inverse_froude("u0", "N0", "steepness"), 9).alias("fr"))


@query("f07_days", uses="cells", sql="SELECT DISTINCT run, rec, time_s / 24 / 3600 AS days FROM cells")
def days(t):
    """Seconds as days."""
    return t.records.select("run", "rec", scalars.days("time_s").alias("days"))


@query("f08_run_label", sql="SELECT s_suppkey, 'Line' || format('{:03d}', s_suppkey) AS label FROM supplier")
def run_label(t):
    """Zero-padded run names."""
    return t.given("supplier").select("s_suppkey", names.run_label("Line", "s_suppkey").alias("label"))


@query("f09_name_parameters", uses="names", sql=NAME_PARAMETERS_SQL)
def name_parameters(t):
    """Parameters decoded from run names, missing where absent."""
    return catalogue.decoded_names(t.names).select("run", "s_suppkey", "U_raw", "U0", "N_raw", "N0", "height", "f0", "B", "alpha", "flow")


@query("f10_comment_parameters", uses="run_log", sql="""
SELECT run, comment, CAST(rtrim(regexp_extract(comment, 'alpha ?= ?(-?[0-9.]+)', 1), '.') AS DOUBLE) AS alpha,
  CAST(NULL AS DOUBLE) AS dhdx, CAST(rtrim(regexp_extract(comment, 'u_0 ?= ?(-?[0-9.]+)', 1), '.') AS DOUBLE) AS u_0,
  CAST(regexp_extract(comment, 'N_0 ?= ?(-?[0-9.]+)', 1) AS DOUBLE) AS N_0,
  CASE WHEN comment LIKE '%const strat%' THEN 'const' ELSE 'exp' END AS strat FROM run_log""")
def comment_parameters(t):
    """Parameters written in run-log comments."""
    entries = catalogue.run_log_entries(t.run_log_lines)
    return catalogue.decoded_comments(entries.select("run", "comment"))


@query("f11_last_number", uses="log_lines", sql="SELECT run, ord, CAST(regexp_extract(value, '(\\S+)$', 1) AS DOUBLE) AS number FROM log_lines")
def last_number(t):
    """Last token of a line as a number."""
    return t.log_lines.select("run", "ord", scalars.last_number("value").alias("number"))


@query("f12_timestamps", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def timestamps(t):
    """Timestamps formatted and parsed back."""
    stamp = names.format_stamp("ts")
    return t.given("events").select("event_id", stamp.alias("stamp"), F.unix_seconds(names.parse_stamp(stamp)).alias("seconds"))


@query("f13_fixed_text", sql="SELECT event_id, printf('%.2f', floor(value)) AS two, printf('%.3e', floor(value)) AS sci FROM events")
def fixed_text(t):
    """Fixed-decimal and scientific text."""
    whole = F.floor("value").cast("double")
    return t.given("events").select("event_id", scalars.fixed(whole).alias("two"), scalars.scientific(whole).alias("sci"))


@query("f14_job_labels", uses="job_log accounting", sql=f"SELECT ord, job_states FROM ({STATUS_SQL})")
def job_labels(t):
    """Status text of each job-log line."""
    return catalogue.job_status(catalogue.job_records(t.job_lines), t.accounting).select("ord", "job_states")


@query("f15_run_of_path", sql="SELECT event_id, 'Run' || CAST(user_id % 20 AS VARCHAR) AS run FROM events")
def run_of_path(t):
    """Run name inside a results path."""
    path = F.concat(F.lit("../results/Run"), F.col("user_id") % 20, F.lit("/input/STDOUT"))
    return t.given("events").select("event_id", names.run_of_path(path).alias("run"))


# --- monitor logs ----------------------------------------------------------


@query("l01_metrics", uses="metrics", sql="SELECT run, ord, metric, value FROM metrics WHERE metric <> ''")
def log_metrics(t):
    """Metric name and value per line."""
    return monitor.metrics(t.log_lines).select("run", "ord", "metric", "value")


@query("l01_metrics_from_files", uses="metrics", sql="""
SELECT run, metric, arg_max(value, ord) AS value, CAST(COUNT(*) AS BIGINT) AS n FROM metrics GROUP BY run, metric""")
def metrics_from_files(t):
    """The same from text files, ordered by file split and row."""
    lines = text.read_lines(t.spark, t.log_folder + "/*", r"run=([^/]+)/")
    rows = monitor.metrics(lines)
    return rows.groupBy("run", "metric").agg(F.max_by("value", "ord").alias("value"), F.count("*").alias("n"))


@query("l02_metric_blocks", uses="metrics", sql="""
SELECT run, ord, metric, value, last_value(CASE WHEN metric = 'time_tsnumber' THEN value END IGNORE NULLS)
  OVER (PARTITION BY run ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block FROM metrics""")
def metric_blocks(t):
    """Each metric with the time step of its monitor block."""
    return monitor.attach_block(monitor.metrics(t.log_lines)).select("run", "ord", "metric", "value", "block")


@query("l02_block_table", uses="metrics", sql="""
WITH b AS (SELECT *, last_value(CASE WHEN metric = 'time_tsnumber' THEN value END IGNORE NULLS)
  OVER (PARTITION BY run ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block FROM metrics)
SELECT run, block, arg_max(value, ord) FILTER (metric = 'time_secondsf') AS time_secondsf,
  arg_max(value, ord) FILTER (metric = 'advcfl_uvel_max') AS advcfl_uvel_max FROM b WHERE block IS NOT NULL GROUP BY run, block""")
def block_table(t):
    """One row per monitor block."""
    return monitor.blocks(monitor.metrics(t.log_lines), ["time_secondsf", "advcfl_uvel_max"])


@query("l03_progress", uses="metrics", sql=f"{PROGRESS_SQL} UNION ALL SELECT 'none', NULL, NULL, NULL, NULL, NULL, 'no output yet'")
def progress(t):
    """Model days and CFL numbers per run; a run without output says so."""
    runs = t.log_lines.select("run").distinct()
    runs = runs.select(F.explode(F.array("run", F.lit("none"))).alias("run"))
    return monitor.progress(monitor.metrics(t.log_lines), runs)


@query("l04_job_status", uses="job_log accounting", sql=STATUS_SQL)
def job_status(t):
    """Job states and ids per job-log line."""
    return catalogue.job_status(catalogue.job_records(t.job_lines), t.accounting)


@query("l05_log_frequency", uses="run_log", sql="""
SELECT run, CAST(COUNT(*) AS BIGINT) AS entries, strftime(min(logged_at), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(max(logged_at), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(COUNT(DISTINCT comment) AS BIGINT) AS comments FROM run_log GROUP BY run""")
def log_frequency(t):
    """Run-log entries, span and distinct comments per run."""
    out = catalogue.log_frequency(catalogue.run_log_entries(t.run_log_lines))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("l05_comment_changes", uses="entries", sql="""
WITH e AS (SELECT *, line1 || ' ' || line2 AS comment FROM entries),
c AS (SELECT run, file, event_id, logged_at, comment, lag(comment) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY run ORDER BY logged_at, file, event_id))
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY n) AS BIGINT) AS change, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged_at, comment, before
FROM c WHERE n = 1 OR comment IS DISTINCT FROM before""")
def comment_changes(t):
    """When each run's comment changed, and from what."""
    entries = catalogue.run_log_entries(t.run_log_lines).withColumn("place", F.struct("file", "ord"))
    out = catalogue.comment_changes(entries, "place")
    return out.select("run", "change", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "comment", "before")
