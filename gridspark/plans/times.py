"""Queries over model-time windows, streams and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import incremental, layers, monitor, spectra, timewin
from gridspark.plans.registry import query
from gridspark.plans.tables import OTHER_METRICS
from gridspark.sources import tail
from gridspark.sources.shared import fresh_path
from gridspark.streaming import blocks, jobs, live, restarts

JOBS_PER_FILE, FILES_PER_BATCH = 500_000, 8  #: of job streams; the join's state holds a few batches


@query("x01_tidal_average", uses="cells", sql="""
SELECT CAST(floor(time_s / 44640) * 44640 AS BIGINT) AS t0, run, k, j, i, AVG(UVEL) AS UVEL, AVG(THETA) AS THETA, CAST(COUNT(*) AS BIGINT) AS n
FROM cells GROUP BY ALL""")
def tidal_average(t):
    """Whole tidal period means per cell."""
    return timewin.tidal_average(t.columns, ["UVEL", "THETA"])


@query("x01_incremental_average", uses="cells", sql="""
SELECT CAST(floor(time_s / 44640) * 44640 AS BIGINT) AS t0, run, k, j, i, AVG(UVEL) AS UVEL, AVG(THETA) AS THETA, CAST(COUNT(*) AS BIGINT) AS n
FROM cells GROUP BY ALL""")
def incremental_average(t):
    """The same from partial sums: records added in parts, one part again by a repeated job."""
    path = fresh_path(t.spark, "tidal-sums")
    cells = t.cells.select("run", "stream", "rec", "iter", "time_s", "k", "j", "i", "UVEL", "THETA")
    for part in (t.records.where("pos % 3 = 0"), t.records.where("pos <> 1"), t.records.where("pos <> 1"), t.records):
        incremental.add_records(cells, part, path, ["UVEL", "THETA"])
    return incremental.averages(t.spark, path, ["UVEL", "THETA"])


def _series(t):
    return t.series.withColumn("time_s", F.col("t").cast("double")).withColumn("v", F.col("v").cast("double"))


@query("x01_tidal_average_series", uses="series", sql="""
SELECT (t // 44640) * 44640 AS t0, run, metric, AVG(v) AS v, CAST(COUNT(*) AS BIGINT) AS n FROM series GROUP BY ALL""")
def tidal_average_series(t):
    """Whole tidal period means of a scalar series."""
    return timewin.tidal_average(_series(t), ["v"], keys=("run", "metric"))


@query("x02_shifted_average", uses="series", sql="""
SELECT ((t - 930) // 1860) * 1860 + 930 AS t0, run, metric, AVG(v) AS v, CAST(COUNT(*) AS BIGINT) AS n FROM series GROUP BY ALL""")
def shifted_average(t):
    """Means over windows shifted by half an interval."""
    return timewin.shifted_average(_series(t), ["v"], keys=("run", "metric"))


@query("x03_snapshots", uses="cells", sql="SELECT run, rec, k, j, i, time_s, UVEL FROM cells WHERE CAST(time_s AS BIGINT) % 44640 = 0")
def snapshots(t):
    """Records on the sampling interval."""
    return timewin.snapshots(t.cells, 44640.0).select("run", "rec", "k", "j", "i", "time_s", "UVEL")


@query("x03_latest_in_window", uses="series", sql="""
SELECT (t // 1860) * 1860 AS t0, run, metric, arg_max(v, event_id) AS v, max(event_id) AS event_id FROM series GROUP BY ALL""")
def latest_in_window(t):
    """Each interval's latest row of an irregular series."""
    rows = t.series.withColumn("ts", timewin.event_time("t"))
    return timewin.latest_in_window(rows, ["run", "metric"], ["v", "event_id"], 1860.0, order="event_id")


@query("x04_layer_average", uses="cells grid1d", sql="""
WITH l AS (SELECT run, rec, j, i, CAST(greatest(0, least(11, floor((THETA - lo) * 12 / (hi - lo)))) AS INT) AS layer, SUM(UVEL*hFacW*drF) AS uh, SUM(hFacW*drF) AS h
  FROM cells JOIN grid1d USING (run, k) JOIN (SELECT run, min(T0) AS lo, max(T0) AS hi FROM grid1d GROUP BY run) USING (run)
  WHERE THETA IS NOT NULL AND hFacW > 0 GROUP BY ALL)
SELECT CAST(rec // 2 * 44640 AS BIGINT) AS t0, run, j, i, layer, AVG(uh) AS uh, AVG(h) AS h, CAST(COUNT(*) AS BIGINT) AS n FROM l GROUP BY ALL""")
def layer_average(t):
    """Tidal means of layer transport."""
    binned = layers.layer_transport(t.columns, t.grid1d, bins=12)
    times = t.records.select("run", "rec", "time_s")
    return timewin.tidal_average(binned.join(times, ["run", "rec"]), ["uh", "h"], keys=("run", "j", "i", "layer"))


@query("x05_phase_composite", uses="series", sql="""
SELECT run, metric, CAST((t % 44640) // 1240 AS INT) AS phase, AVG(v) AS v FROM series GROUP BY ALL""")
def phase_composite(t):
    """Means by tidal phase."""
    return timewin.phase_composite(_series(t), ["run", "metric"], ["v"])


# --- streams ---------------------------------------------------------------


def _event_stream(t):
    """The event table as a file stream with event time."""
    schema = t.given("events").schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return source.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("run"), F.col("user_id") % 8).alias("run"),
                         F.col("event_type").alias("metric"), "event_id", F.floor(F.col("value") * 100 + 0.5).cast("double").alias("v"))


@query("x06_live_monitor", uses="metrics", sql="""
SELECT run, metric, arg_max(value, ord) AS value FROM metrics GROUP BY run, metric""")
def live_monitor(t):
    """Latest metric per run kept as streaming state."""
    lines = _event_stream(t).select("run", F.col("event_id").alias("ord"), F.concat(
        F.lit("%MON "), F.expr("CASE metric WHEN 'click' THEN 'time_tsnumber' WHEN 'view' THEN 'time_secondsf' WHEN 'purchase' THEN "
                               "'advcfl_uvel_max' WHEN 'error' THEN 'advcfl_wvel_max' ELSE " + OTHER_METRICS + " END"),
        F.lit(" = "), F.col("v").cast("bigint"), F.lit("E-02")).alias("value"))
    updates = live.drain(live.live_metrics(lines), "live", mode="update")
    return live.latest_batch_per_key(updates, ["run", "metric"])


@query("x06_live_monitor_files", uses="metrics", sql="""
SELECT run, metric, arg_max(value, ord) AS value FROM metrics GROUP BY run, metric""")
def live_monitor_files(t):
    """Latest metric per run from log files arriving batch by batch."""
    updates = live.watch_log_files(live.log_stream(t.spark, t.log_folder, 3, r"run=([^/]+)/"), "live-files")
    return monitor.latest(updates)


@query("x06_live_monitor_growing", uses="metrics", sql="""
SELECT run, metric, arg_max(value, ord) AS value FROM metrics GROUP BY run, metric""")
def live_monitor_growing(t):
    """The same from logs that may keep growing, as streaming state over their offsets."""
    lines = tail.growing_lines(t.spark, t.log_folder, r"run=([^/]+)/", r"part-[^/]*$")
    updates = live.drain(live.live_metrics(lines), "live-growing", mode="update")
    return live.latest_batch_per_key(updates, ["run", "metric"])


@query("l02_streaming_blocks", uses="metrics", sql="""
WITH b AS (SELECT *, last_value(CASE WHEN metric = 'time_tsnumber' THEN value END IGNORE NULLS)
  OVER (PARTITION BY run ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block FROM metrics)
SELECT run, block, arg_max(value, ord) FILTER (metric = 'time_secondsf') AS time_secondsf,
  arg_max(value, ord) FILTER (metric = 'advcfl_uvel_max') AS advcfl_uvel_max FROM b WHERE block IS NOT NULL GROUP BY run, block""")
def streaming_blocks(t):
    """Monitor blocks of growing logs read in limited batches, blocks kept open between them."""
    size = t.spark.read.text(t.log_folder).select(F.sum(F.length("value") + 1)).first()[0]
    lines = tail.growing_lines(t.spark, t.log_folder, r"run=([^/]+)/", r"part-[^/]*$", bytes_per_trigger=max(size // 5, 1))
    rows = monitor.metrics(lines.withColumn("ord", blocks.place(("ord.file", False), ("ord.start", True))))
    names = ["time_secondsf", "advcfl_uvel_max"]
    return blocks.whole_blocks(live.drain(blocks.stream_blocks(rows, names), "blocks", mode="update", limited=True, timeouts=True), names)


@query("x07_streaming_average", uses="series", sql="""
SELECT * FROM (SELECT (t // 44640) * 44640 AS t0, run, metric, AVG(CAST(v AS DOUBLE)) AS v, CAST(COUNT(*) AS BIGINT) AS n FROM series GROUP BY ALL)
WHERE t0 + 44640 <= (SELECT epoch(max(ts)) - 7200 FROM events)""")
def streaming_average(t):
    """Tidal means of a stream; windows closed by the watermark."""
    return live.drain(live.streaming_average(_event_stream(t), ["run", "metric"], ["v"], 44640.0), "closed-windows")


@query("x08_drop_repeats", uses="series", sql="""
SELECT run, metric, CAST(COUNT(*) AS BIGINT) AS n, SUM(CAST(v AS DOUBLE)) AS v FROM series GROUP BY run, metric""")
def drop_repeats(t):
    """A stream in which every row comes twice, reduced to one."""
    twice = _event_stream(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    kept = live.drain(live.drop_repeats(twice, ["run", "event_id"]), "repeats")
    return kept.groupBy("run", "metric").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("x08_later_segment", uses="cells", sql="""
WITH seg AS (SELECT run, iter, k, j, i, THETA, 0 AS segment FROM cells WHERE rec <= 3
  UNION ALL SELECT run, iter, k, j, i, THETA + 1 AS THETA, 1 FROM cells WHERE rec >= 3)
SELECT * FROM seg QUALIFY rank() OVER (PARTITION BY run, iter ORDER BY segment DESC) = 1""")
def later_segment(t):
    """Repeated records of restart segments on a stream of records; the later segment stays."""
    columns = ["run", "iter", "k", "j", "i"]
    first = t.cells.where("rec <= 3").select(*columns, "THETA", F.lit(0).alias("segment"))
    second = t.cells.where("rec >= 3").select(*columns, (F.col("THETA") + 1).alias("THETA"), F.lit(1).alias("segment"))

    def arrivals(_, path):  # the records of both segments and the ends of the runs, a file each
        rows = t.records.select("run", F.col("iter").cast("bigint"), "time_s", "rec")
        ends = rows.groupBy("run").agg(F.lit(None).cast("bigint").alias("iter"), F.lit(None).cast("double").alias("time_s"))
        parts = [rows.where("rec <= 3").drop("rec").withColumn("segment", F.lit(0)), rows.where("rec >= 3").drop("rec").withColumn("segment", F.lit(1)), ends.withColumn("segment", F.lit(None).cast("int"))]
        for n, part in enumerate(parts):
            part.coalesce(1).write.parquet(f"{path}/{n}")

    folder = t._once("restart_arrivals", lambda: None, arrivals)
    stream = t.spark.readStream.schema("run string, iter bigint, time_s double, segment int").option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    winners = restarts.winning_records(stream, overlap=22320.0)
    return restarts.decided_cells(winners, first.unionByName(second), "later-segment")


@query("j08_streaming_reports", uses="accounting", sql="""
SELECT j.run, j.job_id, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged_at, a.state, a.reason, a.exit_code
FROM (SELECT 'S' || CAST(o_custkey % 100 AS VARCHAR) AS run, CAST(o_orderkey*3 + n AS VARCHAR) AS job_id, o_orderkey % 5 AS hours, CAST(o_orderdate AS TIMESTAMP) AS logged_at
  FROM orders, range(3) r(n) WHERE n < o_orderkey % 4) j
LEFT JOIN accounting a ON a.job_id = j.job_id AND j.hours <= 2""")
def streaming_reports(t):
    """Logged jobs and accounting as two streams; a job without a report in time is put out with NULLs."""
    def arrivals(_, path):  # both streams in files by time, and a beat of each long after all jobs
        orders = t.given("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
        rows = orders.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
        jobs = rows.where("n < o_orderkey % 4").selectExpr("concat('S', o_custkey % 100) AS run", "CAST(o_orderkey*3 + n AS STRING) AS job_id", "at AS logged_at")
        reports = t.accounting.join(rows.selectExpr("CAST(o_orderkey*3 + n AS STRING) AS job_id", "at + make_interval(0, 0, 0, 0, CAST(o_orderkey % 5 AS INT)) AS reported_at"), "job_id")
        late = orders.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("late"))
        files = max(1, -(-3 * orders.count() // JOBS_PER_FILE))
        live.write_arrivals(jobs, f"{path}/jobs/0", "logged_at", files)
        live.write_arrivals(reports, f"{path}/reports/0", "reported_at", files)
        late.selectExpr("'beat' AS run", "'beat' AS job_id", "late AS logged_at").write.parquet(f"{path}/jobs/1")
        late.selectExpr("'end' AS job_id", *[f"CAST(NULL AS STRING) AS {c}" for c in ("state", "reason", "exit_code", "elapsed")], "late AS reported_at").write.parquet(f"{path}/reports/1")

    folder = t._once("job_arrivals", lambda: None, arrivals)
    jobs_ = live.arrivals(t.spark, f"{folder}/jobs", "run string, job_id string, logged_at timestamp", FILES_PER_BATCH)
    reports = live.arrivals(t.spark, f"{folder}/reports", "job_id string, state string, reason string, exit_code string, elapsed string, reported_at timestamp", FILES_PER_BATCH)
    out = live.drain(jobs.job_reports(jobs_, reports), "job-reports")
    return out.select("run", "job_id", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "state", "reason", "exit_code")


# --- spectra ---------------------------------------------------------------


@query("q01_mean_spectrum", uses="grid2d", sql="""
WITH n AS (SELECT run, j, COUNT(*) AS ni, least(256, COUNT(*)) AS w FROM grid2d GROUP BY run, j),
s AS (SELECT run, j, ni, w, i // w AS seg, i % w AS q, Depth - AVG(Depth) OVER (PARTITION BY run, j, i // w) AS x
  FROM grid2d JOIN n USING (run, j) WHERE i // w < ni // w),
h AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * q / w) AS win FROM s),
f AS (SELECT run, j, seg, m, any_value(ni) AS ni, SUM(x*win*cos(2*pi()*m*q/ni)) AS re, SUM(x*win*sin(2*pi()*m*q/ni)) AS im, SUM(win*win) AS ww
  FROM h, (SELECT unnest(range(max(ni) // 2 + 1)) AS m FROM n) WHERE m <= ni // 2 GROUP BY run, j, seg, m),
p AS (SELECT run, j, m, any_value(ni) AS ni, AVG((re*re + im*im) / ww * CASE WHEN m = 0 OR 2*m = ni THEN 1 ELSE 2 END) AS power FROM f GROUP BY run, j, m)
SELECT run, CAST(m AS INT) AS m, m / CAST(any_value(ni) AS DOUBLE) AS freq, round(AVG(power), 6) AS power FROM p GROUP BY run, m""")
def mean_spectrum(t):
    """Averaged power spectrum of the bathymetry rows."""
    out = spectra.mean_spectrum(t.grid2d)
    return out.select("run", "m", "freq", F.round("power", 6).alias("power"))
