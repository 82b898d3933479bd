"""Queries over joins with metrics, other streams, parameters and breakpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions.interp import deepest_above, piecewise_linear
from gridspark.operators import catalogue, generate, metrics, monitor, reduce, select, timewin
from gridspark.plans.registry import query
from gridspark.plans.texts_sql import NAME_PARAMETERS_SQL, PROGRESS_SQL, STATUS_SQL


@query("j01_horizontal_metric", uses="cells grid2d", sql="""
SELECT run, rec, k, j, i, VVEL * rAs AS v_area FROM cells JOIN grid2d USING (run, j, i)""")
def horizontal_metric(t):
    """Field times a 2-D metric, repeated over levels and records."""
    rows = metrics.with_horizontal(t.bare_cells, t.grid2d, "rAs")
    return rows.select("run", "rec", "k", "j", "i", (F.col("VVEL") * F.col("rAs")).alias("v_area"))


@query("j02_wet_fraction", uses="cells", sql="""
SELECT run, rec, k, j, i, VVEL * hFacS AS v_wet FROM cells""")
def wet_fraction(t):
    """Field times the 3-D wet fraction joined from the static grid."""
    bare = t.bare_cells.drop("hFacC", "hFacW", "hFacS")
    rows = metrics.with_wet_fractions(bare, t.grid3d, "hFacS")
    return rows.select("run", "rec", "k", "j", "i", (F.col("VVEL") * F.col("hFacS")).alias("v_wet"))


@query("j03_vertical_metric", uses="cells grid1d", sql="""
SELECT run, rec, k, j, i, (THETA - T0) / drF AS departure FROM cells JOIN grid1d USING (run, k)""")
def vertical_metric(t):
    """Departure from the reference profile per thickness."""
    rows = metrics.with_vertical(t.bare_cells, t.grid1d, "T0", "drF")
    departure = F.try_divide(F.col("THETA") - F.col("T0"), F.col("drF"))
    return rows.select("run", "rec", "k", "j", "i", departure.alias("departure"))


@query("j04_staggered_product", uses="cells grid2d", sql="""
SELECT run, rec, k, j, i, (UVEL*UVEL*hFacW + VVEL*VVEL*hFacS) * rA AS product FROM cells JOIN grid2d USING (run, j, i)""")
def staggered_product(t):
    """Face and centre values multiplied by index."""
    rows = metrics.with_horizontal(t.bare_cells, t.grid2d, "rA")
    u, v = F.col("UVEL"), F.col("VVEL")
    product = (u * u * F.col("hFacW") + v * v * F.col("hFacS")) * F.col("rA")
    return rows.select("run", "rec", "k", "j", "i", product.alias("product"))


@query("j05_slice_with_surface", uses="cells cells2d", sql="""
SELECT c.run, c.rec, c.k, c.i, PHIHYD - ETAN * 9.8 AS p FROM cells c JOIN cells2d s
ON c.run = s.run AND c.rec = s.rec AND c.j = s.j AND c.i = s.i WHERE c.j = 4""")
def slice_with_surface(t):
    """A 3-D slice with the matching record of the 2-D stream."""
    rows = metrics.with_surface(t.bare_cells.where("j = 4"), t.cells2d.where("j = 4"), "ETAN")
    return rows.select("run", "rec", "k", "i", (F.col("PHIHYD") - F.col("ETAN") * 9.8).alias("p"))


@query("j06_first_last_change", uses="cells", sql="""
SELECT run, k, SUM(CASE WHEN rec = last THEN THETA ELSE 0 END) - SUM(CASE WHEN rec = 0 THEN THETA ELSE 0 END) AS d_heat
FROM cells JOIN (SELECT run, max(rec) AS last FROM cells GROUP BY run) USING (run) WHERE THETA IS NOT NULL GROUP BY run, k""")
def first_last_change(t):
    """Each run's last minus first record of a profile without a self-join."""
    ends = select.records_in_ranges(t.cells, t.records, first=(0, 1), last=(-1, None))
    profile = ends.groupBy("run", "rec", "k").agg(F.sum("THETA").alias("heat"))
    return reduce.change_over_run(profile, t.records, "heat", ["run", "k"])


@query("j07_sweep", uses="names", sql=f"""
WITH p AS ({NAME_PARAMETERS_SQL}), totals AS (SELECT s_suppkey, CAST(COUNT(*) AS BIGINT) AS n, SUM(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem JOIN names ON l_suppkey = s_suppkey GROUP BY s_suppkey)
SELECT p.s_suppkey, run, N0, U0, height, CAST(q AS BIGINT) AS total FROM totals JOIN p USING (s_suppkey)""")
def sweep(t):
    """Totals per run beside the parameters decoded from its name."""
    named = catalogue.decoded_names(t.names)
    sums = t.given("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"))
    by_run = sums.join(t.names, "s_suppkey").select("s_suppkey", "run", "total")
    both = catalogue.sweep(by_run.drop("run").withColumnRenamed("s_suppkey", "run"), named.withColumnRenamed("run", "label").withColumnRenamed("s_suppkey", "run"))
    return both.select(F.col("run").alias("s_suppkey"), F.col("label").alias("run"), "N0", "U0", "height", "total")


@query("j08_job_overview", uses="job_log accounting metrics", sql=f"""
WITH status AS ({STATUS_SQL}), progress AS ({PROGRESS_SQL})
SELECT ord, run, job_states, running, elapsed, model_days, note
FROM (SELECT ord, 'run' || CAST(ord % 9 AS VARCHAR) AS run, job_states, running, elapsed FROM status)
LEFT JOIN progress USING (run)""")
def job_overview(t):
    """Job log with accounting states and the run's latest monitor values."""
    jobs = catalogue.job_records(t.job_lines).withColumn("run", F.concat(F.lit("run"), F.col("ord") % 9))
    rows = catalogue.job_overview(jobs, t.accounting, monitor.progress(monitor.metrics(t.log_lines)))
    return rows.select("ord", "run", "job_states", "running", "elapsed", F.col("model_days").alias("model_days"), "note")


@query("j09_source_run", uses="cells", sql="""
SELECT m.run AS run, c.run AS source_run, rec, k, j, i, KLviscAr FROM (VALUES ('A', 'N'), ('R', 'A')) m(run, source_run)
JOIN cells c ON c.run = m.source_run""")
def source_run(t):
    """Fields of one run used as another's input."""
    runs = t.grid1d.select("run").distinct().withColumn(
        "source_run", F.when(F.col("run") == "A", "N").when(F.col("run") == "R", "A"))
    fields = t.cells.select("run", "rec", "k", "j", "i", "KLviscAr")
    return metrics.with_source_run(runs, fields)



@query("j10_piecewise_linear", uses="grid2d grid1d", sql="""
WITH b AS (SELECT run, CAST(k AS DOUBLE) * 90 AS x0, T0 + k * k / 4e0 AS y0 FROM grid1d),
s AS (SELECT run, x0, y0, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY run ORDER BY x0)),
q AS (SELECT run, j, i, XC - 600 AS x FROM grid2d)
SELECT q.run, q.j, q.i, CASE WHEN x < 0 THEN -1e0 WHEN x > 540 THEN 99e0
  ELSE y0 + COALESCE((y1 - y0) / (x1 - x0) * (x - x0), 0) END AS y
FROM q LEFT JOIN s ON q.run = s.run AND x >= x0 AND (x < x1 OR x1 IS NULL) AND x <= 540""")
def linear_interpolation(t):
    """Interpolation through per-run breakpoints with given values outside."""
    points = F.array_sort(F.collect_list(F.struct((F.col("k") * 90.0).alias("x"), (F.col("T0") + F.col("k") * F.col("k") / 4.0).alias("y"))))
    breaks = t.grid1d.groupBy("run").agg(points.alias("breaks"))
    rows = t.grid2d.select("run", "j", "i", (F.col("XC") - 600).alias("x")).join(breaks, "run")
    y = piecewise_linear("x", "breaks", left=F.lit(-1.0), right=F.lit(99.0))
    return rows.select("run", "j", "i", y.alias("y"))


@query("j11_deepest_above", uses="grid2d grid1d", sql="""
SELECT g.run, g.j, g.i, CAST(max(CASE WHEN Z > -Depth THEN k END) AS INT) AS k_last FROM grid2d g JOIN grid1d d USING (run)
GROUP BY ALL""")
def deepest_level(t):
    """Last level above the seafloor in every column."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "Z")))
    depths = t.grid1d.groupBy("run").agg(F.transform(ordered, lambda s: s["Z"]).alias("depths"))
    return t.grid2d.join(depths, "run").select("run", "j", "i", deepest_above("depths", -F.col("Depth")).alias("k_last"))


@query("j12_outer_product", uses="spec", sql="""
SELECT run, CAST(n AS INT) AS n, CAST(k AS INT) AS k, CAST(j AS INT) AS j, n * 1240e0 AS time_s, 28 - (k + 1) * 0.25e0 AS t
FROM spec, range(36) a(n), range(20) b(k), range(2) c(j) WHERE j < ny""")
def outer_product(t):
    """Samples by levels by rows, exploded in place."""
    level = generate.levels(t.spec).withColumn("T0", 28 - (F.col("k") + 1) * 0.25)
    return generate.boundary_forcing(level).select("run", "n", "k", "j", "time_s", F.col("t").alias("t"))


@query("j13_cyclic_forcing", uses="series", sql="""
WITH f AS (SELECT DISTINCT run, n, CAST((n * n) % 17 AS DOUBLE) AS u FROM series, range(36) r(n)),
q AS (SELECT run, event_id, t, CAST((t // 1240) % 36 AS INT) AS here, t / 1240e0 - floor(t / 1240e0) AS part FROM series)
SELECT q.run, q.event_id, a.u * (1 - part) + b.u * part AS u FROM q
JOIN f a ON a.run = q.run AND a.n = here JOIN f b ON b.run = q.run AND b.n = (here + 1) % 36""")
def cyclic_forcing(t):
    """Forcing at any model time from a repeating sample cycle."""
    runs = t.series.select("run").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(35))))
    forcing = runs.withColumn("u", ((F.col("n") * F.col("n")) % 17).cast("double"))
    times = t.series.select("run", "event_id", F.col("t").cast("double").alias("time_s"))
    out = timewin.cyclic_forcing(times, timewin.forcing_arrays(forcing))
    return out.select("run", "event_id", F.col("u").alias("u"))
