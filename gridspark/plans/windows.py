"""Queries over neighbour windows, running operators, top-k and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import catalogue, generate, monitor, reduce, select, stencil, timewin
from gridspark.plans.registry import query, rounded
from gridspark.schema import CELL, COLUMN
from gridspark.sources import tables as store


@query("w01_reference_profile", uses="spec", sql="""
SELECT run, CAST(k AS INT) AS k, round(28 - SUM(N0*N0/9.8/2e-4*(H/nz)) OVER (PARTITION BY run ORDER BY k), 9) AS T0 FROM spec, range(20) r(k)""")
def reference_profile(t):
    """Linear reference profile by inclusive running sum."""
    levels = generate.levels(t.spec)
    return rounded(stencil.reference_profile(levels).select("run", "k", "T0"), 9)


@query("w02_vertical_divergence", uses="cells grid1d", sql="""
WITH p AS (SELECT run, rec, k, SUM(THETA * hFacC) AS x FROM cells GROUP BY run, rec, k)
SELECT run, rec, k, CASE WHEN k BETWEEN 1 AND 5 THEN -(lead(x) OVER (PARTITION BY run, rec ORDER BY k) - x) / drF ELSE 0 END AS dWPdz
FROM p JOIN grid1d USING (run, k)""")
def vertical_divergence(t):
    """Vertical difference of a profile over thickness, 0 at the ends."""
    profile = t.cells.groupBy("run", "rec", "k").agg(F.sum(F.col("THETA") * F.col("hFacC")).alias("x"))
    rows = profile.join(t.grid1d.select("run", "k", "drF"), ["run", "k"])
    return stencil.vertical_divergence(rows, "x").select("run", "rec", "k", "dWPdz")


@query("w03_interface_weighted", uses="cells", sql="""
SELECT run, rec, k, j, i, (PHIHYD*hFacC + lag(PHIHYD) OVER w * lag(hFacC) OVER w) / nullif(hFacC + lag(hFacC) OVER w, 0) AS p
FROM cells WINDOW w AS (PARTITION BY run, rec, j, i ORDER BY k)""")
def interface_weighted(t):
    """Thickness-weighted interface pressure, missing where both cells are dry."""
    return t.columns.select(*CELL, stencil.interface_value().alias("p"))


@query("w04_face_to_centre", uses="cells", sql="""
SELECT run, rec, k, j, i, 0.5 * (VVEL + CASE WHEN j = 0 THEN first_value(VVEL) OVER (PARTITION BY run, rec, k, i ORDER BY j DESC)
  ELSE lag(VVEL) OVER (PARTITION BY run, rec, k, i ORDER BY j) END) AS v_wrapped,
  0.5 * (UVEL + lag(UVEL) OVER (PARTITION BY run, rec, k, j ORDER BY i)) AS u_open FROM cells""")
def face_to_centre(t):
    """Neighbour averages, periodic in j and open in i."""
    rows = t.tiles.withColumn("v_wrapped", stencil.tile_face_to_centre("VVEL", "j"))
    rows = rows.withColumn("u_open", stencil.tile_face_to_centre("UVEL", "i"))
    return stencil.own_rows(rows).select(*CELL, "v_wrapped", "u_open")


@query("w05_row_coordinates", uses="spec", sql="""
SELECT run, CAST(j AS INT) AS j, 100e0 * j AS y FROM spec, range(2) q(j) WHERE j < ny""")
def row_coordinates(t):
    """South-north coordinates counted from the first row."""
    return generate.rows_axis(t.spec).select("run", "j", "y")


@query("w05_coordinates", uses="spec", sql="""
SELECT run, CAST(i AS INT) AS i, round(SUM(100 * pow(1.12, greatest(36 - i, 0))) OVER (PARTITION BY run ORDER BY i), 4) AS x
FROM spec, range(64) r(i) WHERE i < nx""")
def coordinates(t):
    """Coordinates by summing the stretched spacing."""
    return rounded(generate.spacing(t.spec).select("run", "i", "x"), 4)


@query("w06_moving_average", uses="grid2d", sql="""
SELECT run, j, i, SUM(Depth) OVER (PARTITION BY run, j ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS smooth FROM grid2d""")
def moving_average(t):
    """Zero-padded moving average of width 10."""
    return t.grid2d.select("run", "j", "i", stencil.moving_average("Depth", "i", ["run", "j"], 10).alias("smooth"))


@query("w07_moving_geometric_mean", uses="cells", sql="""
SELECT run, rec, k, j, i, round(pow(10, SUM(log10(KLviscAr)) OVER (PARTITION BY run, rec, j, i ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15), 9) AS kv
FROM cells""")
def moving_geometric_mean(t):
    """Moving geometric mean of width 15 over depth."""
    return t.columns.select(*CELL, F.round(stencil.moving_geometric_mean("KLviscAr", "k", COLUMN, 15), 9).alias("kv"))


@query("w08_four_point_mean", uses="cells", sql="""
WITH s AS (SELECT run, rec, k, i, COALESCE(SUM(0.5*UVEL*UVEL*hFacW), 0) AS num, SUM(hFacW) AS den FROM cells WHERE j < 2 GROUP BY ALL)
SELECT run, rec, k, i, (num + lead(num) OVER w) / nullif(den + lead(den) OVER w, 0) AS pair_mean FROM s WINDOW w AS (PARTITION BY run, rec, k ORDER BY i)""")
def four_point_mean(t):
    """Weighted mean over two rows and two neighbouring faces."""
    strip = select.edge_strip(t.cells, t.grid2d, "S")
    return stencil.four_point_mean(strip, "UVEL", "hFacW", "i", ["run", "rec", "k"])


@query("w08_corner_average", uses="cells", sql="""
WITH n AS (SELECT run, max(j) + 1 AS nj FROM cells GROUP BY run),
p AS (SELECT run, rec, k, j, i, CASE WHEN THETA IS NOT NULL THEN hFacC END AS w, THETA * hFacC AS x FROM cells),
g AS (SELECT run, rec, k, (j + dj) % nj AS j, i + di AS i, w, x FROM p JOIN n USING (run), (VALUES (0), (1)) a(dj), (VALUES (0), (1)) b(di))
SELECT run, rec, k, j, i, SUM(x) / nullif(SUM(w), 0) AS theta FROM g JOIN (SELECT run, rec, k, j, i FROM p) USING (run, rec, k, j, i) GROUP BY ALL""")
def corner_average(t):
    """Wet mean of the four cells around each corner, periodic in j."""
    return stencil.corner_average(t.tiles, "THETA", "hFacC", "theta").select(*CELL, "theta")


@query("w09_carry_from_east", uses="grid2d", sql="""
SELECT run, j, i, last_value(CASE WHEN Depth < 60 THEN XC END IGNORE NULLS) OVER (PARTITION BY run, j ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS edge
FROM grid2d""")
def carry_from_east(t):
    """Latest qualifying column met when scanning from the east."""
    return t.grid2d.select("run", "j", "i", stencil.carry_from_east("XC", F.col("Depth") < 60, "i", ["run", "j"]).alias("edge"))


@query("w10_record_index", uses="cells", sql="""
SELECT run, iter, CAST(dense_rank() OVER (PARTITION BY run ORDER BY iter) - 1 AS INT) AS pos, CAST(COUNT(*) OVER (PARTITION BY run) AS INT) AS n_rec
FROM (SELECT DISTINCT run, iter FROM cells)""")
def record_index(t):
    """Dense record positions from iterations."""
    return select.records_of(t.cells).select("run", "iter", "pos", "n_rec")


@query("w11_restart_overlap", uses="cells", sql="""
WITH seg AS (SELECT run, iter, k, j, i, THETA, 0 AS segment FROM cells WHERE rec <= 3
  UNION ALL SELECT run, iter, k, j, i, THETA + 1 AS THETA, 1 FROM cells WHERE rec >= 3)
SELECT * FROM seg QUALIFY rank() OVER (PARTITION BY run, iter ORDER BY segment DESC) = 1""")
def restart_overlap(t):
    """Repeated records of overlapping restart segments; the later segment stays."""
    columns = ["run", "iter", "k", "j", "i"]
    first = t.cells.where("rec <= 3").select(*columns, "THETA", F.lit(0).alias("segment"))
    second = t.cells.where("rec >= 3").select(*columns, (F.col("THETA") + 1).alias("THETA"), F.lit(1).alias("segment"))
    return timewin.drop_restart_overlap(first.unionByName(second))


# --- sorts and top-k -------------------------------------------------------


@query("t01_latest_metric", uses="metrics", sql="""
SELECT run, metric, arg_max(value, ord) AS value FROM metrics WHERE metric <> '' GROUP BY run, metric""")
def latest_metric(t):
    """Last value of each metric per run."""
    return monitor.latest(monitor.metrics(t.log_lines))


@query("t02_matching_tail", uses="log_lines", sql="""
SELECT run, ord, chunk, value, CAST(row_number() OVER (PARTITION BY run ORDER BY ord DESC) AS INT) AS from_end FROM log_lines
WHERE regexp_matches(value, 'advcfl_wvel_max|time_seconds|dynstat_uvel_max') QUALIFY from_end <= 9""")
def matching_tail(t):
    """Each run's last nine matching lines."""
    return monitor.matching_tail(t.log_lines)


@query("t03_depth_ordered", uses="cells", sql="SELECT run, rec, k, SUM(TRAC01) AS tracer FROM cells GROUP BY run, rec, k ORDER BY run, rec, k")
def depth_ordered(t):
    """A profile in depth order."""
    return reduce.depth_ordered(t.cells.groupBy("run", "rec", "k").agg(F.sum("TRAC01").alias("tracer")))


@query("t04_latest_entry", uses="run_log", sql="""
SELECT run, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged, comment FROM run_log
QUALIFY row_number() OVER (PARTITION BY run ORDER BY logged_at DESC, comment DESC) = 1""")
def latest_entry(t):
    """Newest run-log entry of each run."""
    latest = catalogue.latest_entry(catalogue.run_log_entries(t.run_log_lines))
    return latest.select("run", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged"), "comment")


# --- unions ----------------------------------------------------------------


@query("u01_union_runs", uses="cells cells2d", sql="""
SELECT run, rec, k, j, i, UVEL, NULL AS ETAN FROM cells
UNION ALL SELECT run, rec, NULL, j, i, NULL, ETAN FROM cells2d""")
def union_runs(t):
    """Runs and streams with different fields in one table."""
    deep = t.cells.select("run", "rec", "k", "j", "i", "UVEL")
    flat = t.cells2d.select("run", "rec", "j", "i", "ETAN")
    return store.union_streams([deep, flat])


@query("u02_union_sides", uses="cells grid2d", sql="""
WITH n AS (SELECT run, max(j) AS mj, max(i) AS mi FROM grid2d GROUP BY run)
SELECT 'W' AS side, run, rec, SUM(UVEL * dyG) AS through FROM cells JOIN grid2d USING (run, j, i) WHERE i = 0 GROUP BY run, rec
UNION ALL SELECT 'E', run, rec, SUM(UVEL * dyG) FROM cells JOIN grid2d USING (run, j, i) JOIN n USING (run) WHERE i = mi GROUP BY run, rec
UNION ALL SELECT 'S', run, rec, SUM(VVEL * dxG) FROM cells JOIN grid2d USING (run, j, i) WHERE j = 0 GROUP BY run, rec
UNION ALL SELECT 'N', run, rec, SUM(VVEL * dxG) FROM cells JOIN grid2d USING (run, j, i) JOIN n USING (run) WHERE j = mj GROUP BY run, rec""")
def union_sides(t):
    """Flow through the four sides in one table with a side column."""
    rows = select.edge_strips(t.cells, t.grid2d, width=1)
    normal = F.when(F.col("side").isin("W", "E"), F.col("UVEL") * F.col("dyG")).otherwise(F.col("VVEL") * F.col("dxG"))
    return rows.groupBy("side", "run", "rec").agg(F.sum(normal).alias("through"))
