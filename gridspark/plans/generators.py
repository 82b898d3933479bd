"""Queries over the generators, for a sweep with one run per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import generate, metrics, reduce
from gridspark.plans.registry import query, rounded

_OMEGA = "(2 * pi() / 3600 / 12.4)"
_AXIS = """axis AS (SELECT *, SUM(dx) OVER (PARTITION BY run ORDER BY i) AS x FROM (
  SELECT *, 100 * pow(1.12, greatest(36 - i, 0)) AS dx FROM (SELECT spec.*, CAST(i AS INT) AS i FROM spec, range(64) r(i) WHERE i < nx)))"""
_LEVELS = "lev AS (SELECT spec.*, CAST(k AS INT) AS k, H / nz AS dz, (k + 1) * (H / nz) AS z FROM spec, range(20) r(k))"
_T0 = "t0 AS (SELECT *, 28 + SUM(N0*N0/9.8/2e-4*(-dz)*exp(-z/strat_scale)) OVER (PARTITION BY run ORDER BY k) AS T0 FROM lev)"
_STRAIGHT = f"""bathy AS (SELECT *, CASE WHEN i = nx - 1 THEN 0 WHEN i < 20 THEN -H ELSE greatest(raw, -H) END AS d FROM (
  SELECT *, CASE WHEN x < coast - ro THEN -H ELSE -H + H / (coast - (coast - ro)) * (x - (coast - ro)) END AS raw FROM (
    SELECT *, max(x) OVER (PARTITION BY run) AS coast, H / steepness / {_OMEGA} * N0 AS ro FROM axis)))"""


def _straight(t):
    return generate.bathymetry(generate.spacing(t.spec), generate.straight_breaks())


@query("g01_spacing", uses="spec", sql=f"WITH {_AXIS} SELECT run, i, round(dx, 6) AS dx FROM axis")
def spacing(t):
    """Stretched west-east spacing."""
    return rounded(generate.spacing(t.spec).select("run", "i", "dx"))


def _wavy_points() -> str:
    depth = [0, -200, -700, -1000, -1500, -1800, -2000]
    steep = [None, None, 1.5, 0.5, 1.5, 0.5, 1.5]
    x, points = "15000e0", [("0e0", 0), ("15000e0", -200)]
    for n in range(2, 7):
        x = f"{x} + {depth[n - 1] - depth[n]} / ({_OMEGA} / N0 * {steep[n]})"
        points.append((x, depth[n]))
    return " UNION ALL ".join(f"SELECT run, {n} AS n, {px} AS x, {py}e0 AS y FROM spec" for n, (px, py) in enumerate(points))


@query("g02_breakpoints", uses="spec", sql=f"SELECT run, CAST(n AS INT) AS n, round(x, 3) AS x, y FROM ({_wavy_points()})")
def breakpoints(t):
    """Breakpoints of alternating sub- and supercritical slopes."""
    rows = t.spec.select("run", F.posexplode(generate.wavy_breaks()).alias("n", "b"))
    return rows.select("run", "n", F.round("b.x", 3).alias("x"), F.col("b.y").alias("y"))


@query("g03_bathymetry_straight", uses="spec", sql=f"WITH {_AXIS}, {_STRAIGHT} SELECT run, CAST(j AS INT) AS j, i, CASE WHEN j = 0 THEN round(d, 5) ELSE 0 END AS d FROM bathy, range(2) q(j) WHERE j < ny")
def bathymetry_straight(t):
    """Seafloor of a single slope."""
    return generate.seafloor_rows(_straight(t)).select("run", "j", "i", F.round("d", 5).alias("d"))


@query("g03_bathymetry_wavy", uses="spec", sql=f"""
WITH {_AXIS}, c AS (SELECT run, max(x) AS coast FROM axis GROUP BY run),
b AS (SELECT run, coast - x AS x0, y AS y0 FROM ({_wavy_points()}) JOIN c USING (run)),
s AS (SELECT run, x0, y0, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, min(x0) OVER (PARTITION BY run) AS first_x FROM b WINDOW w AS (PARTITION BY run ORDER BY x0)),
r AS (SELECT a.run, a.i, a.nx, a.ny, a.H, COALESCE(y0 + COALESCE((y1 - y0) / (x1 - x0) * (a.x - x0), 0), -a.H) AS raw
  FROM axis a LEFT JOIN s ON a.run = s.run AND a.x >= x0 AND (a.x < x1 OR x1 IS NULL)),
m AS (SELECT *, SUM(raw) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS smooth FROM r)
SELECT run, CAST(j AS INT) AS j, i, CASE WHEN j > 0 THEN 0 ELSE round(CASE WHEN i = nx - 1 THEN 0 WHEN i < 20 THEN -H ELSE greatest(smooth, -H) END, 5) END AS d
FROM m, range(2) q(j) WHERE j < ny""")
def bathymetry_wavy(t):
    """Smoothed seafloor of alternating slopes."""
    rows = generate.bathymetry(generate.spacing(t.spec), generate.wavy_breaks())
    return generate.seafloor_rows(rows).select("run", "j", "i", F.round("d", 5).alias("d"))


@query("g04_levels", uses="spec", sql=f"WITH {_LEVELS} SELECT run, k, dz, z FROM lev")
def levels(t):
    """Uniform thickness and depth."""
    return generate.levels(t.spec).select("run", "k", "dz", "z")


@query("g05_temperature", uses="spec", sql=f"WITH {_LEVELS}, {_T0} SELECT run, k, round(T0, 8) AS T0 FROM t0")
def temperature(t):
    """Exponentially stratified reference temperature."""
    return generate.stratified_temperature(generate.levels(t.spec)).select("run", "k", F.round("T0", 8).alias("T0"))


@query("g06_layer_edges", uses="spec", sql=f"""
WITH {_LEVELS}, {_T0} SELECT run, CAST(n AS INT) AS n, round(lo + (hi - lo) / 100 * n, 8) AS edge
FROM (SELECT run, min(T0) AS lo, max(T0) AS hi FROM t0 GROUP BY run), range(101) r(n)""")
def layer_edges(t):
    """101 evenly spaced layer edges per run."""
    from gridspark.operators.layers import layer_edges as edges

    profile = generate.stratified_temperature(generate.levels(t.spec)).select("run", "k", "T0")
    return edges(profile, 100).select("run", F.posexplode("edges").alias("n", "edge")).select("run", "n", F.round("edge", 8).alias("edge"))


@query("g07_tidal_forcing", uses="spec", sql=f"""
WITH {_LEVELS} SELECT run, CAST(n AS INT) AS n, k, CAST(j AS INT) AS j, round(u0 * sin({_OMEGA} * n * 1240), 9) AS u
FROM lev, range(36) r(n), range(2) q(j) WHERE j < ny""")
def tidal_forcing(t):
    """Tidal flow at 36 times for every level and row."""
    level = generate.levels(t.spec).withColumn("T0", F.lit(0.0))
    return generate.boundary_forcing(level).select("run", "n", "k", "j", F.round("u", 9).alias("u"))


@query("g08_initial_fields", uses="spec", sql=f"""
WITH {_LEVELS}, {_T0} SELECT run, k, CAST(j AS INT) AS j, CAST(i AS INT) AS i, round(T0, 8) AS THETA, 0e0 AS UVEL, 35e0 AS SALT, 0e0 AS ETAN
FROM t0, range(2) q(j), range(64) r(i) WHERE j < ny AND i < nx""")
def initial_fields(t):
    """Initial temperature, flow, salinity and elevation."""
    level = generate.stratified_temperature(generate.levels(t.spec))
    return rounded(generate.initial_fields(level), 8)


@query("g09_tracers", uses="spec", sql=f"""
WITH {_AXIS}, {_LEVELS}, {_STRAIGHT}, seg AS (SELECT run, i, d, lead(d) OVER (PARTITION BY run ORDER BY i) AS dn FROM bathy),
hit AS (SELECT run, tracer, depth, max(i) AS i FROM seg, (VALUES ('TRAC01', -450e0), ('TRAC02', -850e0), ('TRAC03', -1250e0), ('TRAC04', -1650e0)) v(tracer, depth)
  WHERE d <= depth GROUP BY ALL),
mid AS (SELECT run, tracer, CAST(round_even(i + COALESCE((depth - d) / (dn - d), 0), 0) AS INT) AS im FROM hit JOIN seg USING (run, i)),
col AS (SELECT mid.run, tracer, CAST(im + o AS INT) AS i FROM mid, range(-2, 3) r(o)),
bot AS (SELECT c.run, tracer, c.i, max(k) AS kb FROM col c JOIN bathy b ON b.run = c.run AND b.i = c.i JOIN lev l ON l.run = c.run AND -l.z > b.d GROUP BY ALL),
cell AS (SELECT a.run, l.k, CAST(j AS INT) AS j, a.i FROM axis a JOIN lev l USING (run), range(2) q(j) WHERE j < a.ny)
SELECT cell.run, cell.k, cell.j, cell.i, {', '.join(f"CASE WHEN cell.j = 0 AND bool_or(tracer = 'TRAC0{n}' AND cell.k BETWEEN kb - 3 AND kb) THEN 400e0 ELSE 1e-10 END AS TRAC0{n}" for n in (1, 2, 3, 4))}
FROM cell LEFT JOIN bot ON bot.run = cell.run AND bot.i = cell.i GROUP BY cell.run, cell.k, cell.j, cell.i""")
def tracers(t):
    """Tracer doses along the seafloor."""
    return generate.tracer_fields(_straight(t), generate.levels(t.spec))


_EDGE = "edge AS (SELECT *, last_value(CASE WHEN d > -H THEN x END IGNORE NULLS) OVER (PARTITION BY run ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS xe FROM bathy)"


@query("g10_bottom_diffusivity", uses="spec", sql=f"""
WITH {_AXIS}, {_LEVELS}, {_STRAIGHT}, {_EDGE} SELECT e.run, l.k, CAST(j AS INT) AS j, e.i, round(CASE WHEN i = 0 OR j > 0 THEN 1e-5 ELSE
  greatest(1e-2 * exp((z + d) / 250) * CASE WHEN d > -e.H THEN 1 ELSE exp(-(xe - x) / 5e3) END, 1e-5) END, 9) AS Kr FROM edge e JOIN lev l USING (run), range(2) q(j) WHERE j < e.ny""")
def bottom_diffusivity(t):
    """Diffusivity decaying above the seafloor."""
    return rounded(generate.bottom_diffusivity(_straight(t), generate.levels(t.spec)), 9)


@query("g11_block_diffusivity", uses="spec", sql=f"""
WITH {_AXIS}, {_LEVELS}, {_STRAIGHT}, {_EDGE}, raw AS (SELECT e.run, l.k, e.i, e.ny, CASE WHEN -z < d + 250 THEN 1e-2 * CASE WHEN d > -e.H THEN 1 ELSE exp(-(xe - x) / 5e3) END
  ELSE 1e-5 END AS v FROM edge e JOIN lev l USING (run))
SELECT run, k, CAST(j AS INT) AS j, i, round(CASE WHEN i = 0 OR j > 0 THEN 1e-5 ELSE greatest(pow(10, m / 15), 1e-5) END, 9) AS Kr FROM (
  SELECT *, SUM(log10(v)) OVER (PARTITION BY run, i ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM raw), range(2) q(j) WHERE j < ny""")
def block_diffusivity(t):
    """Diffusivity in a bottom layer, smoothed in log space."""
    return rounded(generate.block_diffusivity(_straight(t), generate.levels(t.spec)), 9)


@query("g12_diffusivity_from_run", uses="cells", sql="""
SELECT m.run AS run, c.run AS source_run, k, j, i, AVG(KLviscAr) AS KLviscAr FROM (VALUES ('A', 'N'), ('R', 'A')) m(run, source_run)
JOIN cells c ON c.run = m.source_run WHERE rec >= 2 GROUP BY ALL""")
def diffusivity_from_run(t):
    """Diffusivity from another run's mean over its last five tidal averages."""
    runs = t.grid1d.select("run").distinct().withColumn(
        "source_run", F.when(F.col("run") == "A", "N").when(F.col("run") == "R", "A"))
    return metrics.with_source_run(runs, reduce.mean_of_last(t.cells, t.records, ["KLviscAr"], 5))
