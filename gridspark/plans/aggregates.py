"""Queries over reductions, energy budgets, fluxes, statistics and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import energy, flux, layers, reduce, stats
from gridspark.operators.select import at
from gridspark.plans.registry import query, rounded
from gridspark.sources.shared import settle


@query("a01_work_profile", uses="cells grid2d params", sql="""
SELECT run, rec, k, COALESCE(SUM(VVEL * hFacS * rAs), 0) * any_value(f0) * any_value(u0) AS work
FROM cells JOIN grid2d USING (run, j, i) JOIN params USING (run) GROUP BY run, rec, k""")
def work_profile(t):
    """Work of the background flow per run, record and level."""
    return reduce.work_profile(t.cells, t.grid2d, parameters=t.params)


@query("a02_mean_flow_profile", uses="cells grid2d", sql="""
SELECT run, rec, k, COALESCE(SUM(UVEL * hFacW * rAw), 0) AS sum_u, COALESCE(SUM(UVEL * hFacW * rAw), 0) / max(area_s) AS mean_u
FROM cells JOIN grid2d USING (run, j, i) JOIN (SELECT run, SUM(rAs) AS area_s FROM grid2d GROUP BY run) USING (run) GROUP BY run, rec, k""")
def mean_flow_profile(t):
    """Area-weighted flow per level, plain and normalised."""
    return reduce.mean_flow_profile(t.cells, t.grid2d)


@query("a03_run_area", uses="grid2d", sql="SELECT run, SUM(rA) AS area, SUM(rAs) AS area_s FROM grid2d GROUP BY run")
def run_area(t):
    """Total areas."""
    return reduce.run_area(t.grid2d)


_MEANS = "SELECT run, rec, AVG(UVEL) - 0.125 AS u_mean, AVG(VVEL) AS v_mean FROM cells JOIN grid1d USING (run, k) WHERE Z < -10 AND Z > -60 GROUP BY run, rec"


@query("a04_window_mean_flow", uses="cells grid1d", sql=f"SELECT run, rec, u_mean AS u_mean, v_mean AS v_mean FROM ({_MEANS})")
def window_mean_flow(t):
    """Unweighted mean flow between two depths per record."""
    return reduce.window_mean_flow(t.cells, t.grid1d, -60.0, -10.0, 0.125)


@query("a05_demean", uses="cells grid1d", sql="""
SELECT run, rec, k, j, i, UVEL - (AVG(CASE WHEN Z < -10 AND Z > -60 THEN UVEL END) OVER w - 0.125) AS UVEL,
  VVEL - AVG(CASE WHEN Z < -10 AND Z > -60 THEN VVEL END) OVER w AS VVEL
FROM cells JOIN grid1d USING (run, k) WINDOW w AS (PARTITION BY run, rec)""")
def demean(t):
    """Fields less their record's depth-window mean."""
    out = reduce.demean(t.cells.select("run", "rec", "k", "j", "i", "UVEL", "VVEL"), t.grid1d, -60.0, -10.0, 0.125)
    return out.select("run", "rec", "k", "j", "i", "UVEL", "VVEL")


_WP = """SELECT run, rec, k, CASE WHEN k > 0 THEN COALESCE(SUM(pp * WVEL * rA), 0) END AS WP FROM (
  SELECT *, (PHIHYD*hFacC + lag(PHIHYD) OVER w * lag(hFacC) OVER w) / nullif(hFacC + lag(hFacC) OVER w, 0) AS pp
  FROM cells JOIN grid2d USING (run, j, i) WINDOW w AS (PARTITION BY run, rec, j, i ORDER BY k)) GROUP BY run, rec, k"""
_DWP = f"""SELECT run, rec, k, WP, CASE WHEN k BETWEEN 1 AND 5 THEN -(lead(WP) OVER (PARTITION BY run, rec ORDER BY k) - WP) / drF
  ELSE 0 END AS dWPdz FROM ({_WP}) JOIN grid1d USING (run, k)"""


@query("a06_pressure_work", uses="cells grid2d grid1d", sql=f"SELECT run, rec, k, round(WP, 6) AS WP, round(dWPdz, 6) AS dWPdz FROM ({_DWP})")
def pressure_work(t):
    """Pressure work at interfaces and its divergence."""
    return rounded(energy.pressure_work_divergence(t.columns, t.grid2d, t.grid1d))


_BF = """SELECT run, rec, k, COALESCE(SUM(0.5 * (VVEL + vb) * hFacC * rA), 0) * any_value(f0) * any_value(u0) AS Bf FROM (
  SELECT *, CASE WHEN j = 0 THEN first_value(VVEL) OVER (PARTITION BY run, rec, k, i ORDER BY j DESC)
    ELSE lag(VVEL) OVER (PARTITION BY run, rec, k, i ORDER BY j) END AS vb FROM cells) JOIN grid2d USING (run, j, i) JOIN params USING (run) GROUP BY run, rec, k"""


@query("a07_body_force", uses="cells grid2d params", sql=f"SELECT run, rec, k, Bf AS Bf FROM ({_BF})")
def body_force(t):
    """Body force with the periodic neighbour average."""
    return energy.body_force(t.tiles, t.grid2d, parameters=t.params)


# The operators' own constant factors, written so that SQL reads the same doubles.
_PE_SCALE = f"({9.8 * 4e-4 * 4e-4 / 2.0:.17e} / (any_value(n0) * any_value(n0)))"
_APE_SCALE = f"({0.5 * 9.8 * 4e-4 * 4e-4:.17e} / (any_value(n0) * any_value(n0)))"
_KE = """COALESCE(SUM(UVEL*UVEL*hFacW*rA), 0) * 0.5 + COALESCE(SUM(VVEL*VVEL*hFacS*rA), 0) * 0.5"""
_PE = f"""COALESCE(SUM((THETA-T0)*(THETA-T0)*hFacC*rA), 0) * {_PE_SCALE}"""


@query("a08_kinetic_energy", uses="cells grid2d", sql=f"""
SELECT run, rec, k, {_KE} AS KE FROM cells JOIN grid2d USING (run, j, i) GROUP BY run, rec, k""")
def kinetic_energy(t):
    """Kinetic energy profile."""
    return energy.kinetic_energy(t.cells, t.grid2d)


@query("a09_potential_energy", uses="cells grid2d grid1d params", sql=f"""
SELECT run, rec, k, {_PE} AS PE FROM cells JOIN grid2d USING (run, j, i) JOIN grid1d USING (run, k) JOIN params USING (run) GROUP BY run, rec, k""")
def potential_energy(t):
    """Potential energy profile."""
    return energy.potential_energy(t.cells, t.grid2d, t.grid1d, parameters=t.params)


@query("a10_dissipation_profile", uses="cells grid2d", sql="""
SELECT run, rec, k, COALESCE(SUM(KLeps*hFacC*rA), 0) AS eps FROM cells JOIN grid2d USING (run, j, i) GROUP BY run, rec, k""")
def dissipation_profile(t):
    """Dissipation profile."""
    return energy.dissipation_profile(t.cells, t.grid2d)


_E = f"SELECT run, rec, k, {_KE} AS KE, {_PE} AS PE FROM cells JOIN grid2d USING (run, j, i) JOIN grid1d USING (run, k) JOIN params USING (run) GROUP BY run, rec, k"
_TENDENCY = f"""SELECT run, k, (SUM(KE) FILTER (rec = 2) - SUM(KE) FILTER (rec = 0)
  + (SUM(PE) FILTER (rec = 2) - SUM(PE) FILTER (rec = 0)) * 2.45e0) / 3600 AS dEdt FROM ({_E}) GROUP BY run, k"""


@query("a11_energy_tendency", uses="cells grid2d grid1d params", sql=f"SELECT run, k, dEdt AS dEdt FROM ({_TENDENCY})")
def energy_tendency(t):
    """Energy change between two records over a fixed time."""
    return energy.energy_tendency(energy.energy_profiles(at(t.cells, rec=[0, 2]), t.grid2d, t.grid1d, parameters=t.params))


_BUDGET = f"""SELECT run, k, Z, Bf, dWPdz, dEdt, -dEdt + Bf - dWPdz AS resid FROM ({_TENDENCY}) e
  JOIN (SELECT run, k, Bf FROM ({_BF}) WHERE rec = 1) b USING (run, k) JOIN (SELECT run, k, dWPdz FROM ({_DWP}) WHERE rec = 1) w USING (run, k)
  JOIN grid1d USING (run, k)"""
_BUDGET_TABLES = "cells grid2d grid1d params"


_TERMS = ["Bf", "dWPdz", "dEdt", "resid"]


def _budget(t):
    return energy.energy_budget(t.cells, t.grid2d, t.grid1d, parameters=t.params, columns=t.columns, tiles=t.tiles)


@query("a12_budget_residual", uses=_BUDGET_TABLES, sql=f"""
SELECT run, k, Z, Bf, round(dWPdz, 6) AS dWPdz, dEdt, round(resid, 6) AS resid FROM ({_BUDGET})""")
def budget_residual(t):
    """The full budget: body force, pressure-work divergence, tendency and residual."""
    out = _budget(t)
    return out.select("run", "k", "Z", "Bf", F.round("dWPdz", 6).alias("dWPdz"), "dEdt", F.round("resid", 6).alias("resid"))


_DEMEANED = """m AS (SELECT run, rec, AVG(UVEL) - any_value(u0) AS um, AVG(VVEL) AS vm FROM cells JOIN grid1d USING (run, k) JOIN params USING (run) WHERE Z < -10 AND Z > -60 GROUP BY run, rec),
cells AS (SELECT c.* REPLACE (UVEL - um AS UVEL, VVEL - vm AS VVEL) FROM cells c JOIN m USING (run, rec))"""


@query("a12_demeaned_budget", uses=_BUDGET_TABLES, sql=f"""
SELECT run, k, Z, round(Bf, 6) AS Bf, round(dWPdz, 6) AS dWPdz, round(dEdt, 6) AS dEdt, round(resid, 6) AS resid FROM (WITH {_DEMEANED} {_BUDGET})""")
def demeaned_budget(t):
    """The budget of what is left when each record's mean flow between two depths is taken off."""
    out = energy.energy_budget(t.cells, t.grid2d, t.grid1d, demean_between=(-60.0, -10.0), parameters=t.params, columns=t.columns, tiles=t.tiles)
    return rounded(out.select("run", "k", "Z", *_TERMS))


def _linear_sql(side: str) -> str:
    a, b, vn, length = ("i", "j", "UVEL", "dyG") if side in "WE" else ("j", "i", "VVEL", "dxG")
    strip = f"{a} < 2" if side in "WS" else f"{a} >= m{a} - 1"
    face = "0" if side in "WS" else f"m{a}"
    mean = "COALESCE(SUM(PHIHYD*hFacC), 0) / nullif(SUM(hFacC), 0)"
    if side in "WE":
        mean = f"CASE WHEN COUNT(PHIHYD) = 2 THEN {mean} END"
    return f"""SELECT '{side}' AS side, run, rec, k, round(COALESCE(SUM(p * vn * len), 0), 6) AS flux FROM (
      SELECT run, rec, k, {b}, {mean} AS p, max(CASE WHEN {a} = {face} THEN {vn} END) AS vn, max(CASE WHEN {a} = {face} THEN {length} END) AS len
      FROM cells JOIN grid2d USING (run, j, i) JOIN n USING (run) WHERE {strip} AND {b} BETWEEN 1 AND m{b} - 1 GROUP BY ALL) GROUP BY run, rec, k"""


_ENDS = "n AS (SELECT run, max(j) AS mj, max(i) AS mi FROM grid2d GROUP BY run)"


@query("a13_linear_flux_west_east", uses="cells grid2d", sql=f"WITH {_ENDS} {_linear_sql('W')} UNION ALL {_linear_sql('E')}")
def linear_flux_west_east(t):
    """Pressure flux through the western and eastern side."""
    return rounded(energy.linear_side_flux(t.cells, t.grid2d, "WE"))


@query("a14_linear_flux_south_north", uses="cells grid2d", sql=f"WITH {_ENDS} {_linear_sql('S')} UNION ALL {_linear_sql('N')}")
def linear_flux_south_north(t):
    """Pressure flux through the southern and northern side."""
    return rounded(energy.linear_side_flux(t.cells, t.grid2d, "SN"))


def _nonlinear_sql(side: str) -> str:
    a, b, vn, vt, wet, length = ("i", "j", "UVEL", "VVEL", "hFacS", "dyG") if side in "WE" else ("j", "i", "VVEL", "UVEL", "hFacW", "dxG")
    strip = f"{a} < 2" if side in "WS" else f"{a} >= m{a} - 1"
    face = "0" if side in "WS" else f"m{a}"
    return f"""SELECT '{side}' AS side, run, rec, k, round(COALESCE(SUM((0.5*vn*vn + (num + num2) / nullif(den + den2, 0) + ape) * vn * len), 0), 6) AS flux FROM (
      SELECT *, lead(num) OVER w AS num2, lead(den) OVER w AS den2 FROM (
        SELECT run, rec, k, {b}, any_value(m{b}) AS last_b, COALESCE(SUM(0.5*{vt}*{vt}*{wet}), 0) AS num, SUM({wet}) AS den,
          COALESCE(SUM((THETA-T0)*(THETA-T0)*hFacC), 0) * {_APE_SCALE} / nullif(SUM(hFacC), 0) AS ape,
          max(CASE WHEN {a} = {face} THEN {vn} END) AS vn, max(CASE WHEN {a} = {face} THEN {length} END) AS len
        FROM cells JOIN grid2d USING (run, j, i) JOIN grid1d USING (run, k) JOIN n USING (run) JOIN params USING (run) WHERE {strip} GROUP BY run, rec, k, {b})
      WINDOW w AS (PARTITION BY run, rec, k ORDER BY {b})) WHERE {b} BETWEEN 1 AND last_b - 1 GROUP BY run, rec, k"""


@query("a15_nonlinear_flux", uses="cells grid2d grid1d params",
       sql=f"WITH {_ENDS} " + " UNION ALL ".join(_nonlinear_sql(s) for s in "SNEW"))
def nonlinear_flux(t):
    """Energy carried through all four sides by the normal flow."""
    return rounded(energy.nonlinear_side_flux(t.cells, t.grid2d, t.grid1d, "SNEW", parameters=t.params))


_AREA = "(SELECT run, SUM(rA) AS area FROM grid2d GROUP BY run)"


@query("a16_column_totals", uses=_BUDGET_TABLES, sql=f"""
SELECT run, round(SUM(Bf)*10/(area/1e6), 5) AS Bf_total, round(SUM(dWPdz)*10/(area/1e6), 5) AS dWPdz_total,
  round(SUM(dEdt)*10/(area/1e6), 5) AS dEdt_total, round(SUM(resid)*10/(area/1e6), 5) AS resid_total
FROM ({_BUDGET}) JOIN {_AREA} USING (run) GROUP BY run, area""")
def column_totals(t):
    """Depth-integrated budget terms per square kilometre."""
    return rounded(reduce.column_totals(_budget(t), reduce.run_area(t.grid2d), _TERMS), 5)


@query("a17_normalised_profiles", uses=_BUDGET_TABLES, sql=f"""
SELECT run, k, round(Bf/area, 9) AS Bf_norm, round(dWPdz/area, 9) AS dWPdz_norm, round(dEdt/area, 9) AS dEdt_norm, round(resid/area, 9) AS resid_norm FROM ({_BUDGET}) JOIN {_AREA} USING (run)""")
def normalised_profiles(t):
    """Budget terms per unit area."""
    return rounded(reduce.normalised_profiles(_budget(t), reduce.run_area(t.grid2d), _TERMS), 9)


@query("a18_temperature_profile", uses="cells", sql="""
SELECT run, rec, k, AVG(CASE WHEN THETA > 0 THEN THETA END) AS t_mean,
  (AVG(CASE WHEN THETA > 0 THEN THETA END) - 28) * -0.2 AS displacement FROM cells GROUP BY run, rec, k""")
def temperature_profile(t):
    """Masked mean temperature and its displacement scaling."""
    return reduce.temperature_profile(t.cells)


@query("a19_vertical_mean_split", uses="cells", sql="""
SELECT run, rec, k, j, i, Ub AS Ub, m - Ub AS Up FROM (
  SELECT run, rec, k, j, i, m, AVG(m) OVER (PARTITION BY run, rec, j, i) AS Ub FROM (SELECT *, CASE WHEN THETA <> 0 THEN UVEL END AS m FROM cells))""")
def vertical_mean_split(t):
    """Column mean and remainder of the masked flow."""
    return reduce.split_vertical_mean(t.columns).select("run", "rec", "k", "j", "i", "Ub", "Up")


_FLUX = """SELECT run, rec, k, AVG((m - ub) * (p - pb)) AS UpPp, AVG(CASE WHEN m IS NOT NULL THEN ub END * pb) AS UbPb,
  AVG((m - ub) * pb) AS UpPb, AVG(CASE WHEN m IS NOT NULL THEN ub END * (p - pb)) AS UbPp FROM (
  SELECT *, AVG(m) OVER (PARTITION BY run, rec, j, i) AS ub, CASE WHEN p IS NOT NULL THEN ETAN * 9.8 END AS pb FROM (
    SELECT c.run, c.rec, c.k, c.j, c.i, ETAN, CASE WHEN THETA <> 0 THEN UVEL END AS m, CASE WHEN THETA <> 0 THEN PHIHYD END AS p
    FROM cells c JOIN cells2d s ON c.run=s.run AND c.rec=s.rec AND c.j=s.j AND c.i=s.i WHERE c.j = 3)) GROUP BY run, rec, k"""


@query("a20_flux_decomposition", uses="cells cells2d", sql=f"""
WITH f AS ({_FLUX}) SELECT f.run, f.rec, f.k, round(UpPp, 6) AS UpPp, round(UbPb, 6) AS UbPb, round(UpPb, 6) AS UpPb, round(UbPp, 6) AS UbPp,
  round(t1 * 10, 6) AS UpPp_total, round(t2 * 10, 6) AS UbPb_total, round(t3 * 10, 6) AS UpPb_total, round(t4 * 10, 6) AS UbPp_total
FROM f JOIN (SELECT run, rec, SUM(UpPp) AS t1, SUM(UbPb) AS t2, SUM(UpPb) AS t3, SUM(UbPp) AS t4 FROM f GROUP BY run, rec) USING (run, rec)""")
def flux_decomposition(t):
    """Four parts of the pressure flux along a slice and their vertical totals."""
    profile = settle(flux.flux_decomposition(t.cells.where("j = 3"), t.cells2d.where("j = 3")), "flux")
    return rounded(profile.join(flux.flux_totals(profile), ["run", "rec"]))


@query("a21_mean_of_last", uses="cells", sql="""
SELECT run, k, j, i, AVG(KLviscAr) AS KLviscAr FROM cells WHERE rec >= 2 GROUP BY run, k, j, i""")
def mean_of_last(t):
    """Per-cell mean over the last five records, from the record layout: reading five records beats moving none of all."""
    return reduce.mean_of_last(t.cells, t.records, ["KLviscAr"], 5)


def _stat_sql(field: str, weight: str) -> str:
    return f"""SELECT run, rec, '{field}' AS field, min(x) AS "min", max(x) AS "max", round(SUM(w*x)/SUM(w), 6) AS mean,
      round(sqrt(greatest(SUM(w*x*x)/SUM(w) - (SUM(w*x)/SUM(w))*(SUM(w*x)/SUM(w)), 0)), 6) AS sd
      FROM (SELECT run, rec, {field} AS x, {weight} AS w FROM cells JOIN grid2d USING (run, j, i) JOIN grid1d USING (run, k))
      WHERE w > 0 AND x IS NOT NULL GROUP BY run, rec"""


def _moments(out):
    """Sums in another order than SQL's differ in the last digit."""
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("a22_field_statistics", uses="cells grid2d grid1d", sql=" UNION ALL ".join([
    _stat_sql("UVEL", "hFacW*rAw*drF"), _stat_sql("VVEL", "hFacS*rAs*drF"),
    _stat_sql("WVEL", "CASE WHEN hFacC > 0 THEN 1 ELSE 0 END*rA*drC"), _stat_sql("THETA", "hFacC*rA*drF")]))
def field_statistics(t):
    """Volume-weighted statistics of four fields in one pass."""
    return _moments(stats.field_statistics(t.cells, t.grid2d, t.grid1d))


@query("a22_surface_statistics", uses="cells2d grid2d", sql="""
SELECT run, rec, 'ETAN' AS field, min(ETAN) AS "min", max(ETAN) AS "max", round(SUM(rA*ETAN)/SUM(rA), 6) AS mean,
  round(sqrt(SUM(rA*ETAN*ETAN)/SUM(rA) - (SUM(rA*ETAN)/SUM(rA))*(SUM(rA*ETAN)/SUM(rA))), 6) AS sd
FROM cells2d JOIN grid2d USING (run, j, i) WHERE Depth > 0 GROUP BY run, rec""")
def surface_statistics(t):
    """Area-weighted statistics of the surface elevation."""
    return _moments(stats.surface_statistics(t.cells2d, t.grid2d))


@query("a22_top_level_statistics", uses="cells grid2d", sql="""
SELECT run, rec, 'THETA' AS field, min(THETA) AS "min", max(THETA) AS "max", round(SUM(rA*THETA)/SUM(rA), 6) AS mean,
  round(sqrt(greatest(SUM(rA*THETA*THETA)/SUM(rA) - (SUM(rA*THETA)/SUM(rA))*(SUM(rA*THETA)/SUM(rA)), 0)), 6) AS sd
FROM cells JOIN grid2d USING (run, j, i) WHERE k = 0 AND hFacC > 0 GROUP BY run, rec""")
def top_level_statistics(t):
    """Area-weighted statistics of the surface temperature."""
    return _moments(stats.top_level_statistics(t.cells, t.grid2d))


_BINS = "(SELECT run, min(T0) AS lo, max(T0) AS hi FROM grid1d GROUP BY run)"


@query("a23_layer_transport", uses="cells grid1d", sql=f"""
SELECT run, rec, j, i, layer, SUM(UVEL*hFacW*drF) AS uh, SUM(hFacW*drF) AS h FROM (
  SELECT *, CAST(greatest(0, least(23, floor((THETA - lo) * 24 / (hi - lo)))) AS INT) AS layer
  FROM cells JOIN grid1d USING (run, k) JOIN {_BINS} USING (run) WHERE THETA IS NOT NULL AND hFacW > 0) GROUP BY ALL""")
def layer_transport(t):
    """Transport and thickness in evenly spaced temperature layers."""
    return layers.layer_transport(t.columns, t.grid1d, bins=24)


@query("a23_layer_transport_refined", uses="cells grid1d", sql=f"""
WITH c AS (SELECT *, CASE WHEN hFacC > 0 THEN THETA END AS wt FROM cells JOIN grid1d USING (run, k) JOIN {_BINS} USING (run)),
nb AS (SELECT *, lag(wt) OVER w AS up, lead(wt) OVER w AS dn, lag(drF) OVER w AS hup, lead(drF) OVER w AS hdn FROM c
  WINDOW w AS (PARTITION BY run, rec, j, i ORDER BY k)),
parts AS (SELECT *, (p + 0.5) / 8 - 0.5 AS pos FROM nb, range(8) r(p)),
fine AS (SELECT *, COALESCE(CASE WHEN pos < 0 THEN THETA + (up - THETA) * abs(pos) * drF / (0.5*(drF + hup))
  ELSE THETA + (dn - THETA) * abs(pos) * drF / (0.5*(drF + hdn)) END, THETA) AS th FROM parts WHERE hFacW > 0)
SELECT run, rec, j, i, CAST(greatest(0, least(23, floor((th - lo) * 24 / (hi - lo)))) AS INT) AS layer,
  round(SUM(UVEL*hFacW*drF/8), 6) AS uh, round(SUM(hFacW*drF/8), 6) AS h FROM fine WHERE th IS NOT NULL GROUP BY ALL""")
def layer_transport_refined(t):
    """The same after splitting each cell in eight with interpolated temperature."""
    return rounded(layers.layer_transport(t.columns, t.grid1d, bins=24, parts=8))


# Uneven layer edges made up for this query.
_EDGES = [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 15.0, 20.0, 25.0, 30.0]
_EDGE_CASE = "CASE " + " ".join(f"WHEN THETA < {e} THEN {n}" for n, e in enumerate(_EDGES[1:-1])) + f" ELSE {len(_EDGES) - 2} END"


@query("a23_layer_transport_uneven", uses="cells grid1d", sql=f"""
SELECT run, rec, j, i, CAST({_EDGE_CASE} AS INT) AS layer, SUM(UVEL*hFacW*drF) AS uh, SUM(hFacW*drF) AS h
FROM cells JOIN grid1d USING (run, k) WHERE THETA IS NOT NULL AND hFacW > 0 GROUP BY ALL""")
def layer_transport_uneven(t):
    """Transport in layers with uneven edges."""
    return layers.layer_transport_at(t.columns, t.grid1d, _EDGES)


@query("a24_advective_cfl", uses="cells grid2d grid1d", sql="""
SELECT run, rec, max(abs(UVEL)*6.2/dxC) AS cfl_u, max(abs(VVEL)*6.2/dyC) AS cfl_v, max(abs(WVEL)*6.2/drC) AS cfl_w,
  max(CASE WHEN hFacC > 0 THEN abs(WVEL)*6.2/drF/hFacC END) AS cfl_w_hf
FROM cells JOIN grid2d USING (run, j, i) JOIN grid1d USING (run, k) GROUP BY run, rec""")
def advective_cfl(t):
    """Largest CFL numbers per record."""
    return stats.advective_cfl(t.cells, t.grid2d, t.grid1d, 6.2)


@query("a25_kinetic_energy_statistics", uses="cells grid2d grid1d", sql="""
SELECT run, rec, max(CASE WHEN w > 0 THEN ke END) AS ke_max, SUM(w*ke) / SUM(CASE WHEN ke IS NOT NULL THEN w END) AS ke_mean, SUM(w) AS volume FROM (
  SELECT run, rec, 0.5*(UVEL*UVEL + VVEL*VVEL) AS ke, hFacC*rA*drF AS w FROM cells JOIN grid2d USING (run, j, i) JOIN grid1d USING (run, k))
GROUP BY run, rec""")
def kinetic_energy_statistics(t):
    """Largest and mean kinetic energy per record."""
    return stats.kinetic_energy_statistics(t.cells, t.grid2d, t.grid1d)


@query("a26_vorticity_statistics", uses="cells grid2d", sql="""
SELECT run, rec, min(z) AS vort_min, max(z) AS vort_max, round(AVG(z), 6) AS vort_mean, round(stddev_pop(z), 6) AS vort_sd FROM (
  SELECT run, rec, (v - lag(v) OVER wi - u + lag(u) OVER wj) / rAz AS z FROM (
    SELECT *, VVEL*dyC AS v, UVEL*dxC AS u FROM cells JOIN grid2d USING (run, j, i))
  WINDOW wi AS (PARTITION BY run, rec, k, j ORDER BY i), wj AS (PARTITION BY run, rec, k, i ORDER BY j)) GROUP BY run, rec""")
def vorticity_statistics(t):
    """Statistics of the relative vorticity at cell corners."""
    out = stats.vorticity_statistics(t.cells, t.grid2d)
    return out.select("run", "rec", "vort_min", "vort_max", F.round("vort_mean", 6).alias("vort_mean"), F.round("vort_sd", 6).alias("vort_sd"))


@query("a27_out_of_bounds", uses="cells", sql="""
SELECT run, rec, low, high FROM (SELECT run, rec, min(THETA) AS low, max(THETA) AS high FROM cells WHERE hFacC > 0 GROUP BY run, rec)
WHERE high - low > 26.375""")
def out_of_bounds(t):
    """Records whose temperature range is too wide."""
    return stats.out_of_bounds(t.cells, 26.375)


@query("a28_profile_range", uses="grid1d", sql="SELECT run, min(T0) AS low, max(T0) AS high FROM grid1d GROUP BY run")
def profile_range(t):
    """Coldest and warmest reference temperature per run."""
    return reduce.profile_range(t.grid1d)
