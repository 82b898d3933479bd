"""Deterministic grids, profiles, forcing and initial fields for a sweep of runs.

Input is one row per run with its parameters (``run, nx, ny, nz, H, N0, u0, …``).
Axis tables have one row per grid index; volumes are made by exploding index
sequences of axis rows in place, so nothing is built on the driver and no cross
join is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from gridspark import constants as C
from gridspark.functions.interp import deepest_above, piecewise_linear
from gridspark.functions.scalars import _col, floor_at, half_even
from gridspark.operators.stencil import (
    carry_from_east, coordinate, moving_average, moving_geometric_mean, running_sum,
)

# Fixed values of the standard set-up.
SPACING = 100.0
STRETCH = 1.12
STRETCH_BELOW = 36
WALL_CELLS = 20
SMOOTH_WIDTH = 10
MIX_SMOOTH_WIDTH = 15
OFF_SLOPE_DECAY = 5e3
SHELF_WIDTH = 15_000.0
WAVY_DEPTHS = [0.0, -200.0, -700.0, -1000.0, -1500.0, -1800.0, -2000.0]
WAVY_STEEPNESS = [None, None, 1.5, 0.5, 1.5, 0.5, 1.5]
TRACER_DEPTHS = {"TRAC01": -450.0, "TRAC02": -850.0, "TRAC03": -1250.0, "TRAC04": -1650.0}
TRACER_BACKGROUND = 1e-10
TRACER_DOSE = 400.0
TRACER_COLUMNS = (-2, 2)
TRACER_LEVELS = 4
SALINITY = 35.0


def _index(size, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), _col(size).cast("int") - 1)).alias(name)


# --- axes ------------------------------------------------------------------

def spacing(runs: DataFrame) -> DataFrame:
    """West-east spacing: uniform, stretched westward near the western end, and its coordinate."""
    axis = runs.select("*", _index("nx", "i"))
    power = F.greatest(F.lit(STRETCH_BELOW) - F.col("i"), F.lit(0)).cast("double")
    axis = axis.withColumn("dx", SPACING * F.pow(F.lit(STRETCH), power))
    return axis.withColumn("x", coordinate("dx", "i", ["run"]))


def rows_axis(runs: DataFrame) -> DataFrame:
    """South-north axis with its coordinate counted from the first row."""
    axis = runs.select("*", _index("ny", "j")).withColumn("dy", F.lit(SPACING))
    return axis.withColumn("y", coordinate("dy", "j", ["run"], from_first=True))


def levels(runs: DataFrame) -> DataFrame:
    """Uniform level thickness and depth of the level bottom (positive down)."""
    axis = runs.select("*", _index("nz", "k")).withColumn("dz", F.col("H") / F.col("nz"))
    return axis.withColumn("z", running_sum("dz", "k", ["run"]))


def stratified_temperature(level_rows: DataFrame) -> DataFrame:
    """Adds ``T0``: temperature falling with depth, stratification decaying over ``strat_scale``."""
    step = (F.col("N0") * F.col("N0") / C.GRAVITY / C.EXPANSION * (-F.col("dz"))
            * F.exp(-F.col("z") / F.col("strat_scale")))
    return level_rows.withColumn("T0", C.SURFACE_TEMPERATURE + running_sum(step, "k", ["run"]))


# --- bathymetry ------------------------------------------------------------

def straight_breaks() -> Column:
    """Breakpoints (distance from the coast, depth) of a single slope."""
    omega = 2 * math.pi / 3600 / C.TIDE_HOURS
    run_out = F.col("H") / F.col("steepness") / omega * F.col("N0")
    return F.array(
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        F.struct(run_out.alias("x"), (-F.col("H")).alias("y")),
    )


def wavy_breaks() -> Column:
    """Breakpoints of alternating super- and subcritical slopes below a shelf."""
    omega = 2 * math.pi / 3600 / C.TIDE_HOURS
    x, points = F.lit(SHELF_WIDTH), [(F.lit(0.0), WAVY_DEPTHS[0]), (F.lit(SHELF_WIDTH), WAVY_DEPTHS[1])]
    for n in range(2, len(WAVY_DEPTHS)):
        slope = omega / F.col("N0") * WAVY_STEEPNESS[n]
        x = x + (WAVY_DEPTHS[n - 1] - WAVY_DEPTHS[n]) / slope
        points.append((x, WAVY_DEPTHS[n]))
    return F.array(*[F.struct(px.alias("x"), F.lit(py).alias("y")) for px, py in points])


def bathymetry(axis: DataFrame, breaks: Column) -> DataFrame:
    """Adds seafloor height ``d`` (negative down) from coast-based breakpoints.

    More than two breakpoints are smoothed; depth is clipped at -H, the western
    cells are a wall-deep shelf and the last cell is land.
    """
    whole = Window.partitionBy("run")
    rows = axis.withColumn("_b", breaks).withColumn("_coast", F.max("x").over(whole))
    rows = rows.withColumn("_b", F.reverse(F.transform("_b", lambda b: F.struct(
        (F.col("_coast") - b["x"]).alias("x"), b["y"].alias("y")))))
    rows = rows.withColumn("d", piecewise_linear("x", "_b", left=-F.col("H"), right=F.lit(0.0)))
    smooth = moving_average("d", "i", ["run"], SMOOTH_WIDTH)
    rows = rows.withColumn("d", F.when(F.size("_b") > 2, smooth).otherwise(F.col("d")))
    d = F.when(F.col("i") == F.col("nx") - 1, F.lit(0.0)).when(F.col("i") < WALL_CELLS, -F.col("H"))
    d = d.otherwise(F.greatest(F.col("d"), -F.col("H")))
    return rows.withColumn("d", d).drop("_b", "_coast")


# --- forcing and initial fields -------------------------------------------

def tidal_samples(runs: DataFrame) -> DataFrame:
    """Tidal flow at the fixed sample times of one cycle."""
    omega = 2 * math.pi / 3600 / C.TIDE_HOURS
    rows = runs.select("*", _index(F.lit(C.FORCING_SAMPLES), "n"))
    rows = rows.withColumn("time_s", F.col("n") * C.FORCING_STEP_SECONDS)
    return rows.withColumn("u", F.col("u0") * F.sin(omega * F.col("time_s")))


def boundary_forcing(level_rows: DataFrame) -> DataFrame:
    """Tidal flow and reference temperature at every (time, level, row) of the western boundary."""
    rows = tidal_samples(level_rows.select("run", "k", "ny", "u0", "T0"))
    return rows.select("run", "n", "time_s", "k", _index("ny", "j"), "u", F.col("T0").alias("t"))


def initial_fields(level_rows: DataFrame) -> DataFrame:
    """Resting, horizontally uniform start: temperature by level, salinity constant, flow and elevation 0."""
    rows = level_rows.select("run", "k", "nx", "ny", "T0").select("*", _index("ny", "j"))
    return rows.select(
        "run", "k", "j", _index("nx", "i"), F.col("T0").alias("THETA"), F.lit(0.0).alias("UVEL"),
        F.lit(SALINITY).alias("SALT"), F.lit(0.0).alias("ETAN"),
    )


def depth_arrays(level_rows: DataFrame) -> DataFrame:
    """Negative-down level depths of each run as one k-ordered array (nz values)."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "z")))
    return level_rows.groupBy("run").agg(F.transform(ordered, lambda s: -s["z"]).alias("depths"))


def tracer_columns(bathy: DataFrame, level_rows: DataFrame) -> DataFrame:
    """Dosed water columns: for each tracer, five columns around the point where the
    seafloor crosses its depth, with the deepest level still above the seafloor."""
    by_i = Window.partitionBy("run").orderBy("i")
    segment = bathy.select("run", "i", "d", F.lead("d").over(by_i).alias("d_next"))
    targets = F.array(*[F.struct(F.lit(n).alias("tracer"), F.lit(d).alias("depth")) for n, d in TRACER_DEPTHS.items()])
    below = segment.withColumn("t", F.explode(targets)).where(F.col("d") <= F.col("t.depth"))
    last = below.groupBy("run", "t.tracer", "t.depth").agg(F.max_by(F.struct("i", "d", "d_next"), "i").alias("s"))
    fraction = F.coalesce(F.try_divide(F.col("depth") - F.col("s.d"), F.col("s.d_next") - F.col("s.d")), F.lit(0.0))
    middle = half_even(F.col("s.i") + fraction).cast("int")
    around = F.explode(F.sequence(middle + TRACER_COLUMNS[0], middle + TRACER_COLUMNS[1]))
    columns = last.select("run", "tracer", around.alias("i")).join(bathy.select("run", "i", "d"), ["run", "i"])
    return columns.join(depth_arrays(level_rows), "run").select(
        "run", "tracer", "i", deepest_above("depths", "d").alias("k_bottom")
    )


def tracer_fields(bathy: DataFrame, level_rows: DataFrame) -> DataFrame:
    """Initial tracer concentrations: a dose in the first row, in the four levels above the seafloor near each target depth.

    Doses are attached to the axis rows (one row per column) before levels are exploded.
    """
    doses = tracer_columns(bathy, level_rows).groupBy("run", "i").agg(
        F.collect_list(F.struct("tracer", "k_bottom")).alias("doses")
    )
    axis = bathy.select("run", "i", "nz", "ny").join(doses, ["run", "i"], "left")
    cells = axis.select("*", _index("nz", "k")).select("*", _index("ny", "j"))

    def dosed(name):
        hit = F.exists("doses", lambda t: (t["tracer"] == name) & (F.col("k") <= t["k_bottom"])
                       & (F.col("k") > t["k_bottom"] - TRACER_LEVELS))
        return F.when(hit & (F.col("j") == 0), F.lit(TRACER_DOSE)).otherwise(F.lit(TRACER_BACKGROUND)).alias(name)

    return cells.select("run", "k", "j", "i", *[dosed(n) for n in TRACER_DEPTHS])


# --- mixing ----------------------------------------------------------------

def _mixing_cells(bathy: DataFrame, level_rows: DataFrame) -> DataFrame:
    """(column, level) rows with the distance ``_off`` from the nearest slope column to the east.

    Level depths come as one array per run and are exploded in place.
    """
    on_slope = F.col("d") > -F.col("H")
    axis = bathy.select("run", "i", "ny", "d", "x", "H", carry_from_east("x", on_slope, "i", ["run"]).alias("_edge"))
    axis = axis.withColumn("_off", F.when(on_slope, F.lit(0.0)).otherwise(F.col("_edge") - F.col("x")))
    columns = axis.join(depth_arrays(level_rows), "run")
    cells = columns.select("run", "i", "ny", "d", "H", "_off", F.posexplode("depths").alias("k", "_depth"))
    return cells.withColumn("z", -F.col("_depth")).drop("_depth")


def _first_row(cells: DataFrame) -> DataFrame:
    """Whole volume of a diffusivity that is given for the first row; the others have the floor."""
    rows = cells.select("*", _index("ny", "j"))
    return rows.select("run", "k", "j", "i", F.when(F.col("j") == 0, F.col("Kr")).otherwise(F.lit(C.DIFFUSIVITY_FLOOR)).alias("Kr"))


def seafloor_rows(bathy: DataFrame) -> DataFrame:
    """Seafloor of every row ``j``: the slope in the first one, land (depth 0) in the others."""
    rows = bathy.select("*", _index("ny", "j"))
    return rows.withColumn("d", F.when(F.col("j") == 0, F.col("d")).otherwise(F.lit(0.0)))


def bottom_diffusivity(bathy: DataFrame, level_rows: DataFrame, decay: float = 250.0,
                       strength: float = 1e-2) -> DataFrame:
    """Diffusivity decaying exponentially above the seafloor and away from the slope, with a floor."""
    cells = _mixing_cells(bathy, level_rows)
    k = strength * F.exp((F.col("z") + F.col("d")) / decay) * F.exp(-F.col("_off") / OFF_SLOPE_DECAY)
    k = F.when(F.col("i") == 0, F.lit(C.DIFFUSIVITY_FLOOR)).otherwise(floor_at(k, C.DIFFUSIVITY_FLOOR))
    return _first_row(cells.withColumn("Kr", k))


def block_diffusivity(bathy: DataFrame, level_rows: DataFrame, decay: float = 250.0,
                      strength: float = 1e-2) -> DataFrame:
    """Diffusivity raised in a fixed layer above the seafloor, smoothed in log space over depth."""
    cells = _mixing_cells(bathy, level_rows)
    near = -F.col("z") < F.col("d") + decay
    raised = strength * F.exp(-F.col("_off") / OFF_SLOPE_DECAY)
    cells = cells.withColumn("_k", F.when(near, raised).otherwise(F.lit(C.DIFFUSIVITY_FLOOR)))
    smooth = moving_geometric_mean("_k", "k", ["run", "i"], MIX_SMOOTH_WIDTH)
    k = F.when(F.col("i") == 0, F.lit(C.DIFFUSIVITY_FLOOR)).otherwise(floor_at(smooth, C.DIFFUSIVITY_FLOOR))
    return _first_row(cells.withColumn("Kr", k))
