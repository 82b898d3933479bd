"""Weighted reductions of cell rows to depth profiles, totals and means.

Each reduction is one grouped aggregation: partial sums are formed before the
only shuffle, which then carries runs x records x levels rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from gridspark import constants as C
from gridspark.functions.scalars import total
from gridspark.operators.metrics import with_horizontal, with_vertical
from gridspark.operators.select import keep_positive, mask_land, records_between
from gridspark.schema import COLUMN, LEVEL
from gridspark.sources.shared import settle


def run_parameters(rows: DataFrame, parameters: DataFrame | None, **defaults: float) -> DataFrame:
    """Adds a column per named parameter: the run's own value in ``parameters`` (``run`` and
    any of the names), else the default.  Call it on reduced rows; the table has a row per run."""
    own = [n for n in defaults if parameters is not None and n in parameters.columns]
    if own:
        rows = rows.join(parameters.select("run", *own).dropDuplicates(["run"]), "run", "left")
    return rows.withColumns({n: F.coalesce(n, F.lit(d)) if n in own else F.lit(d) for n, d in defaults.items()})


def run_area(grid2d: DataFrame) -> DataFrame:
    """Total centre and south-face area of each run."""
    return grid2d.groupBy("run").agg(total("rA").alias("area"), total("rAs").alias("area_s"))


def work_profile(cells: DataFrame, grid2d: DataFrame, f0: float = 1.4e-4, u0: float = 0.1,
                 parameters: DataFrame | None = None) -> DataFrame:
    """Work of the background flow per level: sum of V x wet fraction x area x f0 x U0.

    ``parameters`` gives ``f0`` and ``u0`` by run where they differ.
    """
    rows = with_horizontal(cells, grid2d, "rAs")
    summed = rows.groupBy(*LEVEL).agg(total(F.col("VVEL") * F.col("hFacS") * F.col("rAs")).alias("_v"))
    summed = run_parameters(summed, parameters, f0=f0, u0=u0)
    return summed.select(*LEVEL, (F.col("_v") * F.col("f0") * F.col("u0")).alias("work"))


def mean_flow_profile(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    """Area-weighted sum of U per level, and the same divided by the run's south-face area."""
    rows = with_horizontal(cells, grid2d, "rAw")
    summed = rows.groupBy(*LEVEL).agg(total(F.col("UVEL") * F.col("hFacW") * F.col("rAw")).alias("sum_u"))
    area = run_area(grid2d).select("run", "area_s")
    return summed.join(area, "run").select(*LEVEL, "sum_u", F.try_divide("sum_u", "area_s").alias("mean_u"))


def window_mean_flow(cells: DataFrame, grid1d: DataFrame, low: float = -2000.0, high: float = -50.0,
                     background: float = 0.0, parameters: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of U (minus the background) and V between two depths, per record.

    ``parameters`` gives the background as ``u0`` by run.
    """
    levels = grid1d.where((F.col("Z") > low) & (F.col("Z") < high)).select("run", "k")
    inside = cells.select("run", "rec", "k", "UVEL", "VVEL").join(levels, ["run", "k"], "left_semi")
    means = inside.groupBy("run", "rec").agg(F.avg("UVEL").alias("u_mean"), F.avg("VVEL").alias("v_mean"))
    means = run_parameters(means, parameters, u0=background)
    return means.select("run", "rec", (F.col("u_mean") - F.col("u0")).alias("u_mean"), "v_mean")


def demeaning(cells: DataFrame, grid1d: DataFrame, low: float = -2000.0, high: float = -50.0,
              background: float = 0.0, parameters: DataFrame | None = None) -> DataFrame:
    """Settled ``window_mean_flow``: one row per record, so joining it does not shuffle the cells
    while it fits the broadcast threshold."""
    return settle(window_mean_flow(cells, grid1d, low, high, background, parameters), "window-means")


def less_means(cells: DataFrame, means: DataFrame) -> DataFrame:
    """Cells with their record's means taken off U and V."""
    return (
        cells.join(means, ["run", "rec"])
        .withColumn("UVEL", F.col("UVEL") - F.col("u_mean"))
        .withColumn("VVEL", F.col("VVEL") - F.col("v_mean"))
        .drop("u_mean", "v_mean")
    )


def demean(cells: DataFrame, grid1d: DataFrame, low: float = -2000.0, high: float = -50.0,
           background: float = 0.0, parameters: DataFrame | None = None) -> DataFrame:
    """Subtract each record's depth-window mean from U and V."""
    return less_means(cells, demeaning(cells, grid1d, low, high, background, parameters))


def column_totals(profile: DataFrame, area: DataFrame, fields: list[str], dz: float = C.PROFILE_DZ) -> DataFrame:
    """Depth-integrated profiles per square kilometre of run area."""
    sums = profile.groupBy("run").agg(*[total(f).alias(f) for f in fields])
    per_km2 = F.col("area") / 1e6
    return sums.join(area.select("run", "area"), "run").select(
        "run", *[F.try_divide(F.col(f) * dz, per_km2).alias(f"{f}_total") for f in fields]
    )


def normalised_profiles(profile: DataFrame, area: DataFrame, fields: list[str]) -> DataFrame:
    """Profiles divided by run area."""
    return profile.join(area.select("run", "area"), "run").select(
        "run", "k", *[F.try_divide(f, "area").alias(f"{f}_norm") for f in fields]
    )


def temperature_profile(cells: DataFrame, offset: float = 28.0, scale: float = -0.2) -> DataFrame:
    """Horizontal mean of positive temperatures per level, and its scaled displacement."""
    means = cells.groupBy(*LEVEL).agg(F.avg(keep_positive("THETA")).alias("t_mean"))
    return means.withColumn("displacement", (F.col("t_mean") - offset) * scale)


def split_vertical_mean(cells: DataFrame, field: str = "UVEL", companion: str = "THETA") -> DataFrame:
    """Masked column mean (``Ub``) and the remainder (``Up``) of a field."""
    whole_column = Window.partitionBy(*COLUMN)
    return (
        cells.withColumn("_m", mask_land(field, companion))
        .withColumn("Ub", F.avg("_m").over(whole_column))
        .withColumn("Up", F.col("_m") - F.col("Ub"))
        .drop("_m")
    )


def mean_of_last(cells: DataFrame, records: DataFrame, fields: list[str], n: int = 5) -> DataFrame:
    """Per-cell mean over a run's last ``n`` records."""
    recent = records_between(cells, records, start=-n)
    return recent.groupBy("run", "k", "j", "i").agg(*[F.avg(f).alias(f) for f in fields])


def profile_range(grid1d: DataFrame, field: str = "T0") -> DataFrame:
    """Smallest and largest value of a level profile per run."""
    return grid1d.groupBy("run").agg(F.min(field).alias("low"), F.max(field).alias("high"))


def first_last_change(profile: DataFrame, field: str, first: int, last: int, by: list[str]) -> DataFrame:
    """Value at record ``last`` minus value at record ``first``, without a self-join."""
    def pick(rec):
        return F.sum(F.when(F.col("rec") == rec, F.col(field)))

    return profile.groupBy(*by).agg((pick(last) - pick(first)).alias(f"d_{field}"))


def change_over_run(profile: DataFrame, records: DataFrame, field: str, by: list[str]) -> DataFrame:
    """Value at each run's last record minus the value at its first, whatever their numbers."""
    ends = records.where((F.col("pos") == 0) | (F.col("pos") == F.col("n_rec") - 1))
    ends = ends.select("run", "rec", F.when(F.col("n_rec") == 1, 0).when(F.col("pos") == 0, -1).otherwise(1).alias("_sign"))
    marked = profile.join(ends, ["run", "rec"])
    return marked.groupBy(*by).agg(F.sum(F.col(field) * F.col("_sign")).alias(f"d_{field}"))


def depth_ordered(profile: DataFrame) -> DataFrame:
    return profile.orderBy(*[c for c in LEVEL if c in profile.columns])
