"""Monitor statistics of stored fields.

Per-field statistics are computed side by side - one pass for the extremes, one for the moments
about them - and only the reduced row (one per record) is unpivoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.scalars import weighted_mean
from gridspark.operators.metrics import present, with_horizontal, with_vertical
from gridspark.schema import RECORD
from gridspark.sources.shared import settle

# field: (wet fraction used as a weight, area, thickness); W is weighted by wet/dry only, over
# the distance between centres, since it sits on interfaces.
_WEIGHTS = {
    "UVEL": ("hFacW", "rAw", "drF"),
    "VVEL": ("hFacS", "rAs", "drF"),
    "WVEL": ("mask", "rA", "drC"),
    "THETA": ("hFacC", "rA", "drF"),
    "SALT": ("hFacC", "rA", "drF"),
}


def _moments(rows: DataFrame, wanted: dict[str, tuple[Column, Column]], keys: list[str]) -> DataFrame:
    """One row per (record, field): wet min, max, weighted mean and standard deviation.

    Squares are summed of departures from the record's smallest value, found first: a difference of
    large squares would lose the digits of a small spread.  A minimum far below the rest is part
    of the spread, so the loss stays within the rounding of a weight.
    """
    rows = rows.select(*keys, *[v.alias(f"{f}__v") for f, (v, _) in wanted.items()], *[w.alias(f"{f}__u") for f, (_, w) in wanted.items()])
    wet = lambda f: F.when(F.col(f"{f}__u") > 0, F.col(f"{f}__v"))
    ends = rows.groupBy(*keys).agg(*[g(wet(f)).alias(f"{f}__{n}") for f in wanted for n, g in (("min", F.min), ("max", F.max))])
    ends = settle(ends, "record-ends")  # a row per record
    sums = []
    for f in wanted:
        off = wet(f) - F.col(f"{f}__min")
        used = F.when(off.isNotNull(), F.col(f"{f}__u"))
        sums += [F.sum(used).alias(f"{f}__w"), F.sum(used * off).alias(f"{f}__wx"), F.sum(used * off * off).alias(f"{f}__wxx")]
    narrow = ends.select(*keys, *[f"{f}__min" for f in wanted])
    wide = rows.join(narrow, keys).groupBy(*keys).agg(*sums).join(ends, keys)
    packed = []
    for f in wanted:
        off, square = F.try_divide(f"{f}__wx", f"{f}__w"), F.try_divide(f"{f}__wxx", f"{f}__w")
        packed.append(F.struct(
            F.lit(f).alias("field"), F.col(f"{f}__min").alias("min"), F.col(f"{f}__max").alias("max"),
            (F.col(f"{f}__min") + off).alias("mean"), F.sqrt(F.greatest(square - off * off, F.lit(0.0))).alias("sd"),
        ))
    return wide.select(*keys, F.explode(F.array(*packed)).alias("s")).select(*keys, "s.*")


def field_statistics(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame,
                     fields: tuple[str, ...] = ("UVEL", "VVEL", "WVEL", "THETA")) -> DataFrame:
    """Wet min, max, volume-weighted mean and standard deviation per record and field."""
    areas = sorted({_WEIGHTS[f][1] for f in fields})
    rows = with_vertical(with_horizontal(cells, grid2d, *areas), grid1d, *sorted({_WEIGHTS[f][2] for f in fields}))
    wanted = {}
    for f in fields:
        wet, area, thick = _WEIGHTS[f]
        fraction = F.when(F.col("hFacC") > 0, F.lit(1.0)).otherwise(0.0) if wet == "mask" else F.col(wet)
        wanted[f] = F.col(f), fraction * F.col(area) * F.col(thick)
    return _moments(rows, wanted, RECORD)


def surface_statistics(cells2d: DataFrame, grid2d: DataFrame, fields: tuple[str, ...] = ("ETAN",)) -> DataFrame:
    """The same for 2-D fields, area-weighted over positions with water below."""
    rows = with_horizontal(cells2d, grid2d, "rA", "Depth")
    weight = F.when(F.col("Depth") > 0, F.col("rA")).otherwise(0.0)
    return _moments(rows, {f: (F.col(f), weight) for f in fields}, RECORD)


def top_level_statistics(cells: DataFrame, grid2d: DataFrame, fields: tuple[str, ...] = ("THETA",)) -> DataFrame:
    """The same for the top level of 3-D fields (surface temperature), area-weighted where it is wet."""
    rows = with_horizontal(cells.where(F.col("k") == 0), grid2d, "rA")
    weight = F.when(F.col("hFacC") > 0, F.col("rA")).otherwise(0.0)
    return _moments(rows, {f: (F.col(f), weight) for f in fields}, RECORD)


def advective_cfl(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame, dt: float) -> DataFrame:
    """Largest advective CFL numbers per record over centre distances, and W's over the partial cell's thickness."""
    rows = with_vertical(with_horizontal(cells, grid2d, "dxC", "dyC"), grid1d, "drF", "drC")
    w_over_dz = F.try_divide(F.abs("WVEL") * dt, F.col("drC"))
    w_over_cell = F.try_divide(F.abs("WVEL") * dt, F.col("drF"))
    return rows.groupBy(*RECORD).agg(
        F.max(F.try_divide(F.abs("UVEL") * dt, F.col("dxC"))).alias("cfl_u"),
        F.max(F.try_divide(F.abs("VVEL") * dt, F.col("dyC"))).alias("cfl_v"),
        F.max(w_over_dz).alias("cfl_w"),
        F.max(F.when(F.col("hFacC") > 0, F.try_divide(w_over_cell, F.col("hFacC")))).alias("cfl_w_hf"),
    )


def kinetic_energy_statistics(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame) -> DataFrame:
    """Largest and volume-mean kinetic energy of co-located velocities per record, and the wet volume."""
    rows = with_vertical(with_horizontal(cells, grid2d, "rA"), grid1d, "drF")
    ke = 0.5 * (F.col("UVEL") * F.col("UVEL") + F.col("VVEL") * F.col("VVEL"))
    volume = F.col("hFacC") * F.col("rA") * F.col("drF")
    return rows.groupBy(*RECORD).agg(
        F.max(F.when(volume > 0, ke)).alias("ke_max"), weighted_mean(ke, volume).alias("ke_mean"),
        F.sum(volume).alias("volume"),
    )


def relative_vorticity(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    """Circulation along centre distances around each corner over the corner's area, where all four edges exist.

    Every cell hands its edge contributions to the three corners that use them;
    one grouped sum (with map-side partial sums) collects them, instead of two
    window sorts in different directions.
    """
    metrics = ("dxC", "dyC", "rAz")
    rows = with_horizontal(cells.select("run", "rec", "k", "j", "i", "UVEL", "VVEL", *present(cells, *metrics)), grid2d, *metrics)
    v, u = F.col("VVEL") * F.col("dyC"), F.col("UVEL") * F.col("dxC")
    one = lambda c: F.when(c.isNotNull(), F.lit(1)).otherwise(0)

    def give(dj, di, value, edges):
        area = F.col("rAz") if (dj, di) == (0, 0) else F.lit(None).cast("double")
        return F.struct((F.col("j") + dj).alias("j"), (F.col("i") + di).alias("i"),
                        value.alias("c"), edges.alias("n"), area.alias("a"))

    both = F.coalesce(v, F.lit(0.0)) - F.coalesce(u, F.lit(0.0))
    gifts = F.array(
        give(0, 0, both, one(v) + one(u)),
        give(0, 1, -F.coalesce(v, F.lit(0.0)), one(v)),
        give(1, 0, F.coalesce(u, F.lit(0.0)), one(u)),
    )
    corners = rows.select("run", "rec", "k", F.explode(gifts).alias("g")).select("run", "rec", "k", "g.*")
    summed = corners.groupBy("run", "rec", "k", "j", "i").agg(
        F.sum("c").alias("_c"), F.sum("n").alias("_n"), F.max("a").alias("_a"))
    return summed.where(F.col("_n") == 4).select("run", "rec", "k", "j", "i", F.try_divide("_c", "_a").alias("vort"))


def vorticity_statistics(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    vort = relative_vorticity(cells, grid2d)
    return vort.groupBy(*RECORD).agg(
        F.min("vort").alias("vort_min"), F.max("vort").alias("vort_max"),
        F.avg("vort").alias("vort_mean"), F.stddev_pop("vort").alias("vort_sd"),
    )


def out_of_bounds(cells: DataFrame, limit: float, field: str = "THETA", wet: str = "hFacC") -> DataFrame:
    """Records whose wet value range exceeds ``limit``."""
    value = F.when(F.col(wet) > 0, F.col(field))
    spans = cells.groupBy(*RECORD).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return spans.where(F.col("high") - F.col("low") > limit)
