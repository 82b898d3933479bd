"""Transport and thickness binned into temperature layers per water column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.interp import edge_bin, linear_edges, uniform_bin
from gridspark.functions.scalars import total
from gridspark.operators.metrics import with_vertical
from gridspark.operators.reduce import profile_range
from gridspark.operators.stencil import neighbour
from gridspark.schema import COLUMN
from gridspark.sources.shared import settle


def layer_edges(grid1d: DataFrame, bins: int = 100) -> DataFrame:
    """Evenly spaced layer edges between the coldest and warmest reference temperature of each run."""
    return profile_range(grid1d).select("run", linear_edges("low", "high", bins).alias("edges"))


def refine_vertically(cells: DataFrame, parts: int = 10) -> DataFrame:
    """Split each cell into ``parts`` thinner ones with linearly interpolated temperature.

    Interpolation is between cell centres; next to land or the domain end the cell's
    own temperature is kept.  Needs ``drF`` on the rows.
    """
    def other(name, offset):
        return neighbour(name, "k", offset, COLUMN)

    wet = F.when(F.col("hFacC") > 0, F.col("THETA"))
    rows = cells.withColumn("_wet", wet)
    rows = (
        rows.withColumn("_up", other("_wet", -1)).withColumn("_dn", other("_wet", 1))
        .withColumn("_hup", other("drF", -1)).withColumn("_hdn", other("drF", 1))
    )
    at = (F.col("_part") + 0.5) / parts - 0.5
    near = F.when(at < 0, F.col("_up")).otherwise(F.col("_dn"))
    gap = 0.5 * (F.col("drF") + F.when(at < 0, F.col("_hup")).otherwise(F.col("_hdn")))
    moved = F.col("THETA") + (near - F.col("THETA")) * F.abs(at) * F.col("drF") / gap
    split = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (
        split.withColumn("THETA", F.coalesce(moved, F.col("THETA")))
        .withColumn("drF", F.col("drF") / parts)
        .drop("_wet", "_up", "_dn", "_hup", "_hdn", "_part")
    )


def _summed(rows: DataFrame, wet: str) -> DataFrame:
    thickness = F.col(wet) * F.col("drF")
    return rows.where(F.col("layer").isNotNull() & (F.col(wet) > 0)).groupBy(*COLUMN, "layer").agg(
        total(F.col("UVEL") * thickness).alias("uh"), total(thickness).alias("h")
    )


def layer_transport(cells: DataFrame, grid1d: DataFrame, bins: int = 100, parts: int = 1,
                    wet: str = "hFacW") -> DataFrame:
    """Transport and thickness in evenly spaced layers spanning each run's reference profile."""
    rows = with_vertical(cells, grid1d, "drF")
    if parts > 1:
        rows = refine_vertically(rows, parts)
    rows = rows.join(settle(profile_range(grid1d), "ranges"), "run")
    return _summed(rows.withColumn("layer", uniform_bin("THETA", "low", "high", bins)), wet)


def layer_transport_at(cells: DataFrame, grid1d: DataFrame, edges: list[float], wet: str = "hFacW") -> DataFrame:
    """The same for given, possibly uneven, ascending edges."""
    rows = with_vertical(cells, grid1d, "drF")
    return _summed(rows.withColumn("layer", edge_bin("THETA", edges)), wet)
