"""Neighbour and running operators along index axes.

Neighbours are found by index value (``rangeBetween``), not by row position, so
gaps in sparse grids give missing values instead of shifted ones.  Cell windows are
always partitioned by a whole water column or a lateral line, whose length is the
grid size in one direction; they never span a level or a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from gridspark import constants as C
from gridspark.functions.scalars import _col, total
from gridspark.schema import COLUMN


def neighbour(value, axis: str, offset: int, line: list[str]) -> Column:
    """Value at ``axis + offset`` on the same line, missing when absent."""
    w = Window.partitionBy(*line).orderBy(axis).rangeBetween(offset, offset)
    return F.first(_col(value)).over(w)


def _whole_line(axis: str, line: list[str]):
    """Frame over a whole line in the same order as the neighbour frame, so both share one sort."""
    return Window.partitionBy(*line).orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def previous_wrapped(value, axis: str, line: list[str]) -> Column:
    """Value at ``axis - 1``; the line's first index takes the value at its last index."""
    wrapped = F.last(_col(value)).over(_whole_line(axis, line))
    return F.when(F.col(axis) == 0, wrapped).otherwise(neighbour(value, axis, -1, line))


def interface_value(value="PHIHYD", weight="hFacC", line=COLUMN) -> Column:
    """Thickness-weighted value on the top interface of ``k``, missing at k = 0 and if both cells are dry."""
    value, weight = _col(value), _col(weight)
    above_v = neighbour(value, "k", -1, line)
    above_h = neighbour(weight, "k", -1, line)
    return F.try_divide(value * weight + above_v * above_h, weight + above_h)


def face_to_centre(value="VVEL", axis: str = "j", periodic: bool = True) -> Column:
    """Average of a face value with its predecessor along ``axis``."""
    line = [c for c in ("run", "rec", "k", "j", "i") if c != axis]
    before = previous_wrapped(value, axis, line) if periodic else neighbour(value, axis, -1, line)
    return 0.5 * (_col(value) + before)


# --- lateral neighbours on tiles with halos ---------------------------------

def tile_line(axis: str) -> list[str]:
    """Keys of a line along ``axis`` inside a tile of ``sources.tables.save_by_tile``."""
    return ["run", "tile_j", "tile_i", *[c for c in ("rec", "k", "j", "i") if c != axis]]


def own_rows(tiles: DataFrame) -> DataFrame:
    """A tile table's rows without the copies from other tiles; drop these once neighbours are found."""
    return tiles.where(~F.col("halo")).drop("halo", "tile_j", "tile_i")


def tile_face_to_centre(value="VVEL", axis: str = "j") -> Column:
    """``face_to_centre`` on tiles with halos: the copies make a periodic axis periodic, no line is shuffled."""
    return 0.5 * (_col(value) + neighbour(value, axis, -1, tile_line(axis)))


def corner_average(tiles: DataFrame, value: str, weight: str, name: str = "corner") -> DataFrame:
    """Weighted mean of the four cells around each cell's south-west corner, from tiles with halos.

    Missing values are left out, and so are cells beyond an open edge; missing where all weights are.
    """
    used = F.when(F.col(value).isNotNull(), F.col(weight))
    rows = tiles.withColumns({"_x": F.col(value) * used, "_w": used})
    for axis in ("i", "j"):
        both = lambda c: F.when(F.col(c).isNotNull() | neighbour(c, axis, -1, tile_line(axis)).isNotNull(),  # noqa: E731, B023
                                F.coalesce(c, F.lit(0.0)) + F.coalesce(neighbour(c, axis, -1, tile_line(axis)), F.lit(0.0)))  # noqa: B023
        rows = rows.withColumns({"_x": both("_x"), "_w": both("_w")})
    return own_rows(rows.withColumn(name, F.try_divide("_x", "_w")).drop("_x", "_w"))


def vertical_divergence(profile: DataFrame, value: str = "WP", thickness: str = "drF",
                        by: list[str] | None = None) -> DataFrame:
    """Adds ``dWPdz``: minus the difference to the next interface over thickness, 0 at both ends."""
    by = by or ["run", "rec"]
    last = F.last("k").over(_whole_line("k", by))
    below = neighbour(value, "k", 1, by)
    inside = -F.try_divide(below - F.col(value), F.col(thickness))
    return profile.withColumn("dWPdz", F.when(F.col("k").between(1, last - 1), inside).otherwise(F.lit(0.0)))


# --- running sums on axis tables ------------------------------------------

def running_sum(value, axis: str, line: list[str]) -> Column:
    w = Window.partitionBy(*line).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(_col(value)).over(w)


def coordinate(spacing, axis: str, line: list[str], from_first: bool = False) -> Column:
    """Coordinate by summing spacing; optionally relative to the first one."""
    summed = running_sum(spacing, axis, line)
    if not from_first:
        return summed
    first = F.first(_col(spacing)).over(Window.partitionBy(*line).orderBy(axis))
    return summed - first


def reference_profile(levels: DataFrame, stratification="N0", thickness="dz") -> DataFrame:
    """Adds ``T0``: surface temperature minus the summed linear stratification, inclusive of the level."""
    n2 = _col(stratification) * _col(stratification)
    step = n2 / C.GRAVITY / C.EXPANSION * _col(thickness)
    return levels.withColumn("T0", C.SURFACE_TEMPERATURE - running_sum(step, "k", ["run"]))


def moving_average(value, axis: str, line: list[str], width: int) -> Column:
    """Moving average padded with zeros at the ends and divided by the full width.

    A width of 10 covers 5 before to 4 after; a width of 15 covers 7 either side.
    """
    w = Window.partitionBy(*line).orderBy(axis).rowsBetween(-(width // 2), width - 1 - width // 2)
    return F.sum(_col(value)).over(w) / width


def moving_geometric_mean(value, axis: str, line: list[str], width: int) -> Column:
    """Moving geometric mean, padded with ones (log 0) at the ends."""
    return F.pow(F.lit(10.0), moving_average(F.log10(_col(value)), axis, line, width))


def carry_from_east(value, condition, axis: str, line: list[str]) -> Column:
    """Scanning from the highest index, the latest value met where ``condition`` held."""
    w = Window.partitionBy(*line).orderBy(F.col(axis).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(condition, _col(value)), ignorenulls=True).over(w)


def pair_sums(value: str, weight: str) -> list[Column]:
    """Aggregates of a strip at one position: weighted half squares and weights."""
    squares = 0.5 * F.col(value) * F.col(value) * F.col(weight)
    return [total(squares).alias("_num"), F.sum(weight).alias("_den")]


def pair_mean(axis: str, line: list[str]) -> Column:
    """Weighted mean over positions ``n`` and ``n + 1`` of sums made by ``pair_sums``."""
    num = F.col("_num") + neighbour("_num", axis, 1, line)
    den = F.col("_den") + neighbour("_den", axis, 1, line)
    return F.try_divide(num, den)


def four_point_mean(strip: DataFrame, value: str, weight: str, axis: str, by: list[str]) -> DataFrame:
    """Weighted mean of half squares over two strip lines and two faces ``n, n + 1`` along ``axis``.

    The strip is first summed across its width; only those per-position sums are
    paired with their neighbour.
    """
    sums = strip.groupBy(*by, axis).agg(*pair_sums(value, weight))
    return sums.select(*by, axis, pair_mean(axis, by).alias("pair_mean"))
