"""Decomposition of the pressure flux along a slice into column-mean and remainder parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from gridspark import constants as C
from gridspark.functions.scalars import total
from gridspark.operators.metrics import with_surface
from gridspark.operators.select import mask_land
from gridspark.schema import COLUMN, LEVEL

PARTS = ["UpPp", "UbPb", "UpPb", "UbPp"]


def flux_decomposition(slice3d: DataFrame, slice2d: DataFrame) -> DataFrame:
    """Mean along the slice of the four products of column-mean (b) and remainder (p) U and P.

    The barotropic pressure is the surface elevation times gravity; land (zero
    temperature) is missing everywhere.
    """
    rows = with_surface(slice3d.select(*LEVEL, "j", "i", "UVEL", "PHIHYD", "THETA"), slice2d, "ETAN")
    rows = rows.withColumn("_u", mask_land("UVEL", "THETA")).withColumn("_p", mask_land("PHIHYD", "THETA"))
    rows = rows.withColumn("_ub", F.avg("_u").over(Window.partitionBy(*COLUMN)))
    up, ub = F.col("_u") - F.col("_ub"), F.when(F.col("_u").isNotNull(), F.col("_ub"))
    pb = F.when(F.col("_p").isNotNull(), F.col("ETAN") * C.GRAVITY)
    pp = F.col("_p") - pb
    products = {"UpPp": up * pp, "UbPb": ub * pb, "UpPb": up * pb, "UbPp": ub * pp}
    return rows.groupBy(*LEVEL).agg(*[F.avg(products[p]).alias(p) for p in PARTS])


def flux_totals(profile: DataFrame, dz: float = C.PROFILE_DZ) -> DataFrame:
    """Vertical sums of the four mean products times the level thickness."""
    return profile.groupBy("run", "rec").agg(*[(total(p) * dz).alias(f"{p}_total") for p in PARTS])
