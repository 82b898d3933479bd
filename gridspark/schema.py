"""Table layouts and the key-column conventions shared by all operators.

The same ``(k, j, i)`` row holds all staggered positions: U sits on the west
face of ``i``, V on the south face of ``j``, W on the top interface of ``k``.
Missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = ["run", "rec"]
LEVEL = ["run", "rec", "k"]
COLUMN = ["run", "rec", "j", "i"]
CELL = ["run", "rec", "k", "j", "i"]
POINT = ["run", "k", "j", "i"]

#: Fields of the 3-D output streams, in file order of the widest stream.
FIELDS_3D = [
    "UVEL", "VVEL", "WVEL", "THETA", "PHIHYD",
    "TRAC01", "TRAC02", "TRAC03", "TRAC04", "KLeps", "KLviscAr",
]
FIELDS_2D = ["ETAN", "PHIBOT"]
METRICS_3D = ["hFacC", "hFacW", "hFacS"]
#: Centre distances (C) and face lengths (G) differ on stretched grids; rAz is the area around corners.
METRICS_2D = ["XC", "YC", "XG", "YG", "rA", "rAw", "rAs", "rAz", "dxG", "dyG", "dxC", "dyC", "Depth"]
METRICS_1D = ["Z", "drF", "drC", "T0"]


def _doubles(names):
    return [T.StructField(n, T.DoubleType()) for n in names]


def _ints(names):
    return [T.StructField(n, T.IntegerType()) for n in names]


_RUN = T.StructField("run", T.StringType())
_TIME = [T.StructField("iter", T.LongType()), T.StructField("time_s", T.DoubleType())]


def cells_schema(fields=FIELDS_3D) -> T.StructType:
    """Cell rows of one or more 3-D streams."""
    return T.StructType(
        [_RUN, T.StructField("stream", T.StringType())]
        + _ints(["rec"]) + _TIME + _ints(["k", "j", "i"]) + _doubles(fields)
    )


def cells2d_schema(fields=FIELDS_2D) -> T.StructType:
    """Rows of a 2-D stream (free surface, bottom pressure)."""
    return T.StructType([_RUN] + _ints(["rec"]) + _TIME + _ints(["j", "i"]) + _doubles(fields))


GRID3D = T.StructType([_RUN] + _ints(["k", "j", "i"]) + _doubles(METRICS_3D))
GRID2D = T.StructType([_RUN] + _ints(["j", "i"]) + _doubles(METRICS_2D))
GRID1D = T.StructType([_RUN] + _ints(["k"]) + _doubles(METRICS_1D))
ACCOUNTING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("job_id", "state", "reason", "exit_code", "elapsed")]
)
