"""Small dense grids with known fields."""

from __future__ import annotations

import numpy as np
import pandas as pd

SHAPE = (5, 4, 6)  # k, j, i


def frame(spark, fields: dict[str, np.ndarray], run="r", rec=0, stream="s"):
    """Cell rows of (k, j, i) arrays; NaN stays NaN (cleaned by the caller when wanted)."""
    shape = next(iter(fields.values())).shape
    k, j, i = np.indices(shape).reshape(3, -1)
    pdf = pd.DataFrame({"run": run, "stream": stream, "rec": np.int32(rec), "iter": np.int64(rec * 10), "time_s": rec * 100.0,
                        "k": k.astype("i4"), "j": j.astype("i4"), "i": i.astype("i4")})
    for name, values in fields.items():
        pdf[name] = values.reshape(-1).astype(float)
    return spark.createDataFrame(pdf)


def grid2d(spark, nj, ni, run="r", **fields):
    j, i = np.indices((nj, ni)).reshape(2, -1)
    pdf = pd.DataFrame({"run": run, "j": j.astype("i4"), "i": i.astype("i4")})
    base = {"rA": 10.0, "rAw": 10.0, "rAs": 10.0, "rAz": 10.0, "dxG": 2.0, "dyG": 5.0, "dxC": 2.0, "dyC": 5.0, "Depth": 100.0}
    for name, value in {**base, **fields}.items():
        pdf[name] = np.broadcast_to(np.asarray(value, float), (nj, ni)).reshape(-1)
    return spark.createDataFrame(pdf)


def grid1d(spark, nk, run="r", dz=10.0, t0=20.0):
    k = np.arange(nk)
    drf = np.broadcast_to(np.asarray(dz, float), (nk,))
    z = -(np.cumsum(drf) - drf / 2)
    pdf = pd.DataFrame({"run": run, "k": k.astype("i4"), "Z": z, "drF": drf, "drC": np.gradient(-z) if nk > 1 else drf, "T0": np.broadcast_to(np.asarray(t0, float), (nk,))})
    return spark.createDataFrame(pdf)


def profile(df, column, key="k"):
    """Column values in key order."""
    return [r[column] for r in df.orderBy(key).collect()]


def cube(df, column, shape):
    """(k, j, i) array of a cell column, NaN where missing or absent."""
    out = np.full(shape, np.nan)
    for r in df.select("k", "j", "i", column).collect():
        out[r["k"], r["j"], r["i"]] = np.nan if r[column] is None else r[column]
    return out
