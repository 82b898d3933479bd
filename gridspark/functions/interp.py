"""Interpolation and binning against bounded per-run arrays, as pure column expressions.

Breakpoint lists, level depths and bin edges travel as one array per run and are searched in
the row by bisection, so a row costs the logarithm of their number.  That replaces range
joins: the only join left is an equi-join on the run.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.functions.scalars import _col


def count_leading(values, holds) -> Column:
    """How many leading elements of an array satisfy ``holds``, a condition that is true up to some element and false after.

    Bisection: the number of steps is the logarithm of the size, whatever the row.
    """
    values = _col(values)
    size = F.size(values)
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(size + 1)).cast("int"), F.lit(1)))

    def step(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        inside = (s["low"] < s["high"]) & F.coalesce(holds(F.get(values, middle)), F.lit(False))
        return F.struct(F.when(inside, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(inside | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.greatest(size, F.lit(0)).alias("high"))
    return F.aggregate(steps, start, step, lambda s: s["low"])


def piecewise_linear(x, breaks, left=None, right=None) -> Column:
    """Linear interpolation of ``x`` through ``breaks``, an x-sorted ``array<struct<x,y>>``.

    Outside the range the result is ``left``/``right``, by default the end values.
    """
    x, breaks = _col(x), _col(breaks)
    below = count_leading(breaks, lambda b: b["x"] <= x)
    pair = F.slice(breaks, F.greatest(below, F.lit(1)), F.lit(2))  # the points on both sides, found once
    first, last = F.element_at(breaks, 1), F.element_at(breaks, -1)

    def between(p):
        lo, hi = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return lo["y"] + (hi["y"] - lo["y"]) / (hi["x"] - lo["x"]) * (x - lo["x"])

    inside = F.element_at(F.transform(F.array(pair), between), 1)
    left = first["y"] if left is None else left
    right = last["y"] if right is None else right
    return (
        F.when(x.isNull() | (F.size(breaks) < 1), F.lit(None).cast("double"))
        .when(x < first["x"], left)
        .when(x > last["x"], right)
        .when(x == last["x"], last["y"])
        .otherwise(inside)
    )


def deepest_above(level_depths, boundary) -> Column:
    """Index of the last level lying above ``boundary`` (both negative downwards), NULL if none.

    Levels are ordered from the surface down.
    """
    depths, boundary = _col(level_depths), _col(boundary)
    above = count_leading(depths, lambda z: z > boundary)
    return F.when(above > 0, above - 1)


def uniform_bin(c, low, high, bins: int) -> Column:
    """0-based uniform bin between ``low`` and ``high``; values outside fall in the end bins."""
    c, low, high = _col(c), _col(low), _col(high)
    raw = F.width_bucket(c, low, high, F.lit(bins))
    return (F.least(F.greatest(raw, F.lit(1).cast("bigint")), F.lit(bins).cast("bigint")) - 1).cast("int")


def edge_bin(c, edges: list[float]) -> Column:
    """0-based bin among fixed ascending ``edges``; outside values fall in the end bins.

    Built as a balanced comparison tree, so a row costs log2(bins) comparisons and
    stays inside generated code.
    """
    c = _col(c)
    inner = edges[1:-1]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < inner[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(c.isNotNull(), tree(0, len(inner)))


def linear_edges(low, high, bins: int) -> Column:
    """Array of ``bins + 1`` evenly spaced edges."""
    low, high = _col(low), _col(high)
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda n: low + (high - low) / bins * n)
