"""Column expressions: missing-data rules, clamps, scalings and formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridspark import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing data ----------------------------------------------------------

def missing(c) -> Column:
    """NaN becomes NULL, so that sums and means skip it."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def total(c) -> Column:
    """Sum that is 0 when every term is missing."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def weighted_mean(value, weight) -> Column:
    """Aggregate mean of ``value`` by ``weight``; NULL when nothing has weight."""
    value, weight = _col(value), _col(weight)
    used = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(used))


# --- clamps and rounding ---------------------------------------------------

def floor_at(c, low: float) -> Column:
    """Values below ``low`` become ``low``; missing stays missing."""
    c = _col(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def half_even(c) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(_col(c))


def ceiling(c) -> Column:
    return F.ceil(_col(c)).cast("double")


# --- tide, slope and drag scalings ----------------------------------------

def tidal_frequency(period_hours: float = C.TIDE_HOURS) -> Column:
    return F.lit(2 * math.pi / 3600 / period_hours)


def wave_slope(omega, coriolis, stratification) -> Column:
    """Slope of internal-wave rays, sqrt((w^2 - f^2) / (N^2 - w^2))."""
    w2, f2, n2 = (F.pow(_col(c), F.lit(2.0)) for c in (omega, coriolis, stratification))
    ratio = F.try_divide(w2 - f2, n2 - w2)
    return F.when(ratio >= 0, F.sqrt(ratio))


def seafloor_slope(steepness, slope) -> Column:
    return _col(steepness) * _col(slope)


def wavelength(wavenumber_index) -> Column:
    """Topographic wavelength of a run's wavenumber index, in metres."""
    return 2 * math.pi / (_col(wavenumber_index) * 1e-4 / 10) * 3


def inverse_froude(u0, stratification, height) -> Column:
    return F.try_divide(F.try_divide(_col(u0), _col(stratification)), _col(height))


def drag_first_order(stratification, u0, height, length) -> Column:
    """Lee-wave drag times flow, mW/m^2, to first order in height."""
    u0, height = _col(u0), _col(height)
    return F.try_divide(
        1000.0 * 1000.0 * _col(stratification) * u0 * u0 * height * height * math.pi / 2.0, _col(length)
    )


def drag_second_order(stratification, u0, height, length) -> Column:
    first = drag_first_order(stratification, u0, height, length)
    return first * (1 + math.pi * inverse_froude(u0, stratification, height))


def days(seconds) -> Column:
    return _col(seconds) / 24 / 3600


# --- text ------------------------------------------------------------------

def scientific(c, digits: int = 3) -> Column:
    """Text like ``1.400e-04``."""
    return F.format_string(f"%1.{digits}e", _col(c))


def fixed(c, digits: int = 2) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%1.{digits}f", _col(c))


def last_number(line) -> Column:
    """Last whitespace-separated token of a line as a number, NULL if it is none."""
    return F.element_at(F.split(F.trim(_col(line)), r"\s+"), -1).try_cast("double")
