"""Averaged power spectra of bathymetry rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEGMENT = 256


def _row_spectrum(values: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of one row: Hann window, constant detrend, no overlap, length-n transform."""
    n = len(values)
    width = min(segment, n)
    pieces = values[: n // width * width].reshape(-1, width)
    pieces = pieces - pieces.mean(axis=1, keepdims=True)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    power = np.abs(np.fft.rfft(pieces * window, n=n, axis=1)) ** 2 / (window ** 2).sum()
    power[:, 1 : (n + 1) // 2] *= 2
    return np.arange(power.shape[1]) / n, power.mean(axis=0)


def row_spectra(rows: DataFrame, value: str = "Depth", segment: int = SEGMENT) -> DataFrame:
    """Spectrum of every (run, j) row; one group is a single grid row."""
    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        freq, power = _row_spectrum(pdf[value].to_numpy(), segment)
        return pd.DataFrame({
            "run": pdf["run"].iloc[0], "j": pdf["j"].iloc[0],
            "m": np.arange(len(freq), dtype="int32"), "freq": freq, "power": power,
        })

    return rows.select("run", "j", "i", value).groupBy("run", "j").applyInPandas(
        spectrum, "run string, j int, m int, freq double, power double"
    )


def mean_spectrum(rows: DataFrame, value: str = "Depth", segment: int = SEGMENT) -> DataFrame:
    """Row spectra averaged over all rows of a run."""
    return row_spectra(rows, value, segment).groupBy("run", "m", "freq").agg(F.avg("power").alias("power"))
