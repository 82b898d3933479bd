"""Windows over model time: tidal averages, shifted averages, snapshots, phase composites.

Model seconds become event time, so the same definitions serve batch and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark import constants as C
from gridspark.functions.scalars import _col
from gridspark.sources.shared import settle


def event_time(seconds="time_s") -> Column:
    return F.timestamp_seconds(_col(seconds))


def time_window(ts, period: float, phase: float = 0.0) -> Column:
    """Tumbling window of ``period`` seconds starting at ``phase`` past the epoch."""
    def text(seconds):
        return f"{int(round(seconds * 1_000_000))} microseconds"

    return F.window(_col(ts), text(period), startTime=text(phase)) if phase else F.window(_col(ts), text(period))


def window_average(rows: DataFrame, keys: list[str], fields: list[str], period: float,
                   phase: float = 0.0, ts="ts") -> DataFrame:
    """Mean of fields per window and key; ``t0`` is the window start in seconds."""
    grouped = rows.groupBy(time_window(ts, period, phase).alias("w"), *keys)
    means = grouped.agg(*[F.avg(f).alias(f) for f in fields], F.count("*").alias("n"))
    return means.select(F.unix_seconds("w.start").alias("t0"), *keys, *fields, "n")


def tidal_average(cells: DataFrame, fields: list[str], keys=("run", "k", "j", "i")) -> DataFrame:
    """Average over whole tidal periods, per cell."""
    return window_average(cells.withColumn("ts", event_time()), list(keys), fields, C.TIDE_SECONDS)


def shifted_average(cells: DataFrame, fields: list[str], keys=("run", "k", "j", "i")) -> DataFrame:
    """Average over snapshot intervals centred on the snapshots (window shifted by half)."""
    rows = cells.withColumn("ts", event_time())
    return window_average(rows, list(keys), fields, C.SNAPSHOT_SECONDS, C.DISSIPATION_PHASE_SECONDS)


def snapshots(rows: DataFrame, period: float = C.SNAPSHOT_SECONDS) -> DataFrame:
    """Rows lying exactly on the sampling interval."""
    return rows.where(F.pmod(F.col("time_s"), F.lit(float(period))) == 0)


def latest_in_window(rows: DataFrame, keys: list[str], fields: list[str], period: float,
                     order: Column | str = "ts", ts="ts") -> DataFrame:
    """Snapshot of irregular rows: each window's latest row per key."""
    latest = F.max_by(F.struct(*fields), _col(order)).alias("s")
    grouped = rows.groupBy(time_window(ts, period).alias("w"), *keys).agg(latest)
    return grouped.select(F.unix_seconds("w.start").alias("t0"), *keys, "s.*")


def phase_composite(rows: DataFrame, keys: list[str], fields: list[str], cycle: float = C.TIDE_SECONDS,
                    step: float = C.FORCING_STEP_SECONDS) -> DataFrame:
    """Mean by tidal phase bin."""
    phase = F.floor(F.pmod(F.col("time_s"), F.lit(float(cycle))) / step).cast("int")
    return rows.groupBy(*keys, phase.alias("phase")).agg(*[F.avg(f).alias(f) for f in fields])


def winning_segments(rows: DataFrame) -> DataFrame:
    """Per (run, iter), the latest restart segment that holds it."""
    return rows.groupBy("run", "iter").agg(F.max("segment").alias("segment"))


def drop_restart_overlap(rows: DataFrame, winners: DataFrame | None = None) -> DataFrame:
    """Where restart segments overlap in time, keep the later segment's rows.

    The decision is made on (run, iter, segment) - partial maxima keep that shuffle at
    one row per record - not by ranking cells, which would put a whole record in one task.
    """
    winners = settle(winning_segments(rows), "segments") if winners is None else winners
    return rows.join(winners, ["run", "iter", "segment"], "left_semi")


def forcing_arrays(forcing: DataFrame) -> DataFrame:
    """One fixed-length, sample-ordered array per run from (run, n, u) rows."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "u")))
    return forcing.groupBy("run").agg(F.transform(ordered, lambda s: s["u"]).alias("samples"))


def cyclic_forcing(times: DataFrame, samples: DataFrame, step: float = C.FORCING_STEP_SECONDS) -> DataFrame:
    """Forcing at ``time_s``, linear between neighbouring samples of an endlessly repeating cycle."""
    at = F.col("time_s") / step
    size = F.size("samples")
    here = F.pmod(F.floor(at).cast("int"), size)
    after = F.pmod(here + 1, size)
    part = at - F.floor(at)
    value = F.element_at("samples", here + 1) * (1 - part) + F.element_at("samples", after + 1) * part
    return times.join(settle(samples, "forcing"), "run").withColumn("u", value).drop("samples")
