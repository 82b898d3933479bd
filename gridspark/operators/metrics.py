"""Joining cell rows with grid metrics, reference profiles and 2-D streams.

Metrics already present on the cell rows (materialised at ingest) are not joined
again, so a reduction over an enriched table scans a single input.  Metric tables
are plain Parquet: Spark broadcasts them when their true size is below its
threshold and shuffles on the join keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _attach(cells: DataFrame, metrics: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    missing = [n for n in names if n not in cells.columns]
    if not missing:
        return cells
    return cells.join(metrics.select(*keys, *missing), keys)


def with_horizontal(cells: DataFrame, grid2d: DataFrame, *names: str) -> DataFrame:
    """Attach 2-D metrics (areas, face lengths, depth) to rows keyed by (run, j, i)."""
    return _attach(cells, grid2d, ["run", "j", "i"], names)


def with_wet_fractions(cells: DataFrame, grid3d: DataFrame, *names: str) -> DataFrame:
    """Attach 3-D wet fractions to rows keyed by (run, k, j, i)."""
    return _attach(cells, grid3d, ["run", "k", "j", "i"], names or ("hFacC", "hFacW", "hFacS"))


def with_vertical(cells: DataFrame, grid1d: DataFrame, *names: str) -> DataFrame:
    """Attach level metrics (Z, drF, T0) to rows keyed by (run, k)."""
    return _attach(cells, grid1d, ["run", "k"], names)


def materialise(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame,
                horizontal: tuple[str, ...] = ("rA", "rAw", "rAs", "dxG", "dyG"),
                vertical: tuple[str, ...] = ("drF", "T0")) -> DataFrame:
    """Attach the metrics used by reductions once, before cells are written.

    They repeat, so Parquet stores them as short dictionaries; every later operator
    reads them with the fields instead of joining, whatever the grid size.
    """
    return with_vertical(with_horizontal(cells, grid2d, *horizontal), grid1d, *vertical)


def present(cells: DataFrame, *names: str) -> list[str]:
    """Those of the named columns that the rows already carry."""
    return [n for n in names if n in cells.columns]


def with_surface(cells: DataFrame, cells2d: DataFrame, *names: str) -> DataFrame:
    """Attach fields of the matching 2-D stream record to 3-D rows (a slice or a volume)."""
    return _attach(cells, cells2d, ["run", "rec", "j", "i"], names)


def with_source_run(runs: DataFrame, fields: DataFrame) -> DataFrame:
    """Give each run that names a ``source_run`` that run's per-cell fields.

    ``runs`` holds (run, source_run); ``fields`` holds per-cell values keyed by run.
    """
    source = fields.withColumnRenamed("run", "source_run")
    return runs.where(F.col("source_run").isNotNull()).select("run", "source_run").join(source, "source_run")
