"""Parquet layout of cell tables and reduced results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.functions.scalars import missing


def write_cells(cells: DataFrame, path: str, rows_per_file: int = 4_000_000, partitions: int | None = None) -> None:
    """Write cells partitioned by run, stream and record, range-ordered so files prune by level.

    Filters on records, and joins with a few chosen records (by dynamic pruning), read only
    those.  Range partitioning splits a run that holds most rows over many tasks.
    """
    by = [c for c in ("run", "stream", "rec", "k", "j") if c in cells.columns]
    keys = [c for c in ("run", "stream", "rec") if c in cells.columns]
    ranged = cells.repartitionByRange(partitions, *by) if partitions else cells.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions(*by, *[c for c in ("i",) if c in cells.columns])
    ordered.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path)


def save_by_column(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Save cells or 2-D metrics bucketed by water column ``(run, j, i)``.

    Vertical neighbours, column means, layer binning, per-cell time means and joins with
    equally bucketed 2-D metrics then run without shuffling the cells.  A dominant run
    is still spread over all buckets, since a bucket key is a single column of it.
    """
    order = [c for c in ("run", "j", "i", "rec", "k") if c in df.columns]
    writer = df.write.mode("errorifexists").format("parquet").bucketBy(buckets, "run", "j", "i").sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_cells(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_runs(spark: SparkSession, path: str, runs: list[str], schema=None) -> DataFrame:
    """Reduced results of listed runs, read together through partition pruning."""
    return read_cells(spark, path, schema).where(F.col("run").isin(runs))


def union_streams(frames: list[DataFrame]) -> DataFrame:
    """Streams with different fields in one table; absent fields are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def replace_runs(result: DataFrame, path: str) -> None:
    """Write a reduced result; only the runs present in it are replaced."""
    # Spread one run over its records so a dominant run is not a single writer task.
    by = [c for c in ("run", "rec", "k") if c in result.columns]
    result.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_budget(profile: DataFrame, scalars: DataFrame, path: str) -> None:
    """Budget profile and the run scalars side by side."""
    replace_runs(profile, f"{path}/profile")
    replace_runs(scalars, f"{path}/scalars")


def with_processing_note(c: Column, name: str, note: str) -> Column:
    """Column carrying a provenance note that Parquet keeps."""
    return c.alias(name, metadata={"processing": note})


def clean_missing(df: DataFrame, *names: str) -> DataFrame:
    """NaN to NULL in the named (by default all floating) columns."""
    names = names or tuple(n for n, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({n: missing(n) for n in names})


def with_tiles(cells: DataFrame, **sizes: int) -> DataFrame:
    """Tile numbers along axes: ``with_tiles(cells, i=30)`` adds ``tile_i = floor(i / 30)``."""
    return cells.withColumns({f"tile_{a}": F.floor(F.col(a) / n).cast("int") for a, n in sizes.items()})


def with_halos(cells: DataFrame, domains: DataFrame, periodic: tuple[str, ...] = (), **sizes: int) -> DataFrame:
    """Cells by tile, with copies of the rows next to each tile's edges: ``with_halos(cells, domains, j=64, i=64)``.

    Adds ``tile_j``, ``tile_i`` and ``halo``.  A copy keeps its values and, on ``periodic`` axes, gets the
    index that continues its new tile: row ``n - 1`` becomes ``-1`` and row 0 becomes ``n``.  Only edge rows are
    copied, so the table grows by the share of edges.  ``domains`` has ``run, nj, ni`` (``select.domain_of``).
    """
    rows = cells.join(domains.select("run", *[f"n{a}" for a in sizes]), "run")
    for a, size in sizes.items():
        p, n = F.col(a), F.col(f"n{a}")

        def place(tile, at, copied):
            return F.struct(tile.cast("int").alias("tile"), at.cast("int").alias("at"), F.lit(copied).alias("halo"))

        tile = F.floor(p / size)
        wraps = F.lit(a in periodic)
        after = F.when(p == n - 1, F.when(wraps, place(F.lit(0), F.lit(-1), True))).when((p + 1) % size == 0, place(tile + 1, p, True))
        before = F.when(p == 0, F.when(wraps, place(F.floor((n - 1) / size), n, True))).when(p % size == 0, place(tile - 1, p, True))
        rows = rows.withColumn(f"_{a}", F.explode(F.filter(F.array(place(tile, p, False), after, before), lambda x: x.isNotNull())))
    rows = rows.withColumn("halo", reduce(lambda x, y: x | y, [F.col(f"_{a}.halo") for a in sizes]))
    rows = rows.withColumns({f"tile_{a}": F.col(f"_{a}.tile") for a in sizes}).withColumns({a: F.col(f"_{a}.at") for a in sizes})
    return rows.drop(*[f"_{a}" for a in sizes], *[f"n{a}" for a in sizes])


def save_by_tile(cells: DataFrame, domains: DataFrame, table: str, buckets: int, path: str | None = None,
                 periodic: tuple[str, ...] = (), **sizes: int) -> None:
    """Save cells bucketed by horizontal tile, halos included.

    Lateral neighbours, in either direction, are then found inside a bucket: no cell is
    shuffled at run time (``stencil.tile_line``).  A dominant run is spread over its tiles.
    """
    rows = with_halos(cells, domains, periodic, **sizes)
    by = ["run", *[f"tile_{a}" for a in sizes]]
    order = [*by, *[c for c in ("rec", "k", "j", "i") if c in rows.columns]]
    writer = rows.write.mode("errorifexists").format("parquet").bucketBy(buckets, *by).sortBy(*order)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def repartition_tiles(cells: DataFrame, partitions: int | None = None, **sizes: int) -> DataFrame:
    """Re-chunk: rows of one run, record, level and tile land in the same partition."""
    tiled = with_tiles(cells, **sizes)
    by = [c for c in ("run", "rec", "k") if c in cells.columns] + [f"tile_{a}" for a in sizes]
    return tiled.repartition(partitions, *by) if partitions else tiled.repartition(*by)


def random_array(spark: SparkSession, nx: int, ny: int, seed: int = 0) -> DataFrame:
    """Normally distributed test array as (x, y, value) rows, generated in parallel."""
    ids = spark.range(nx * ny)
    return ids.select(
        F.floor(F.col("id") / ny).cast("int").alias("x"), (F.col("id") % ny).cast("int").alias("y"),
        F.randn(seed).alias("value"),
    )
