"""Bulk ingest of raw binary field output (``.meta`` header + ``.data`` array pairs).

Headers are read as a table and turned into work items, one per (file, level, band of
rows); executors then read just those byte ranges - all fields of a level together - and
emit Arrow batches of wide cell rows.  There is no pivot and no shuffle of field values,
and no task holds more than one band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.functions.names import run_of_path
from gridspark.schema import GRID1D, GRID2D, GRID3D, cells_schema
from gridspark.sources.shared import settle

# Names of the grid files and of the metrics they hold.
GRID_FILES = {
    "1d": {"RC": "Z", "DRF": "drF", "DRC": "drC"},
    "2d": {"XC": "XC", "YC": "YC", "XG": "XG", "YG": "YG", "RAC": "rA", "RAW": "rAw", "RAS": "rAs", "RAZ": "rAz",
           "DXG": "dxG", "DYG": "dyG", "DXC": "dxC", "DYC": "dyC", "Depth": "Depth"},
    "3d": {"hFacC": "hFacC", "hFacW": "hFacW", "hFacS": "hFacS"},
}
CELLS_PER_ITEM = 1_000_000
ITEMS_PER_READER = 16
_NUMPY_TYPES = {"float64": "f8", "float32": "f4", "real*8": "f8", "real*4": "f4"}
# numpy byte-order mark per accepted name of an order
_ORDERS = {"<": "<", ">": ">", "=": "=", "little": "<", "big": ">", "native": "="}


def _arrow_uri(uri: str) -> str:
    """Arrow knows S3 under one scheme name only."""
    return uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per header: run, stream, iteration, precision, fields and tile bounds."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("meta"), "value")

    def block(name):
        return F.regexp_extract("value", rf"(?s)\b{name}\s*=\s*[\[{{](.*?)[\]}}]", 1)

    numbers = F.transform(
        F.regexp_extract_all(block("dimList"), F.lit(r"(-?[0-9]+)"), F.lit(1)), lambda t: t.cast("int")
    )
    # Stream and iteration come from "<stream>[.<iteration>][.tile].meta"; grid files have no iteration.
    name = F.regexp_extract("meta", r"/([^/]+)\.meta$", 1)
    parsed = text.select(
        "meta", run_of_path("meta").alias("run"),
        F.regexp_extract(name, r"^(.*?)(?:\.[0-9]{10})?(?:\.[0-9]{3}){0,2}$", 1).alias("stream"),
        F.regexp_extract(name, r"\.([0-9]{10})", 1).try_cast("bigint").alias("iter"),
        F.trim(F.regexp_replace(block("dataprec"), "'", "")).alias("prec"), numbers.alias("dims"),
        F.transform(F.regexp_extract_all(block("fldList"), F.lit(r"'\s*(\w+)\s*'"), F.lit(1)),
                    lambda t: F.trim(t)).alias("fields"),
    )

    def dim(n, part, default):
        return F.coalesce(F.try_element_at("dims", F.lit(3 * n + part + 1)), F.lit(default))

    bounds = {f"{a}{tag}": dim(n, part, 1) for n, a in enumerate("ijk") for part, tag in ((1, "0"), (2, "1"))}
    return parsed.withColumns(bounds).drop("dims")


def work_items(header_rows: DataFrame, cells_per_item: int = CELLS_PER_ITEM) -> DataFrame:
    """Byte-range work: one row per file, level and band of at most ``cells_per_item`` cells."""
    width = F.col("i1") - F.col("i0") + 1
    rows = F.greatest(F.floor(F.lit(cells_per_item) / width), F.lit(1)).cast("int")
    levels = header_rows.withColumn("k", F.explode(F.sequence("k0", "k1")))
    return levels.withColumn("band", F.explode(F.sequence("j0", "j1", rows))).withColumn(
        "band_end", F.least(F.col("band") + rows - 1, F.col("j1"))
    )


def _read_items(fields: list[str], order: str):
    schema = pa.schema(
        [("run", pa.string()), ("stream", pa.string()), ("rec", pa.int32()), ("iter", pa.int64()),
         ("k", pa.int32()), ("j", pa.int32()), ("i", pa.int32())] + [(f, pa.float64()) for f in fields]
    )

    def read_one(item: dict) -> pa.RecordBatch:
        dtype = np.dtype(order + _NUMPY_TYPES[item["prec"]])
        ni, nj = item["i1"] - item["i0"] + 1, item["j1"] - item["j0"] + 1
        nk, rows = item["k1"] - item["k0"] + 1, item["band_end"] - item["band"] + 1
        filesystem, path = fs.FileSystem.from_uri(_arrow_uri(item["meta"][: -len(".meta")] + ".data"))
        values = {}
        with filesystem.open_input_file(path) as data:
            for n, name in enumerate(item["fields"]):
                if name not in fields:
                    continue
                first = ((n * nk + item["k"] - item["k0"]) * nj + item["band"] - item["j0"]) * ni
                raw = data.read_at(rows * ni * dtype.itemsize, first * dtype.itemsize)
                values[name] = np.frombuffer(raw, dtype).astype("f8")
        size = rows * ni
        j = np.repeat(np.arange(item["band"] - 1, item["band_end"], dtype="i4"), ni)
        i = np.tile(np.arange(item["i0"] - 1, item["i1"], dtype="i4"), rows)
        columns = [
            pa.repeat(pa.scalar(item["run"], pa.string()), size), pa.repeat(pa.scalar(item["stream"], pa.string()), size),
            pa.repeat(pa.scalar(item["rec"], pa.int32()), size), pa.repeat(pa.scalar(item["iter"], pa.int64()), size),
            pa.array(np.full(size, item["k"] - 1, "i4")),
            pa.array(j), pa.array(i),
        ]
        for name in fields:
            # from_pandas turns NaN into NULL, the package's missing value
            columns.append(pa.array(values[name], from_pandas=True) if name in values else pa.nulls(size, pa.float64()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.to_pylist():
                yield read_one(item)

    return read


def _read_wide(items: DataFrame, fields: list[str], endian: str, readers: int | None = None) -> DataFrame:
    # Item rows are tiny, so the reader count follows their number, not their bytes.
    parallel = items.sparkSession.sparkContext.defaultParallelism
    readers = readers or max(parallel, math.ceil(items.count() / ITEMS_PER_READER))
    wide = "run string, stream string, rec int, iter bigint, k int, j int, i int, " + ", ".join(f"{f} double" for f in fields)
    return items.repartition(readers).mapInArrow(_read_items(fields, _ORDERS[endian]), wide)


def read_grid(spark: SparkSession, paths: str | list[str], endian: str = "<",
              cells_per_item: int = CELLS_PER_ITEM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid metrics ``grid1d, grid2d, grid3d`` of every run from raw files, one metric each, without iteration.

    The files are read once into the shared folder.  Reference temperatures are no grid
    file; ``T0`` is left NULL.
    """
    names = {file: metric for group in GRID_FILES.values() for file, metric in group.items()}
    found = headers(spark, paths).where(F.col("stream").isin(*names)).withColumns({
        "fields": F.array("stream"), "rec": F.lit(0), "iter": F.lit(None).cast("bigint")})
    items = work_items(settle(found, "grid-headers"), cells_per_item).select(
        "meta", "run", "stream", "rec", "iter", "prec", "fields", "i0", "i1", "j0", "j1", "k0", "k1", "k", "band", "band_end"
    )
    rows = settle(_read_wide(items, list(names), endian), "grid-values")

    def metrics(group: str, keys: list[str], schema) -> DataFrame:
        own = rows.where(F.col("stream").isin(*GRID_FILES[group])).groupBy("run", *keys)
        out = own.agg(*[F.max(file).alias(metric) for file, metric in GRID_FILES[group].items()])
        missing = {f.name: F.lit(None).cast("double") for f in schema if f.name not in out.columns}
        return out.withColumns(missing).select(*schema.names)

    return metrics("1d", ["k"], GRID1D), metrics("2d", ["j", "i"], GRID2D), metrics("3d", ["k", "j", "i"], GRID3D)


def read_stream(spark: SparkSession, paths: str | list[str], fields: list[str], endian: str = "<",
                seconds_per_step: float = 1.0, iterations: list[int] | None = None,
                readers: int | None = None, cells_per_item: int = CELLS_PER_ITEM) -> DataFrame:
    """Cell rows of every run and iteration whose header matches ``paths``.

    Fields a file lacks are NULL.  ``rec`` is the dense position of the iteration in its
    run and stream.  ``iterations`` limits the read before any array is opened;
    ``[-1]`` keeps each run's last one.
    """
    from gridspark.operators.select import index_records

    found = settle(headers(spark, paths), "headers")
    seen = index_records(found.select("run", "stream", "iter").distinct()).withColumnRenamed("pos", "rec")
    if iterations == [-1]:
        seen = seen.where(F.col("rec") == F.col("n_rec") - 1)
    elif iterations is not None:
        seen = seen.where(F.col("iter").isin(iterations))
    records = settle(seen.select("run", "stream", "iter", "rec"), "iterations")
    items = work_items(found.join(records, ["run", "stream", "iter"]), cells_per_item).select(
        "meta", "run", "stream", "rec", "iter", "prec", "fields", "i0", "i1", "j0", "j1", "k0", "k1", "k", "band", "band_end"
    )
    rows = _read_wide(items, fields, endian, readers)
    rows = rows.withColumn("time_s", F.col("iter") * float(seconds_per_step))
    return rows.select(*[f.name for f in cells_schema(fields)])
