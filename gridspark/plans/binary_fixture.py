"""Raw binary level files written from cell rows, as input for the ingest query."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from gridspark.sources.tables import with_tiles

FIELDS = ["UVEL", "THETA"]
TILE_COLUMNS = 1024


def _put(filesystem, path: str, data: bytes) -> None:
    """A whole file under its name at once, so that a second attempt of a task disturbs no reader."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(attempt) as out:
        out.write(data)
    filesystem.move(attempt, path)


def write_level_files(cells: DataFrame, path: str) -> None:
    """One header/array pair per (run, iteration, level, tile of columns), so groups stay bounded."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["j", "i"])
        first = pdf.iloc[0]
        nj, i0, i1, k = int(pdf["j"].max()) + 1, int(pdf["i"].min()) + 1, int(pdf["i"].max()) + 1, int(first["k"])
        filesystem, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        folder = f"{root}/results/{first['run']}/input"
        filesystem.create_dir(folder, recursive=True)
        name = f"{folder}/fields.{int(first['iter']):010d}.{k + 1:03d}.{int(first['tile_i']) + 1:03d}"
        header = (
            f" nDims = [ 3 ];\n dimList = [ {i1}, {i0}, {i1}, {nj}, 1, {nj}, 7, {k + 1}, {k + 1} ];\n"
            f" dataprec = [ 'float64' ];\n nrecords = [ {len(FIELDS)} ];\n nFlds = [ {len(FIELDS)} ];\n"
            " fldList = {\n" + " ".join(f"'{f:8s}'" for f in FIELDS) + "\n };\n"
        )
        data = np.concatenate([pdf[f].to_numpy("<f8") for f in FIELDS])
        _put(filesystem, f"{name}.data", data.tobytes())
        _put(filesystem, f"{name}.meta", header.encode())
        return pd.DataFrame({"cells": [len(pdf)]})

    rows = with_tiles(cells.select("run", "iter", "k", "j", "i", *FIELDS), i=TILE_COLUMNS)
    rows.groupBy("run", "iter", "k", "tile_i").applyInPandas(write, "cells bigint").write.format("noop").mode("overwrite").save()


def write_grid_files(metrics: DataFrame, files: dict[str, str], path: str) -> None:
    """One header/array pair per (run, metric, level, tile of columns) without iteration; missing axes have length 1."""
    missing = {a: F.lit(0) for a in "kji" if a not in metrics.columns}
    pairs = F.array(*[F.struct(F.lit(file).alias("file"), F.col(metric).alias("value")) for file, metric in files.items()])
    long = with_tiles(metrics.withColumns(missing), i=TILE_COLUMNS).select("run", "k", "j", "i", "tile_i", F.explode(pairs).alias("m")).select("run", "k", "j", "i", "tile_i", "m.*")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["j", "i"])
        first = pdf.iloc[0]
        nj, i0, i1, k = int(pdf["j"].max()) + 1, int(pdf["i"].min()) + 1, int(pdf["i"].max()) + 1, int(first["k"])
        filesystem, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        folder = f"{root}/results/{first['run']}/input"
        filesystem.create_dir(folder, recursive=True)
        name = f"{folder}/{first['file']}.{k + 1:03d}.{int(first['tile_i']) + 1:03d}"
        _put(filesystem, f"{name}.data", pdf["value"].to_numpy("<f8").tobytes())
        _put(filesystem, f"{name}.meta", (f" nDims = [ 3 ];\n dimList = [ {i1}, {i0}, {i1}, {nj}, 1, {nj}, 7, {k + 1}, {k + 1} ];\n dataprec = [ 'float64' ];\n nrecords = [ 1 ];\n").encode())
        return pd.DataFrame({"cells": [len(pdf)]})

    long.groupBy("run", "file", "k", "tile_i").applyInPandas(write, "cells bigint").write.format("noop").mode("overwrite").save()
