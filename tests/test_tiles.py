"""Lateral neighbours on tiles with halos: results of whole lines, no shuffled cells."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import energy, select, stencil
from gridspark.plans import QUERIES, load
from gridspark.sources import tables
from tests.grids import cube, frame, grid2d

SF = "/root/testdata/sf0.001"
SHAPE = (3, 7, 9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved(plan):
    """Shuffles that carry cells: their keys name a cell's place or tile."""
    return re.findall(r"Exchange hashpartitioning\([^)]*\b(?:i|j|tile_i|tile_j)#\d+[^)]*\)", plan)


def fields(seed):
    rng = np.random.default_rng(seed)
    v, h = rng.normal(size=SHAPE), rng.integers(0, 4, SHAPE) / 4.0
    v[rng.random(SHAPE) < 0.15] = np.nan
    return {"VVEL": v, "UVEL": rng.normal(size=SHAPE), "hFacC": h}


@pytest.fixture(params=[(3, 4), (7, 9), (1, 1), (64, 64)], scope="module")
def tiled(spark, request):
    cells = tables.clean_missing(frame(spark, fields(1)))
    name = f"tiles_{request.param[0]}_{request.param[1]}"
    domains = select.domain_of(grid2d(spark, *SHAPE[1:]))
    import tempfile

    tables.save_by_tile(cells, domains, name, 4, tempfile.mkdtemp(prefix="tiles-") + "/t", ("j",), j=request.param[0], i=request.param[1])
    yield spark.table(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_own_rows_are_the_cells(tiled):
    assert tiled.where("not halo").count() == np.prod(SHAPE) == stencil.own_rows(tiled).count()
    assert stencil.own_rows(tiled).select("k", "j", "i").distinct().count() == np.prod(SHAPE)


def test_face_to_centre(tiled):
    x = fields(1)
    rows = tiled.withColumn("v", stencil.tile_face_to_centre("VVEL", "j")).withColumn("u", stencil.tile_face_to_centre("UVEL", "i"))
    rows = stencil.own_rows(rows)
    np.testing.assert_allclose(cube(rows, "v", SHAPE), 0.5 * (x["VVEL"] + np.roll(x["VVEL"], 1, axis=1)))
    open_ = np.full(SHAPE, np.nan)
    open_[:, :, 1:] = 0.5 * (x["UVEL"][:, :, 1:] + x["UVEL"][:, :, :-1])
    np.testing.assert_allclose(cube(rows, "u", SHAPE), open_)
    assert moved(plan_of(rows)) == []


def test_corner_average(tiled):
    x = fields(1)
    w = np.where(np.isnan(x["VVEL"]), 0, x["hFacC"])
    v = np.nan_to_num(x["VVEL"])
    wide = np.pad(np.stack([v * w, w]), ((0, 0), (0, 0), (0, 0), (1, 0)))
    four = sum(np.roll(wide, dj, axis=2)[..., di : di + SHAPE[2]] for dj in (0, 1) for di in (0, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        want = four[0] / four[1]
    rows = stencil.corner_average(tiled, "VVEL", "hFacC")
    np.testing.assert_allclose(cube(rows, "corner", SHAPE), want)
    assert moved(plan_of(rows)) == []


def test_body_force_on_tiles(spark, tiled):
    cells = tables.clean_missing(frame(spark, fields(1)))
    grid = grid2d(spark, *SHAPE[1:])
    want = {r["k"]: r["Bf"] for r in energy.body_force(cells, grid).collect()}
    got = {r["k"]: r["Bf"] for r in energy.body_force(tiled, grid).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_halos_hold_edges_only(spark):
    """With tiles of 8 x 8 in 64 x 64 cells, copies are a third; no row is copied twice into one tile."""
    cells = frame(spark, {"UVEL": np.ones((1, 64, 64))})
    rows = tables.with_halos(cells, select.domain_of(grid2d(spark, 64, 64)), j=8, i=8)
    inner = 64 * 64
    assert rows.where("not halo").count() == inner and rows.count() == (64 + 2 * 7) ** 2
    assert rows.groupBy("tile_j", "tile_i", "j", "i").count().where(F.col("count") > 1).count() == 0


@pytest.mark.parametrize("name", ["a07_body_force", "a12_budget_residual", "w04_face_to_centre", "w08_corner_average", "x01_tidal_average"])
def test_registered_plans_move_no_cells(spark, name):
    load()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert moved(plan_of(QUERIES[name](spark, SF))) == []
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
