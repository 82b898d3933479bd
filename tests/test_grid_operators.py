"""Operators against NumPy on small grids and fields with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import energy, flux, layers, reduce, select, spectra, stats, stencil, timewin
from gridspark.sources.tables import clean_missing
from tests.grids import SHAPE, cube, frame, grid1d, grid2d, profile

RNG = np.random.default_rng(5)


def random_fields(shape=SHAPE, dry=0.3):
    wet = (RNG.random(shape) > dry) * RNG.choice([0.25, 0.5, 1.0], shape)
    names = ["UVEL", "VVEL", "WVEL", "THETA", "PHIHYD", "KLeps"]
    fields = {n: RNG.normal(size=shape) for n in names}
    fields["THETA"] = np.where(wet > 0, fields["THETA"] + 20, 0.0)
    return {**fields, "hFacC": wet, "hFacW": wet, "hFacS": wet}


def close(a, b):
    np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-10, atol=1e-12)


def test_uniform_flow_energy(spark):
    u = np.full(SHAPE, 0.2)
    one = np.ones(SHAPE)
    cells = frame(spark, {"UVEL": u, "VVEL": 0 * u, "hFacW": one, "hFacS": one})
    out = energy.kinetic_energy(cells, grid2d(spark, 4, 6))
    close(profile(out, "KE"), [0.5 * 0.04 * 24 * 10.0] * 5)


def test_work_and_mean_flow(spark):
    f = random_fields()
    cells, grid = frame(spark, f), grid2d(spark, 4, 6)
    close(profile(reduce.work_profile(cells, grid), "work"), (f["VVEL"] * f["hFacS"] * 10).sum((1, 2)) * 1.4e-4 * 0.1)
    mean = reduce.mean_flow_profile(cells, grid)
    close(profile(mean, "mean_u"), (f["UVEL"] * f["hFacW"] * 10).sum((1, 2)) / 240)


def test_interface_value_linear_pressure(spark):
    p = np.broadcast_to(np.arange(5.0)[:, None, None], SHAPE)
    cells = frame(spark, {"PHIHYD": p, "hFacC": np.ones(SHAPE)})
    got = cube(cells.select("k", "j", "i", stencil.interface_value().alias("p")), "p", SHAPE)
    assert np.isnan(got[0]).all()
    close(got[1:], p[1:] - 0.5)


def test_pressure_work_with_dry_cells(spark):
    f = random_fields(dry=0.5)
    h, p, w = f["hFacC"], f["PHIHYD"], f["WVEL"]
    with np.errstate(invalid="ignore"):
        pp = (p[1:] * h[1:] + p[:-1] * h[:-1]) / (h[1:] + h[:-1])
    wp = np.nansum(pp * w[1:] * 10, axis=(1, 2))
    dz = np.array([10.0, 11.0, 12.0, 13.0, 14.0])
    out = energy.pressure_work_divergence(frame(spark, f), grid2d(spark, 4, 6), grid1d(spark, 5, dz=dz))
    assert profile(out, "WP")[0] is None
    close(profile(out, "WP")[1:], wp)
    close(profile(out, "dWPdz"), np.hstack((0, -np.diff(wp) / dz[1:-1], 0)))


@pytest.mark.parametrize("nj", [1, 2, 4])
def test_body_force_wraps(spark, nj):
    shape = (3, nj, 5)
    f = random_fields(shape)
    v = 0.5 * (f["VVEL"] + np.roll(f["VVEL"], 1, axis=1))
    want = (v * f["hFacC"] * 10).sum((1, 2)) * 1e-4 * 0.1
    close(profile(energy.body_force(frame(spark, f), grid2d(spark, nj, 5)), "Bf"), want)


def test_missing_neighbour_is_not_shifted(spark):
    cells = frame(spark, {"PHIHYD": np.ones(SHAPE), "hFacC": np.ones(SHAPE)}).where("k <> 2")
    got = cube(cells.select("k", "j", "i", stencil.interface_value().alias("p")), "p", SHAPE)
    assert np.isnan(got[3]).all() and not np.isnan(got[1]).any() and not np.isnan(got[4]).any()


def test_all_land_and_single_level(spark):
    shape = (1, 2, 2)
    f = {n: np.zeros(shape) for n in ["UVEL", "VVEL", "WVEL", "THETA", "PHIHYD", "hFacC", "hFacW", "hFacS"]}
    cells, grid, level = frame(spark, f), grid2d(spark, 2, 2), grid1d(spark, 1)
    row = energy.pressure_work_divergence(cells, grid, level).collect()[0]
    assert row["WP"] is None and row["dWPdz"] == 0.0
    assert profile(energy.potential_energy(cells, grid, level), "PE") == [0.0]
    s = stats.field_statistics(cells, grid, level).where("field = 'THETA'").collect()[0]
    assert s["mean"] is None and s["min"] is None
    assert layers.layer_transport(cells, grid1d(spark, 1), bins=4).count() == 0


def test_nan_becomes_missing_and_is_skipped(spark):
    u = np.ones(SHAPE)
    u[0, 0, 0] = np.nan
    u[1] = np.nan
    cells = clean_missing(frame(spark, {"UVEL": u, "VVEL": u, "hFacW": np.ones(SHAPE), "hFacS": np.ones(SHAPE)}))
    got = profile(energy.kinetic_energy(cells, grid2d(spark, 4, 6)), "KE")
    assert got[0] == 23 * 10.0 and got[1] == 0.0


def test_budget_closes_on_known_fields(spark):
    """Steady uniform flow: no tendency, no pressure work, body force alone is the residual."""
    one = np.ones(SHAPE)
    f = {"UVEL": 0 * one, "VVEL": 0.5 * one, "WVEL": 0 * one, "THETA": 20 * one, "PHIHYD": 0 * one,
         "hFacC": one, "hFacW": one, "hFacS": one}
    cells = frame(spark, f, rec=0).unionByName(frame(spark, f, rec=1)).unionByName(frame(spark, f, rec=2))
    out = energy.energy_budget(cells, grid2d(spark, 4, 6), grid1d(spark, 5))
    close(profile(out, "dEdt"), [0] * 5)
    close(profile(out, "resid"), profile(out, "Bf"))
    close(profile(out, "Bf"), [0.5 * 24 * 10 * 1e-4 * 0.1] * 5)


def test_budget_with_mean_flow_removed(spark):
    """A uniform cross flow has no body force once its mean is removed."""
    one = np.ones(SHAPE)
    f = {"UVEL": 0.3 * one, "VVEL": 0.5 * one, "WVEL": 0 * one, "THETA": 20 * one, "PHIHYD": 0 * one,
         "hFacC": one, "hFacW": one, "hFacS": one}
    cells = frame(spark, f, rec=0).unionByName(frame(spark, f, rec=1)).unionByName(frame(spark, f, rec=2))
    out = energy.energy_budget(cells, grid2d(spark, 4, 6), grid1d(spark, 5), demean_between=(-2000.0, -10.0))
    close(profile(out, "Bf"), [0] * 5)


def test_side_fluxes(spark):
    f = random_fields((3, 6, 7), dry=0.2)
    nk, nj, ni = 3, 6, 7
    cells, grid, level = frame(spark, f), grid2d(spark, nj, ni), grid1d(spark, nk)
    h, p, u, v = f["hFacC"], f["PHIHYD"], f["UVEL"], f["VVEL"]
    linear = {s: profile(energy.linear_side_flux(cells, grid, s), "flux") for s in "WN"}
    inner_j, inner_i = slice(1, nj - 1), slice(1, ni - 1)
    with np.errstate(invalid="ignore"):
        west = (p[:, :, 0] * h[:, :, 0] + p[:, :, 1] * h[:, :, 1]) / (h[:, :, 0] + h[:, :, 1])
        close(linear["W"], np.nansum((west * u[:, :, 0] * 5)[:, inner_j], axis=1))
        north = (p[:, -2:] * h[:, -2:]).sum(1) / h[:, -2:].sum(1)
        close(linear["N"], np.nansum((north * v[:, -1] * 2)[:, inner_i], axis=1))
        # non-linear east side
        n0, faces = 1e-3, slice(1, nj - 1)
        a, b = slice(1, nj - 1), slice(2, nj)
        vt, hs = v[:, :, -2:], f["hFacS"][:, :, -2:]
        num = (0.5 * vt ** 2 * hs).sum(2)
        den = hs.sum(2)
        cross = (num[:, a] + num[:, b]) / (den[:, a] + den[:, b])
        ape = (0.5 * 9.8 * (4e-4 * (f["THETA"][:, :, -2:] - 20)) ** 2 / n0 ** 2 * h[:, :, -2:]).sum(2) / h[:, :, -2:].sum(2)
        un = u[:, :, -1]
        want = np.nansum((0.5 * un[:, faces] ** 2 + cross + ape[:, faces]) * un[:, faces] * 5, axis=1)
    close(profile(energy.nonlinear_side_flux(cells, grid, level, "E"), "flux"), want)


def test_flux_decomposition_parts_add_up(spark):
    f = random_fields((6, 1, 5), dry=0.2)
    cells = frame(spark, f)
    eta = RNG.normal(size=(1, 5))
    import pandas as pd

    flat = spark.createDataFrame(pd.DataFrame({"run": "r", "rec": np.int32(0), "j": np.int32(0), "i": np.arange(5, dtype="i4"), "ETAN": eta[0]}))
    out = flux.flux_decomposition(cells, flat).orderBy("k").collect()
    wet = f["THETA"] != 0
    both = np.where(wet, f["UVEL"] * f["PHIHYD"], np.nan)
    close([sum(r[p] for p in flux.PARTS) for r in out], np.nanmean(both, axis=(1, 2)))


def test_demean_and_last_records(spark):
    f = random_fields()
    cells = frame(spark, f).unionByName(frame(spark, {k: v * 2 for k, v in f.items()}, rec=1))
    level = grid1d(spark, 5)
    out = reduce.demean(cells, level, -36.0, -10.0, 0.1)
    u = cube(out.where("rec = 1"), "UVEL", SHAPE)
    close(u, 2 * f["UVEL"] - ((2 * f["UVEL"][1:4]).mean() - 0.1))
    records = select.records_of(cells)
    mean = reduce.mean_of_last(cells, records, ["THETA"], 5)
    close(cube(mean, "THETA", SHAPE), f["THETA"] * 1.5)
    assert select.last_record(cells, records).select("rec").distinct().collect()[0][0] == 1


@pytest.mark.parametrize("width,start,stop", [(10, -5, 4), (15, -7, 7)])
def test_moving_average_pads_with_zeros(spark, width, start, stop):
    d = RNG.random(40)
    want = np.convolve(d, np.ones(width) / width, "same")
    line = grid2d(spark, 1, 40, Depth=d)
    got = line.select("i", stencil.moving_average("Depth", "i", ["run", "j"], width).alias("m"))
    close(profile(got, "m", "i"), want)


def test_layers_conserve_transport(spark):
    f = random_fields()
    t0 = np.linspace(24, 16, 5)
    cells, level = frame(spark, f), grid1d(spark, 5, t0=t0)
    whole = (f["UVEL"] * f["hFacW"] * 10).sum()
    for out in (layers.layer_transport(cells, level, bins=7), layers.layer_transport(cells, level, bins=7, parts=10),
                layers.layer_transport_at(cells, level, [0.0, 18.0, 19.5, 20.0, 26.0])):
        sums = out.agg(F.sum("uh"), F.sum("h"), F.min("layer"), F.max("layer")).collect()[0]
        close([sums[0], sums[1]], [whole, (f["hFacW"] * 10).sum()])
        assert sums[2] >= 0 and sums[3] <= 6


def test_top_edge_falls_in_last_layer(spark):
    cells = frame(spark, {"THETA": np.array([[[10.0, 20.0, 25.0, 5.0]]]), "UVEL": np.ones((1, 1, 4)), "hFacC": np.ones((1, 1, 4)),
                          "hFacW": np.ones((1, 1, 4))})
    level = grid1d(spark, 1).withColumn("T0", F.lit(10.0)).unionByName(grid1d(spark, 1).withColumn("T0", F.lit(20.0)).withColumn("k", F.lit(1)))
    got = {r["i"]: r["layer"] for r in layers.layer_transport(cells, level, bins=10).collect()}
    assert got == {0: 0, 1: 9, 2: 9, 3: 0}


def test_vorticity_of_solid_rotation(spark):
    k, j, i = np.indices((1, 4, 5))
    cells = frame(spark, {"UVEL": -1.0 * j, "VVEL": 1.0 * i})
    out = stats.relative_vorticity(cells, grid2d(spark, 4, 5, dxC=1.0, dyC=1.0, rAz=1.0))  # face lengths play no part
    assert out.count() == 12 and {r["vort"] for r in out.collect()} == {2.0}


def test_statistics_match_numpy(spark):
    f = random_fields()
    out = stats.field_statistics(frame(spark, f), grid2d(spark, 4, 6), grid1d(spark, 5)).where("field = 'UVEL'").collect()[0]
    w = f["hFacW"]
    mean = (f["UVEL"] * w).sum() / w.sum()
    close([out["mean"], out["sd"], out["min"]],
          [mean, np.sqrt((f["UVEL"] ** 2 * w).sum() / w.sum() - mean ** 2), f["UVEL"][w > 0].min()])


def test_spectrum_segments(spark):
    """A row longer than the segment: two windows, transform padded to the row length."""
    n, width = 80, 32
    d = RNG.random(n)
    win = np.hanning(width + 1)[:-1]
    power = 0
    for s in range(n // width):
        x = d[s * width:(s + 1) * width]
        power = power + np.abs(np.fft.rfft((x - x.mean()) * win, n)) ** 2 / (win ** 2).sum()
    power = power / (n // width)
    power[1:-1] *= 2
    got = spectra.mean_spectrum(grid2d(spark, 1, n, Depth=d), segment=width).orderBy("m").collect()
    close([r["power"] for r in got], power)
    close([r["freq"] for r in got], np.fft.rfftfreq(n))


def test_row_order_does_not_matter(spark):
    f = random_fields()
    cells = frame(spark, f)
    for fn in (lambda c: energy.body_force(c, grid2d(spark, 4, 6)), lambda c: energy.pressure_work(c, grid2d(spark, 4, 6))):
        column = fn(cells).columns[-1]
        close(profile(fn(cells), column)[1:], profile(fn(cells.orderBy(F.rand(3))), column)[1:])


def test_restart_overlap_keeps_later_segment(spark):
    rows = spark.createDataFrame([("r", 10, 0, 1.0), ("r", 20, 0, 2.0), ("r", 20, 1, 3.0), ("r", 30, 1, 4.0)], "run string, iter long, segment int, x double")
    assert sorted(r["x"] for r in timewin.drop_restart_overlap(rows).collect()) == [1.0, 3.0, 4.0]


def test_cyclic_forcing_wraps(spark):
    forcing = spark.createDataFrame([("r", n, float(n)) for n in range(36)], "run string, n int, u double")
    times = spark.createDataFrame([("r", 0.0), ("r", 620.0), ("r", 35 * 1240.0 + 620.0), ("r", 44640.0 * 3 + 1240.0)], "run string, time_s double")
    out = timewin.cyclic_forcing(times, timewin.forcing_arrays(forcing))
    assert sorted(r["u"] for r in out.collect()) == [0.0, 0.5, 1.0, 17.5]


def test_statistics_use_centre_distances(spark):
    """Stretched spacing: CFL numbers and W's weight follow centre distances, not face lengths."""
    w = np.zeros((2, 1, 2))
    w[0], w[1] = 1.0, 3.0
    ones = np.ones((2, 1, 2))
    cells = frame(spark, {"UVEL": ones, "VVEL": ones, "WVEL": w, "THETA": ones, "hFacC": ones * 0.5, "hFacW": ones, "hFacS": ones})
    flat = grid2d(spark, 1, 2, dxC=4.0, dxG=1.0, dyC=8.0, dyG=1.0)
    deep = spark.createDataFrame([("r", 0, -1.0, 2.0, 1.0, 0.0), ("r", 1, -4.0, 6.0, 4.0, 0.0)], "run string, k int, Z double, drF double, drC double, T0 double")
    cfl = stats.advective_cfl(cells, flat, deep, 2.0).first()
    assert (cfl["cfl_u"], cfl["cfl_v"], cfl["cfl_w"], cfl["cfl_w_hf"]) == (0.5, 0.25, 2.0, 2.0)
    means = {r["field"]: r["mean"] for r in stats.field_statistics(cells, flat, deep).collect()}
    assert means["WVEL"] == (1.0 * 1 + 3.0 * 4) / 5 and means["UVEL"] == 1.0


def test_parameters_by_run(spark):
    """Runs with other parameters get their own work, others the defaults."""
    cells = frame(spark, {"VVEL": np.ones((2, 3, 4)), "hFacS": np.ones((2, 3, 4))}, run="a").unionByName(
        frame(spark, {"VVEL": np.ones((2, 3, 4)), "hFacS": np.ones((2, 3, 4))}, run="b"))
    flat = grid2d(spark, 3, 4, run="a").unionByName(grid2d(spark, 3, 4, run="b"))
    own = spark.createDataFrame([("a", 2.0)], "run string, u0 double")
    got = {r["run"]: r["work"] for r in reduce.work_profile(cells, flat, f0=1.0, u0=0.5, parameters=own).where("k = 0").collect()}
    assert got == {"a": 240.0, "b": 60.0}
