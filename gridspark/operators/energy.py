"""Energy budget: kinetic and potential energy, pressure work, body force, side fluxes.

Energies need no neighbours, so all of them come from one scan and one grouped
aggregation.  Pressure work and body force each need one neighbour and read only
the single record they are evaluated at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridspark import constants as C
from gridspark.functions.scalars import total
from gridspark.operators.metrics import present, with_horizontal, with_vertical
from gridspark.operators.reduce import demeaning, less_means, run_area, run_parameters
from gridspark.operators.select import domain_of
from gridspark.operators.stencil import (
    face_to_centre, interface_value, own_rows, pair_mean, pair_sums, tile_face_to_centre, vertical_divergence,
)
from gridspark.schema import LEVEL


def kinetic_energy(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    """KE per level: half squares of U and V weighted by their face wet fractions and centre area."""
    return _energies(cells, grid2d, ["KE"])


def potential_energy(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame, n0: float = 1e-3,
                     parameters: DataFrame | None = None) -> DataFrame:
    """PE per level from squared temperature departures (unscaled coefficient, see the budget)."""
    return _energies(with_vertical(cells, grid1d, "T0"), grid2d, ["PE"], n0, parameters)


def energy_profiles(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame, n0: float = 1e-3,
                    parameters: DataFrame | None = None) -> DataFrame:
    """KE and PE per level in a single pass."""
    return _energies(with_vertical(cells, grid1d, "T0"), grid2d, ["KE", "PE"], n0, parameters)


def _energies(cells: DataFrame, grid2d: DataFrame, wanted: list[str], n0: float = 1e-3,
              parameters: DataFrame | None = None) -> DataFrame:
    rows = with_horizontal(cells, grid2d, "rA")
    u, v, area = F.col("UVEL"), F.col("VVEL"), F.col("rA")
    sums = {}
    if "KE" in wanted:
        sums["KE"] = total(u * u * F.col("hFacW") * area) * 0.5 + total(v * v * F.col("hFacS") * area) * 0.5
    if "PE" in wanted:
        departure = F.col("THETA") - F.col("T0")
        sums["PE"] = total(departure * departure * F.col("hFacC") * area)
    summed = rows.groupBy(*LEVEL).agg(*[sums[name].alias(name) for name in wanted])
    if "PE" not in wanted:
        return summed
    scale = C.GRAVITY * C.PE_COEFFICIENT * C.PE_COEFFICIENT / 2.0 / (F.col("n0") * F.col("n0"))
    return run_parameters(summed, parameters, n0=n0).withColumn("PE", F.col("PE") * scale).select(*LEVEL, *wanted)


def pressure_work(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    """Pressure work through each interface; no value at the surface interface k = 0."""
    wanted = [*LEVEL, "j", "i", "PHIHYD", "WVEL", "hFacC", *present(cells, "rA")]
    columns = cells.select(*wanted).withColumn("_p", interface_value())
    rows = with_horizontal(columns, grid2d, "rA")
    summed = rows.groupBy(*LEVEL).agg(total(F.col("_p") * F.col("WVEL") * F.col("rA")).alias("_wp"))
    return summed.select(*LEVEL, F.when(F.col("k") > 0, F.col("_wp")).alias("WP"))


def pressure_work_divergence(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame) -> DataFrame:
    """Pressure work and its vertical divergence, 0 at the top and bottom level."""
    return vertical_divergence(with_vertical(pressure_work(cells, grid2d), grid1d, "drF")).drop("drF")


def body_force(cells: DataFrame, grid2d: DataFrame, f0: float = 1e-4, u0: float = 0.1,
               periodic: bool = True, parameters: DataFrame | None = None) -> DataFrame:
    """Work of the background pressure gradient on the cross flow, centred in ``j``.

    Cells of a tile table with halos (``sources.tables.save_by_tile``) are not shuffled; whether
    ``j`` is periodic is then the table's choice.
    """
    tiled = present(cells, "tile_j", "tile_i", "halo")
    wanted = [*LEVEL, "j", "i", "VVEL", "hFacC", *present(cells, "rA"), *tiled]
    if tiled:
        lines = own_rows(cells.select(*wanted).withColumn("_v", tile_face_to_centre("VVEL", "j")))
    else:
        lines = cells.select(*wanted).withColumn("_v", face_to_centre("VVEL", "j", periodic))
    rows = with_horizontal(lines, grid2d, "rA")
    summed = rows.groupBy(*LEVEL).agg(total(F.col("_v") * F.col("hFacC") * F.col("rA")).alias("_b"))
    summed = run_parameters(summed, parameters, f0=f0, u0=u0)
    return summed.select(*LEVEL, (F.col("_b") * F.col("f0") * F.col("u0")).alias("Bf"))


def dissipation_profile(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    """Volume-weighted turbulent dissipation per level (per unit thickness)."""
    rows = with_horizontal(cells, grid2d, "rA")
    return rows.groupBy(*LEVEL).agg(total(F.col("KLeps") * F.col("hFacC") * F.col("rA")).alias("eps"))


def energy_tendency(energies: DataFrame, first: int = 0, last: int = 2,
                    seconds: float = C.TENDENCY_SECONDS) -> DataFrame:
    """Change of KE and scaled PE between two records over a fixed number of seconds."""
    def at(rec, field):
        return F.sum(F.when(F.col("rec") == rec, F.col(field)))

    kinetic = at(last, "KE") - at(first, "KE")
    potential = (at(last, "PE") - at(first, "PE")) * C.PE_TENDENCY_SCALE
    return energies.where(F.col("rec").isin(first, last)).groupBy("run", "k").agg(
        ((kinetic + potential) / seconds).alias("dEdt")
    )


def energy_budget(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame, f0: float = 1e-4, u0: float = 0.1,
                  n0: float = 1e-3, records: tuple[int, int, int] = (0, 1, 2),
                  seconds: float = C.TENDENCY_SECONDS, periodic: bool = True,
                  demean_between: tuple[float, float] | None = None,
                  parameters: DataFrame | None = None,
                  columns: DataFrame | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """Budget profile per run: ``Bf, dWPdz, dEdt`` and what they leave over (``resid``).

    Tendency is taken between the first and last of the three records, the other
    terms at the middle one.  ``demean_between`` gives two depths; the mean flow between
    them (U's relative to ``u0``) is removed from each record first.  ``parameters`` gives ``f0``,
    ``u0`` and ``n0`` by run where they differ.  ``columns`` and ``tiles`` are the same cells
    bucketed by water column and by tile with halos: with them no neighbour is shuffled.
    """
    first, mid, last = records
    at_mid = {name: (cells if own is None else own).where(F.col("rec") == mid) for name, own in (("columns", columns), ("tiles", tiles))}
    if demean_between is not None:
        means = demeaning(cells.where(F.col("rec").isin(first, mid, last)), grid1d, *demean_between, background=u0, parameters=parameters)
        cells = less_means(cells.where(F.col("rec").isin(first, mid, last)), means)
        at_mid = {name: less_means(rows, means) for name, rows in at_mid.items()}
    energies = energy_profiles(cells.where(F.col("rec").isin(first, last)), grid2d, grid1d, n0, parameters)
    terms = [
        energy_tendency(energies, first, last, seconds),
        pressure_work_divergence(at_mid["columns"], grid2d, grid1d).select("run", "k", "dWPdz"),
        body_force(at_mid["tiles"], grid2d, f0, u0, periodic, parameters).select("run", "k", "Bf"),
    ]
    joined = reduce(lambda a, b: a.join(b, ["run", "k"]), terms)
    resid = -F.col("dEdt") + F.col("Bf") - F.col("dWPdz")
    rows = joined.select("run", "k", "Bf", "dWPdz", "dEdt", resid.alias("resid"))
    return with_vertical(rows, grid1d, "Z")


def budget_scalars(grid2d: DataFrame) -> DataFrame:
    return run_area(grid2d).select("run", "area")


# --- fluxes through the four sides ----------------------------------------

# side: (axis across, axis along, normal velocity, transverse velocity, its wet fraction, face length)
_SIDES = {
    "W": ("i", "j", "UVEL", "VVEL", "hFacS", "dyG"),
    "E": ("i", "j", "UVEL", "VVEL", "hFacS", "dyG"),
    "S": ("j", "i", "VVEL", "UVEL", "hFacW", "dxG"),
    "N": ("j", "i", "VVEL", "UVEL", "hFacW", "dxG"),
}


def _side_rows(cells: DataFrame, grid2d: DataFrame, sides: str) -> DataFrame:
    """Cells of the two-wide strips, once per side they belong to.

    Adds ``side``, the position ``along`` it with the last position ``end``, the normal
    velocity and face length where the cell holds the side's own face, and the
    transverse velocity with its wet fraction.  All sides come from one scan.
    """
    rows = cells.join(domain_of(grid2d), "run")
    sizes = {"i": F.col("ni"), "j": F.col("nj")}
    members, entries = [], []
    for side in sides:
        across, along, normal, transverse, wet, length = _SIDES[side]
        low = side in "WS"
        member = F.col(across) < 2 if low else F.col(across) >= sizes[across] - 2
        on_face = F.col(across) == (F.lit(0) if low else sizes[across] - 1)
        members.append(member)
        entries.append(F.when(member, F.struct(
            F.lit(side).alias("side"), F.col(along).alias("along"), (sizes[along] - 1).alias("end"),
            F.when(on_face, F.col(normal)).alias("vn"), F.when(on_face, F.col(length)).alias("length"),
            F.col(transverse).alias("vt"), F.col(wet).alias("wet"),
        )))
    strips = with_horizontal(rows.where(reduce(lambda x, y: x | y, members)), grid2d, "dxG", "dyG")
    exploded = strips.withColumn("_s", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    return exploded.select(*strips.columns, "_s.*")


def _through_faces(rows: DataFrame, density) -> DataFrame:
    """Sum over a side of density times normal velocity times face length."""
    flux = total(density * F.col("vn") * F.col("length"))
    return rows.groupBy(*LEVEL, "side").agg(flux.alias("flux"))


def _inside(margin: int):
    return F.col("along").between(margin, F.col("end") - margin)


def linear_side_flux(cells: DataFrame, grid2d: DataFrame, sides: str = "WESN", margin: int = 1) -> DataFrame:
    """Pressure averaged over the two cells at a side, times normal velocity and face length.

    ``margin`` positions at both ends of a side are left out.
    """
    rows = _side_rows(cells, grid2d, sides).where(_inside(margin))
    weighted = F.col("PHIHYD") * F.col("hFacC")
    mean = F.try_divide(total(weighted), F.sum("hFacC"))
    # West/east pairs need both cells; south/north sums skip a missing one.
    both = F.col("side").isin("S", "N") | (F.count(weighted) == F.count("*"))
    positions = rows.groupBy(*LEVEL, "side", "along").agg(
        F.when(both, mean).alias("p"), F.max("vn").alias("vn"), F.max("length").alias("length"))
    return _through_faces(positions, F.col("p"))


def nonlinear_side_flux(cells: DataFrame, grid2d: DataFrame, grid1d: DataFrame, sides: str = "WESN",
                        n0: float = 1e-3, margin: int = 1, parameters: DataFrame | None = None) -> DataFrame:
    """Energy density at a side (normal + transverse kinetic + potential) carried by the normal flow."""
    rows = with_vertical(_side_rows(cells, grid2d, sides), grid1d, "T0")
    departure = F.col("THETA") - F.col("T0")
    positions = rows.groupBy(*LEVEL, "side", "along").agg(
        *pair_sums("vt", "wet"),
        total(departure * departure * F.col("hFacC")).alias("_d"), F.sum("hFacC").alias("_wet"),
        F.max("end").alias("end"), F.max("vn").alias("vn"), F.max("length").alias("length"),
    )
    scale = 0.5 * C.GRAVITY * C.PE_COEFFICIENT * C.PE_COEFFICIENT / (F.col("n0") * F.col("n0"))
    positions = run_parameters(positions, parameters, n0=n0).withColumn("ape", F.try_divide(F.col("_d") * scale, F.col("_wet")))
    positions = positions.withColumn("transverse", pair_mean("along", [*LEVEL, "side"])).where(_inside(margin))
    return _through_faces(positions, 0.5 * F.col("vn") * F.col("vn") + F.col("transverse") + F.col("ape"))


def all_sides(one_side, sides: str = "WESN") -> DataFrame:
    """Union of a per-side flux over sides, with the ``side`` column telling them apart."""
    return reduce(lambda a, b: a.unionByName(b), [one_side(s) for s in sides])
