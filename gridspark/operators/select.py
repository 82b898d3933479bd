"""Selection along grid, record and run axes.

Fixed indices become plain predicates that reach the Parquet scan.  Indices that
depend on the run (middle row, last record) join the small domain or record
table on the run instead of looping over runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from gridspark.functions.scalars import _col
from gridspark.sources.shared import settle


# --- run-level dimension tables -------------------------------------------

def records_of(cells: DataFrame) -> DataFrame:
    """Distinct ``(run, stream, rec, iter, time_s)`` rows with each record's dense position.

    ``pos`` counts from 0 and ``n_rec`` is the run's record count.  The window runs
    over one row per record, never over cells; the result is settled.
    """
    distinct = cells.groupBy("run", "stream", "rec", "iter", "time_s").agg(F.lit(1).alias("seen")).drop("seen")
    return settle(index_records(distinct), "records")


def index_records(records: DataFrame) -> DataFrame:
    """Dense record index per ``(run, stream)`` in iteration order."""
    by_iter = Window.partitionBy("run", "stream").orderBy("iter")
    everything = Window.partitionBy("run", "stream")
    return records.withColumn("pos", (F.dense_rank().over(by_iter) - 1).cast("int")).withColumn(
        "n_rec", (F.max("pos").over(everything) + 1).cast("int")
    )


def domain_of(grid2d: DataFrame) -> DataFrame:
    """Horizontal size ``nj, ni`` of each run (dense 0-based indices), small enough to join to cells."""
    sizes = grid2d.groupBy("run").agg(
        (F.max("j") + 1).cast("int").alias("nj"), (F.max("i") + 1).cast("int").alias("ni")
    )
    return settle(sizes, "domains")


# --- columns ---------------------------------------------------------------

def pick(df: DataFrame, keys: list[str], **renamed: str) -> DataFrame:
    """Keep ``keys`` and the given fields, e.g. ``pick(df, keys, DEPTH="Depth")``."""
    return df.select(*keys, *[F.col(src).alias(dst) for dst, src in renamed.items()])


def drop_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    """Drop columns whose name starts with any of the prefixes."""
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def mask_land(value, companion) -> Column:
    """``value`` where the companion field is not 0, else missing."""
    return F.when(_col(companion) != 0, _col(value))


def keep_positive(value) -> Column:
    value = _col(value)
    return F.when(value > 0, value)


def background_anomaly(value, background: float) -> Column:
    return _col(value) - F.lit(background)


# --- rows ------------------------------------------------------------------

def at(df: DataFrame, **index: int | list[int]) -> DataFrame:
    """Rows at fixed indices: ``at(cells, j=64)``, ``at(cells, j=20, i=[0, 1])``."""
    for axis, value in index.items():
        df = df.where(F.col(axis).isin(value) if isinstance(value, list) else F.col(axis) == value)
    return df


def between_exclusive(df: DataFrame, coordinate: str, low: float, high: float) -> DataFrame:
    """Rows whose coordinate lies strictly between the bounds."""
    return df.where((F.col(coordinate) > low) & (F.col(coordinate) < high))


def middle_row(cells: DataFrame, grid2d: DataFrame) -> DataFrame:
    """The row ``j = floor(nj / 2)`` of every run."""
    middle = domain_of(grid2d).select("run", F.floor(F.col("nj") / 2).cast("int").alias("j"))
    return cells.join(middle, ["run", "j"], "left_semi")


def positions_between(records: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """``run, stream, rec`` of a range of positions; negative ones count from the end, like a slice."""
    n = F.col("n_rec")

    def place(position):
        return F.lit(position) if position >= 0 else n + position

    keep = F.lit(True)
    lower = F.lit(0) if start is None else F.greatest(place(start), F.lit(0))
    keep = F.col("pos") >= lower
    if stop is not None:
        keep = keep & (F.col("pos") < place(stop))
    if step != 1:
        keep = keep & ((F.col("pos") - lower) % step == 0)
    return records.where(keep).select("run", "stream", "rec")


def records_between(cells: DataFrame, records: DataFrame, start: int | None = None,
                    stop: int | None = None, step: int = 1) -> DataFrame:
    """Records by position with negative positions counted from the end, like a slice."""
    return cells.join(positions_between(records, start, stop, step), ["run", "stream", "rec"], "left_semi")


def records_in_ranges(cells: DataFrame, records: DataFrame, name: str = "part", **ranges: tuple) -> DataFrame:
    """Rows of several named ``(start, stop)`` ranges, which may overlap, from a single scan."""
    parts = [positions_between(records, *r).withColumn(name, F.lit(n)) for n, r in ranges.items()]
    return cells.join(reduce(lambda a, b: a.unionByName(b), parts), ["run", "stream", "rec"])


def last_record(cells: DataFrame, records: DataFrame) -> DataFrame:
    return records_between(cells, records, start=-1)


def iterations(cells: DataFrame, records: DataFrame, wanted: str | int | list[int]) -> DataFrame:
    """Rows of listed iterations, of all (``"all"``), or of the last one (``-1``)."""
    if isinstance(wanted, str):
        if wanted != "all":
            raise ValueError("iterations are a list of numbers, -1 or 'all'")
        return cells
    if wanted == -1 or wanted == [-1]:
        return last_record(cells, records)
    listed = records.where(F.col("iter").isin(wanted)).select("run", "stream", "rec")
    return cells.join(listed, ["run", "stream", "rec"], "left_semi")


def edge_strip(cells: DataFrame, grid2d: DataFrame, side: str, width: int = 2) -> DataFrame:
    """First or last ``width`` rows/columns on side ``W``, ``E``, ``S`` or ``N``.

    Adds ``face``: the index of the side's own face (first or last index).
    """
    axis, low = _SIDES[side]
    if low:
        return cells.where(F.col(axis) < width).withColumn("face", F.lit(0))
    size = "ni" if axis == "i" else "nj"
    domain = domain_of(grid2d).select("run", (F.col(size) - 1).alias("face"))
    return cells.join(domain, "run").where(F.col(axis) > F.col("face") - width)


_SIDES = {"W": ("i", True), "E": ("i", False), "S": ("j", True), "N": ("j", False)}


def edge_strips(cells: DataFrame, grid2d: DataFrame, sides: str = "WESN", width: int = 2) -> DataFrame:
    """The strips of several sides with a ``side`` column, from one scan; a corner belongs to two."""
    rows = cells.join(domain_of(grid2d), "run")
    entries = []
    for side in sides:
        axis, low = _SIDES[side]
        last = F.col(f"n{axis}") - 1
        member = F.col(axis) < width if low else F.col(axis) > last - width
        entries.append(F.when(member, F.struct(F.lit(side).alias("side"), (F.lit(0) if low else last).cast("int").alias("face"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return rows.withColumn("_s", F.explode(found)).select(*cells.columns, "_s.*")


# --- shapes ----------------------------------------------------------------

def depth_time_section(profile: DataFrame, field: str, records: list[int] | None = None) -> DataFrame:
    """One row per (run, level), one column per record: the listed ones, or all that the profile has."""
    if records is None:
        records = sorted(r["rec"] for r in profile.select("rec").distinct().collect())
    return profile.groupBy("run", "k").pivot("rec", records).agg(F.first(field, ignorenulls=True))


def point_series(cells: DataFrame, j: int, i: int, *fields: str) -> DataFrame:
    """Vertical series of fields at one horizontal position, in depth order."""
    return at(cells, j=j, i=i).select("run", "rec", "k", *fields).orderBy("run", "rec", "k")


def bathymetry_section(grid2d: DataFrame, j: int) -> DataFrame:
    return at(grid2d, j=j).select("run", "i", "Depth")
