"""Queries over sources, sinks and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import catalogue, reduce, select
from gridspark.plans.aggregates import _BUDGET, _BUDGET_TABLES, _TERMS, _budget
from gridspark.plans.binary_fixture import write_grid_files, write_level_files
from gridspark.plans.registry import query, rounded
from gridspark.sources import binary, fields, tables as store, text
from gridspark.sources.shared import fresh_path

# --- sources and sinks -----------------------------------------------------


@query("s01_binary_ingest", uses="cells", sql="""
SELECT run, rec, k, CAST(COUNT(*) AS BIGINT) AS n, SUM(UVEL) AS sum_u, SUM(THETA) AS sum_t, SUM(j*1000 + i) AS places
FROM (SELECT run, rec, k, UVEL, THETA, CAST(j AS DOUBLE) AS j, i FROM cells) GROUP BY ALL""")
def binary_ingest(t):
    """Raw level files of all runs read back as cell rows."""
    folder = t._once("binary", lambda: t.cells, write_level_files)
    rows = binary.read_stream(t.spark, f"{folder}/results/*/input/fields.*.meta", ["UVEL", "THETA"], seconds_per_step=6.2)
    return rows.groupBy("run", "rec", "k").agg(
        F.count("*").alias("n"), F.sum("UVEL").alias("sum_u"), F.sum("THETA").alias("sum_t"),
        F.sum(F.col("j") * F.lit(1000.0) + F.col("i")).alias("places"))


@query("s01_pushed_ingest", uses="cells", sql="""
SELECT run, rec, k, j, i, iter, UVEL FROM cells WHERE run <> 'N' AND rec IN (1, 3) AND k < 5 AND j >= 2 AND j <= 4""")
def pushed_ingest(t):
    """The raw files as a data source: filters by record and place decide which bytes are read."""
    folder = t._once("binary", lambda: t.cells, write_level_files)
    rows = fields.read_fields(t.spark, f"{folder}/results", ["UVEL"])
    rows = rows.where((F.col("run") != "N") & F.col("rec").isin(1, 3) & (F.col("k") < 5) & F.col("j").between(2, 4))
    return rows.select("run", "rec", "k", "j", "i", "iter", "UVEL")


def _grid_from_files(t):
    def write(_, path):
        for grid, group in ((t.grid1d, "1d"), (t.grid2d, "2d"), (t.grid3d, "3d")):
            write_grid_files(grid, binary.GRID_FILES[group], path)

    folder = t._once("grid_files", lambda: None, write)
    return binary.read_grid(t.spark, f"{folder}/results/*/input/*.meta")


@query("s01_grid_levels_ingest", uses="grid1d", sql="SELECT run, k, Z, drF, drC FROM grid1d")
def grid_levels_ingest(t):
    """Vertical metrics from raw grid files."""
    return _grid_from_files(t)[0].drop("T0")


@query("s01_grid_columns_ingest", uses="grid2d", sql="SELECT * FROM grid2d")
def grid_columns_ingest(t):
    """Horizontal metrics from raw grid files."""
    return _grid_from_files(t)[1]


@query("s01_grid_cells_ingest", uses="grid3d", sql="SELECT * FROM grid3d")
def grid_cells_ingest(t):
    """Wet fractions from raw grid files."""
    return _grid_from_files(t)[2]


@query("s02_last_iteration_ingest", uses="cells", sql="""
SELECT run, k, j, i, UVEL, iter FROM cells WHERE rec = 6""")
def last_iteration_ingest(t):
    """Only the last iteration's files are opened."""
    folder = t._once("binary", lambda: t.cells, write_level_files)
    rows = binary.read_stream(t.spark, f"{folder}/results/*/input/fields.*.meta", ["UVEL"], iterations=[-1])
    return rows.select("run", "k", "j", "i", "UVEL", "iter")


@query("s03_tiles", uses="cells", sql="""
SELECT run, rec, CAST(i // 30 AS INT) AS tile_i, CAST(j // 4 AS INT) AS tile_j, CAST(COUNT(*) AS BIGINT) AS n, SUM(UVEL) AS sum_u
FROM cells GROUP BY ALL""")
def tiles(t):
    """Chunk sizes per axis as tile columns."""
    tiled = store.with_tiles(t.cells, i=30, j=4)
    return tiled.groupBy("run", "rec", "tile_i", "tile_j").agg(F.count("*").alias("n"), F.sum("UVEL").alias("sum_u"))


@query("s04_iterations", uses="cells", sql="""
SELECT 'last' AS choice, run, k, j, i, iter, THETA FROM cells WHERE rec = 6
UNION ALL SELECT 'listed', run, k, j, i, iter, THETA FROM cells WHERE iter IN (3600, 7200)""")
def iterations(t):
    """The last iteration and listed ones."""
    def kept(choice, wanted):
        rows = select.iterations(t.cells, t.records, wanted)
        return rows.select(F.lit(choice).alias("choice"), "run", "k", "j", "i", "iter", "THETA")

    return kept("last", -1).unionByName(kept("listed", [3600, 7200]))


@query("s05_listed_runs", uses="cells", sql="""
SELECT run, rec, k, SUM(coalesce(VVEL,0)*hFacS) AS sv FROM cells WHERE run IN ('A', 'R') GROUP BY ALL""")
def listed_runs(t):
    """Reduced results of listed runs read through partition pruning."""
    path = t._once("profiles", lambda: t.cells.groupBy("run", "rec", "k").agg(F.sum(F.coalesce("VVEL", F.lit(0.0)) * F.col("hFacS")).alias("sv")),
                   store.replace_runs)
    return store.read_runs(t.spark, path, ["A", "R"])


@query("s06_all_runs_at_once", uses="cells", sql="""
SELECT run, rec, CAST(COUNT(*) AS BIGINT) AS n, SUM(THETA) AS sum_t, SUM(TRAC01) AS sum_c FROM cells GROUP BY ALL""")
def all_runs(t):
    """One job over every run of the sweep."""
    return t.cells.groupBy("run", "rec").agg(F.count("*").alias("n"), F.sum("THETA").alias("sum_t"), F.sum("TRAC01").alias("sum_c"))


@query("s07_replace_runs", uses="cells", sql="""
SELECT run, rec, CASE WHEN run = 'R' THEN 2 ELSE 1 END * SUM(UVEL) AS sum_u FROM cells GROUP BY run, rec""")
def replace_runs(t):
    """Write all runs, then rewrite one run; the others stay."""
    path = fresh_path(t.spark, "replace")
    sums = t.cells.groupBy("run", "rec").agg(F.sum("UVEL").alias("sum_u"))
    store.replace_runs(sums, path)
    store.replace_runs(sums.where("run = 'R'").withColumn("sum_u", F.col("sum_u") * 2), path)
    return store.read_cells(t.spark, path, "rec int, sum_u double, run string")


@query("s08_budget_tables", uses=_BUDGET_TABLES, sql=f"""
SELECT run, k, Z, round(Bf, 6) AS Bf, round(dWPdz, 6) AS dWPdz, round(dEdt, 6) AS dEdt, round(resid, 6) AS resid, area
FROM ({_BUDGET}) JOIN (SELECT run, SUM(rA) AS area FROM grid2d GROUP BY run) USING (run)""")
def budget_tables(t):
    """Profile and scalar results written side by side and read back."""
    path = fresh_path(t.spark, "budget")
    store.write_budget(rounded(_budget(t).select("run", "k", "Z", *_TERMS)), reduce.run_area(t.grid2d).select("run", "area"), path)
    profile = store.read_cells(t.spark, f"{path}/profile", "k int, Z double, Bf double, dWPdz double, dEdt double, resid double, run string")
    scalars = store.read_cells(t.spark, f"{path}/scalars", "area double, run string")
    return profile.join(scalars, "run")


@query("s09_processing_note", uses="cells", sql="""
SELECT run, rec, SUM(VVEL) AS work FROM cells GROUP BY ALL""")
def processing_note(t):
    """Provenance kept as column metadata."""
    summed = t.cells.groupBy("run", "rec").agg(F.sum("VVEL").alias("w"))
    return summed.select("run", "rec", store.with_processing_note(F.col("w"), "work", "sum of V"))


@query("s10_log_scan", uses="log_lines", sql="""
SELECT run, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(length(value)) AS BIGINT) AS chars FROM log_lines
WHERE regexp_matches(value, 'advcfl_wvel_max|time_seconds') GROUP BY run""")
def log_scan(t):
    """Matching lines of text logs, the run taken from the path."""
    lines = text.read_lines(t.spark, t.log_folder + "/*", r"run=([^/]+)/")
    hits = lines.where(F.col("value").rlike("advcfl_wvel_max|time_seconds"))
    return hits.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query("s11_job_log", uses="job_log", sql="""
SELECT ord, run, status, CAST(len(job_ids) AS INT) AS n_jobs, array_to_string(job_ids, ' ') AS ids FROM job_log""")
def job_log(t):
    """Job-log lines split into name, status and ids."""
    return catalogue.job_records(t.job_lines).select(
        "ord", "run", "status", F.size("job_ids").alias("n_jobs"), F.array_join("job_ids", " ").alias("ids"))


@query("s12_append_jobs", uses="job_log", sql="""
SELECT run, CAST(2 * COUNT(*) AS BIGINT) AS lines, CAST(2 * SUM(len(job_ids)) AS BIGINT) AS jobs FROM job_log GROUP BY run""")
def append_jobs(t):
    """Records appended to a job log by two jobs, one of which is run again."""
    path = fresh_path(t.spark, "joblog")
    jobs = catalogue.job_records(t.job_lines)
    for token in ("first", "second", "first"):
        text.append_job_records(jobs, path, token)
    back = catalogue.job_records(text.read_job_lines(t.spark, path))
    return back.groupBy("run").agg(F.count("*").alias("lines"), F.sum(F.size("job_ids")).cast("bigint").alias("jobs"))


@query("s13_run_log", uses="run_log", sql="""
SELECT file, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged, run, comment FROM run_log""")
def run_log(t):
    """Run-log entries from lines, entries crossing chunk borders included."""
    entries = catalogue.run_log_entries(t.run_log_lines)
    return entries.select("file", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged"), "run", "comment")


@query("s14_parameter_files", sql="""
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS run, 'PARM01' AS grp, 'f0' AS name, CAST(s_nationkey AS VARCHAR) || '.E-4' AS value FROM supplier
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'PARM01', 'rigidLid', '.FALSE.' FROM supplier
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'LIST', 'fields(1:2,1)', '''UVEL'', ''VVEL''' FROM supplier""")
def parameter_files(t):
    """Name, value and group of parameter-file lines; comments skipped, continuations joined."""
    rows = t.given("supplier").selectExpr("s_suppkey", "concat('S', s_suppkey) AS run", (
        "array('# model', ' &PARM01', concat(' f0=', s_nationkey, '.E-4,'), '# beta=1,', ' rigidLid=.FALSE.,', ' /', '', "
        "' &LIST', \" fields(1:2,1) = 'UVEL',\", \"   'VVEL',\", '/') AS texts"))
    lines = rows.select("run", F.lit("data").alias("file"), "s_suppkey", F.posexplode("texts").alias("n", "value"))
    lines = lines.select("run", "file", "value", (F.col("s_suppkey") * 11 + F.col("n")).alias("ord"))
    found = catalogue.harvest_parameters(lines.withColumn("chunk", F.floor(F.col("ord") / 4)))
    return found.select("run", "grp", "name", "value")


@query("s15_rechunk", uses="cells", sql="""
SELECT run, CAST(COUNT(*) AS BIGINT) AS n, SUM(UVEL) AS sum_u, SUM(THETA) AS sum_t FROM cells GROUP BY run""")
def rechunk(t):
    """Re-chunked copy: rows and sums survive."""
    path = fresh_path(t.spark, "rechunk")
    store.repartition_tiles(t.cells.select("run", "rec", "k", "j", "i", "UVEL", "THETA"), i=40, j=8).write.parquet(path)
    back = t.spark.read.parquet(path)
    return back.groupBy("run").agg(F.count("*").alias("n"), F.sum("UVEL").alias("sum_u"), F.sum("THETA").alias("sum_t"))


# --- selections ------------------------------------------------------------


@query("p01_pick_rename", uses="cells2d grid2d", sql="""
SELECT run, rec, j, i, time_s, ETAN, Depth AS DEPTH, XC, YC FROM cells2d JOIN grid2d USING (run, j, i)""")
def pick_rename(t):
    """Chosen variables with coordinates, depth renamed."""
    from gridspark.operators.metrics import with_horizontal

    rows = with_horizontal(t.cells2d, t.grid2d, "Depth", "XC", "YC")
    return select.pick(rows, ["run", "rec", "j", "i", "time_s"], ETAN="ETAN", DEPTH="Depth", XC="XC", YC="YC")


@query("p02_drop_prefixed", uses="cells", sql="""
SELECT * EXCLUDE (hFacC, hFacW, hFacS) FROM cells""")
def drop_prefixed(t):
    """Coordinates dropped by name prefix."""
    return select.drop_prefixed(t.bare_cells.drop("stream"), "hFac", "mask")


@query("p03_fixed_slice", uses="cells", sql="SELECT run, rec, k, i, UVEL, THETA FROM cells WHERE j = 5")
def fixed_slice(t):
    """Rows of one fixed j."""
    return select.at(t.cells, j=5).select("run", "rec", "k", "i", "UVEL", "THETA")


@query("p04_middle_slice", uses="cells", sql="""
SELECT run, rec, k, j, i, UVEL FROM cells c WHERE j = (SELECT (max(j) + 1) // 2 FROM cells m WHERE m.run = c.run)""")
def middle_slice(t):
    """The middle row of each run's own grid."""
    return select.middle_row(t.cells, t.grid2d).select("run", "rec", "k", "j", "i", "UVEL")


@query("p05_strided_time", uses="cells", sql="SELECT run, rec, k, j, i, THETA FROM cells WHERE rec % 5 = 0")
def strided_time(t):
    """Every fifth record."""
    return select.records_between(t.cells, t.records, step=5).select("run", "rec", "k", "j", "i", "THETA")


@query("p06_records_from_end", uses="cells", sql="""
SELECT 'inner' AS part, run, rec, k, j, i, UVEL FROM cells WHERE rec >= 3 AND rec < 6
UNION ALL SELECT 'tail', run, rec, k, j, i, UVEL FROM cells WHERE rec >= 2
UNION ALL SELECT 'last', run, rec, k, j, i, UVEL FROM cells WHERE rec = 6""")
def records_from_end(t):
    """Record ranges counted from the end: [-4, -1), [-5, end) and the last."""
    rows = select.records_in_ranges(t.cells, t.records, inner=(-4, -1), tail=(-5, None), last=(-1, None))
    return rows.select("part", "run", "rec", "k", "j", "i", "UVEL")


@query("p07_depth_range", uses="cells grid1d", sql="""
SELECT run, rec, k, j, i, Z, UVEL FROM cells JOIN grid1d USING (run, k) WHERE Z < -20 AND Z > -60""")
def depth_range(t):
    """Levels strictly between two depths."""
    levels = select.between_exclusive(t.grid1d, "Z", -60.0, -20.0).select("run", "k", "Z")
    return t.cells.join(levels, ["run", "k"]).select("run", "rec", "k", "j", "i", "Z", "UVEL")


@query("p08_one_record", uses="cells", sql="SELECT run, k, j, i, PHIHYD, WVEL FROM cells WHERE rec = 1")
def one_record(t):
    """A single record."""
    return select.at(t.cells, rec=1).select("run", "k", "j", "i", "PHIHYD", "WVEL")


@query("p09_edge_strips", uses="cells", sql="""
WITH n AS (SELECT run, max(i) AS mi, max(j) AS mj FROM cells GROUP BY run)
SELECT 'W' AS side, run, rec, k, j, i, UVEL, CAST(0 AS INT) AS face FROM cells WHERE i < 2
UNION ALL SELECT 'E', run, rec, k, j, i, UVEL, mi FROM cells JOIN n USING (run) WHERE i >= mi - 1
UNION ALL SELECT 'S', run, rec, k, j, i, UVEL, 0 FROM cells WHERE j < 2
UNION ALL SELECT 'N', run, rec, k, j, i, UVEL, mj FROM cells JOIN n USING (run) WHERE j >= mj - 1""")
def edge_strips(t):
    """The two rows or columns along each side."""
    strips = select.edge_strips(t.cells.select("run", "rec", "k", "j", "i", "UVEL"), t.grid2d)
    return strips.select("side", "run", "rec", "k", "j", "i", "UVEL", "face")


@query("p10_mask_land", uses="cells", sql="""
SELECT run, rec, k, j, i, CASE WHEN THETA <> 0 THEN UVEL END AS u, CASE WHEN THETA > 0 THEN THETA END AS t FROM cells""")
def mask_land(t):
    """Land masked by a companion field; positive values kept."""
    return t.cells.select("run", "rec", "k", "j", "i", select.mask_land("UVEL", "THETA").alias("u"),
                          select.keep_positive("THETA").alias("t"))


@query("p11_point_series", uses="cells", sql="SELECT run, rec, k, WVEL FROM cells WHERE j = 2 AND i = 2")
def point_series(t):
    """Depth series at one position."""
    return select.point_series(t.cells, 2, 2, "WVEL")


@query("p12_background_anomaly", uses="cells", sql="SELECT run, rec, k, j, i, UVEL - 0.125 AS u_anom FROM cells")
def background_anomaly(t):
    """Flow relative to a constant background."""
    return t.cells.select("run", "rec", "k", "j", "i", select.background_anomaly("UVEL", 0.125).alias("u_anom"))


@query("p13_depth_time_section", uses="cells", sql="SELECT run, k, rec, SUM(UVEL) AS su FROM cells GROUP BY run, k, rec")
def depth_time_section(t):
    """Level by record matrix of a reduced profile, one column for each record there is, shown as rows."""
    profile = t.cells.groupBy("run", "rec", "k").agg(F.sum("UVEL").alias("su"))
    section = select.depth_time_section(profile, "su")
    rows = section.unpivot(["run", "k"], [c for c in section.columns if c not in ("run", "k")], "rec", "su")
    return rows.select("run", "k", F.col("rec").cast("int").alias("rec"), "su")


@query("p14_bathymetry_section", uses="grid2d", sql="SELECT run, i, Depth FROM grid2d WHERE j = 5")
def bathymetry_section(t):
    """Depth along one row."""
    return select.bathymetry_section(t.grid2d, 5)
