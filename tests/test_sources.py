"""Binary ingest, table layout, ordered text and streams."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import catalogue, monitor, ordered, select
from gridspark.operators.timewin import event_time
from gridspark.sources import binary, tables, text
from gridspark.sources.shared import settle
from gridspark.streaming import live
from tests.grids import frame


def write_pair(folder, name, arrays, dtype="<f8", fields=("UVEL", "THETA"), prec="float64"):
    """One header/array pair holding (k, j, i) arrays of the fields."""
    os.makedirs(folder, exist_ok=True)
    nk, nj, ni = arrays[0].shape
    with open(f"{folder}/{name}.meta", "w") as f:
        f.write(f" nDims = [ 3 ];\n dimList = [\n {ni}, 1, {ni},\n {nj}, 1, {nj},\n {nk}, 1, {nk}\n ];\n dataprec = [ '{prec}' ];\n"
                f" nrecords = [ {len(arrays)} ];\n timeStepNumber = [ 10 ];\n nFlds = [ {len(fields)} ];\n fldList = {{\n"
                + " ".join(f"'{n:8s}'" for n in fields) + "\n };\n")
    np.concatenate([a.reshape(-1) for a in arrays]).astype(dtype).tofile(f"{folder}/{name}.data")


@pytest.mark.parametrize("dtype,prec,endian", [("<f8", "float64", "<"), (">f8", "float64", ">"), ("<f4", "float32", "little"), ("=f8", "real*8", "=")])
def test_binary_round_trip(spark, tmp_path, dtype, prec, endian):
    rng = np.random.default_rng(1)
    want = {}
    for run in ("One", "Two"):
        for it in (10, 30, 20):
            u, t = rng.random((3, 5, 4)).astype("f4"), rng.random((3, 5, 4)).astype("f4")
            u[0, 0, 0] = np.nan
            want[run, it] = (u, t)
            write_pair(f"{tmp_path}/results/{run}/input", f"spinup.{it:010d}", [u, t], dtype, prec=prec)
    cells = binary.read_stream(spark, f"{tmp_path}/results/*/input/spinup.*.meta", ["THETA", "UVEL", "TRAC01"], endian,
                               seconds_per_step=6.2, cells_per_item=8).toPandas()
    assert len(cells) == 2 * 3 * 60 and cells["TRAC01"].isna().all()
    assert sorted(cells[["iter", "rec"]].drop_duplicates().itertuples(index=False, name=None)) == [(10, 0), (20, 1), (30, 2)]
    for (run, it), (u, t) in want.items():
        part = cells[(cells["run"] == run) & (cells["iter"] == it)].sort_values(["k", "j", "i"])
        np.testing.assert_allclose(part["THETA"], t.reshape(-1))
        np.testing.assert_allclose(part["UVEL"].astype(float), u.reshape(-1))
        assert part["UVEL"].isna().sum() == 1 and (part["time_s"] == it * 6.2).all()


def test_binary_tiles_are_placed_by_their_bounds(spark, tmp_path):
    folder = f"{tmp_path}/results/One/input"
    whole = np.arange(2 * 2 * 8.0).reshape(2, 2, 8)
    for tile, (i0, i1) in enumerate([(0, 5), (5, 8)]):
        name = f"spinup.0000000010.{tile + 1:03d}.001"
        write_pair(folder, name, [whole[:, :, i0:i1]], fields=("UVEL",))
        header = open(f"{folder}/{name}.meta").read()
        open(f"{folder}/{name}.meta", "w").write(header.replace(f"{i1 - i0}, 1, {i1 - i0},", f"8, {i0 + 1}, {i1},"))
    out = binary.read_stream(spark, f"{folder}/spinup.*.meta", ["UVEL"], cells_per_item=6).orderBy("k", "j", "i").collect()
    assert [r["UVEL"] for r in out] == list(whole.reshape(-1)) and {r["stream"] for r in out} == {"spinup"}


def test_binary_last_iteration_opens_only_that_file(spark, tmp_path):
    folder = f"{tmp_path}/results/One/input"
    for it in (10, 20):
        write_pair(folder, f"spinup.{it:010d}", [np.full((1, 2, 2), it), np.zeros((1, 2, 2))])
    os.truncate(f"{folder}/spinup.0000000010.data", 0)
    out = binary.read_stream(spark, f"{folder}/spinup.*.meta", ["UVEL"], iterations=[-1]).collect()
    assert {(r["iter"], r["rec"], r["UVEL"]) for r in out} == {(20, 1, 20.0)}


def test_cells_layout_and_run_replacement(spark, tmp_path):
    cells = frame(spark, {"UVEL": np.arange(24.0).reshape(2, 3, 4)}, run="a").unionByName(frame(spark, {"UVEL": np.ones((2, 3, 4))}, run="b"))
    tables.write_cells(cells, f"{tmp_path}/cells", rows_per_file=10)
    back = tables.read_runs(spark, f"{tmp_path}/cells", ["a"])
    assert back.agg(F.sum("UVEL")).collect()[0][0] == 276.0 and back.count() == 24
    sums = cells.groupBy("run", "k").agg(F.sum("UVEL").alias("s"))
    tables.replace_runs(sums, f"{tmp_path}/sums")
    tables.replace_runs(sums.where("run = 'a'").withColumn("s", F.lit(-1.0)), f"{tmp_path}/sums")
    assert {(r["run"], r["s"]) for r in spark.read.parquet(f"{tmp_path}/sums").collect()} == {("a", -1.0), ("b", 12.0)}


def test_processing_note_survives_parquet(spark, tmp_path):
    df = spark.range(1).select(tables.with_processing_note(F.col("id"), "work", "sum of V"))
    df.write.parquet(f"{tmp_path}/n")
    assert spark.read.parquet(f"{tmp_path}/n").schema["work"].metadata == {"processing": "sum of V"}


def test_random_array_rechunks(spark, tmp_path):
    a = settle(tables.random_array(spark, 40, 48, seed=3), "random")
    tables.repartition_tiles(a.withColumnsRenamed({"x": "j", "y": "i"}), j=10, i=12).write.parquet(f"{tmp_path}/r")
    b = spark.read.parquet(f"{tmp_path}/r")
    assert b.count() == 1920
    assert abs(a.agg(F.sum("value")).collect()[0][0] - b.agg(F.sum("value")).collect()[0][0]) < 1e-9


def test_carry_forward_over_chunks_with_a_hot_key(spark):
    rows = [("hot", n, n // 4, float(n) if n % 11 == 3 else None) for n in range(200)] + [("cold", 5, 1, None), ("cold", 9, 2, 1.5), ("cold", 40, 10, None)]
    df = spark.createDataFrame(rows, "run string, ord long, chunk long, v double")
    got = {(r["run"], r["ord"]): r["c"] for r in ordered.carry_forward(df, "v", ["run"], "chunk", "ord", "c").collect()}
    assert len(got) == len(rows)
    last = None
    for n in range(200):
        last = float(n) if n % 11 == 3 else last
        assert got["hot", n] == last
    assert got["cold", 5] is None and got["cold", 40] == 1.5


def test_lines_keep_order_over_file_splits(spark, tmp_path):
    folder = tmp_path / "results" / "One" / "input"
    folder.mkdir(parents=True)
    (folder / "STDOUT.0000").write_text("\n".join(f"%MON time_secondsf = {n}.0E+00" for n in range(20000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = text.read_lines(spark, str(folder))
        assert lines.select("chunk").distinct().count() > 5
        out = monitor.latest(monitor.metrics(lines)).collect()
        assert [(r["run"], r["metric"], r["value"]) for r in out] == [("One", "time_secondsf", 19999.0)]
        tail = monitor.matching_tail(lines, "time_seconds", 3).orderBy("from_end").collect()
        assert [r["value"].split()[-1] for r in tail] == ["19999.0E+00", "19998.0E+00", "19997.0E+00"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _segments(tmp_path):
    """Two log files of one run, the later one larger."""
    folder = tmp_path / "results" / "One" / "input"
    folder.mkdir(parents=True)
    block = "%MON time_tsnumber = {0}\n%MON time_secondsf = {0}.0E+00\n%MON advcfl_uvel_max = {1}.0E-02\n"
    (folder / "STDOUT.0000").write_text("".join(block.format(n, n) for n in range(5)))
    (folder / "STDOUT.0001").write_text("%MON advcfl_uvel_max = 77.0E-02\n" + "".join(block.format(n, n) for n in range(5, 400)))
    os.utime(folder / "STDOUT.0000", (1, 1))
    return str(folder)


@pytest.mark.parametrize("by", ["name", "time"])
def test_several_log_files_of_a_run(spark, tmp_path, by):
    lines = text.read_lines(spark, _segments(tmp_path), by=by)
    rows = monitor.metrics(lines)
    assert {r["metric"]: r["value"] for r in monitor.latest(rows).collect()}["time_secondsf"] == 399.0
    tail = monitor.matching_tail(lines, "time_seconds", 2).orderBy("from_end").collect()
    assert [r["value"].split()[-1] for r in tail] == ["399.0E+00", "398.0E+00"]
    assert monitor.progress(rows).first()["model_seconds"] == 399.0
    table = {r["block"]: r for r in monitor.blocks(rows, ["time_secondsf", "advcfl_uvel_max"]).collect()}
    assert table[4]["advcfl_uvel_max"] == 0.77 and table[5]["time_secondsf"] == 5.0 and len(table) == 400


def test_several_log_files_arriving_in_any_order(spark, tmp_path):
    _segments(tmp_path)
    os.utime(tmp_path / "results" / "One" / "input" / "STDOUT.0001", (0, 0))  # the last file arrives first
    updates = live.watch_log_files(live.log_stream(spark, str(tmp_path / "results"), 1), "any-order")
    assert updates.select("batch").distinct().count() == 2
    assert {r["metric"]: r["value"] for r in monitor.latest(updates).collect()}["time_secondsf"] == 399.0


def test_growing_log(spark, tmp_path):
    """Lines appended to a file that was read before arrive, once, when they are complete."""
    from gridspark.sources import tail

    folder = tmp_path / "logs" / "results" / "One" / "input"
    folder.mkdir(parents=True)
    log, seen = folder / "STDOUT.0000", []
    log.write_text("%MON time_secondsf = 1.0E+00\n%MON time_secondsf = 2.0E+00\n%MON time_sec")

    def poll():
        lines = tail.growing_lines(spark, str(tmp_path / "logs"))
        query = (lines.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
                 .foreachBatch(lambda batch, n: seen.extend(monitor.metrics(batch).collect())).start())
        query.awaitTermination()

    poll()
    assert [r["value"] for r in seen] == [1.0, 2.0]
    with log.open("a") as more:
        more.write("ondsf = 3.0E+00\n" + "".join(f"%MON time_secondsf = {n}.0E+00\n" for n in range(4, 400)))
    poll()
    assert sorted(r["value"] for r in seen) == [float(n) for n in range(1, 400)]
    assert max(seen, key=lambda r: r["ord"])["value"] == 399.0 and {r["run"] for r in seen} == {"One"}


def test_growing_log_ranges(tmp_path):
    """Every line is read once, however the bytes are cut."""
    from gridspark.sources.tail import TailReader

    text_ = "".join(f"line {n} {'x' * (n % 37)}\n" for n in range(300))
    (tmp_path / "a.log").write_text(text_ + "unfinished")
    for size in (1, 7, 64, 100000):
        reader = TailReader(str(tmp_path), ".", size)
        parts = reader.partitions({}, reader.latestOffset())
        assert [v for p in parts for b in reader.read(p) for v in b["value"].to_pylist()] == text_.splitlines()


def test_comments_may_mention_a_path(spark):
    log = ["2025-01-02 03:04:05", "../results/A/input/", "like results/B/ but longer", "", "2025-01-03 03:04:05", "no path, see results/C/x"]
    df = spark.createDataFrame([("f", n, n // 2, v) for n, v in enumerate(log)], "file string, ord long, chunk long, value string")
    rows = catalogue.run_log_entries(df).orderBy("logged_at").collect()
    assert [(r["run"], r["comment"]) for r in rows] == [("A", "like results/B/ but longer"), ("C", "")]


def test_all_metric_families_are_kept(spark):
    names = ["forcing_qnet_max", "ke_max", "vort_r_min", "advcfl_uvel_max"]
    df = spark.createDataFrame([("r", n, f"%MON {m} = {n}.0E+00") for n, m in enumerate(names)], "run string, ord long, value string")
    assert {r["metric"] for r in monitor.metrics(df).collect()} == set(names)
    assert {r["metric"] for r in monitor.metrics(df, ("ke", "vort")).collect()} == {"ke_max", "vort_r_min"}


def test_metric_names(spark):
    lines = ["(PID.TID 0000.0001) %MON time_secondsf                =   3.7200000000000E+03", "%MON trAdv_CFL_u_max = 1.0E-01",
             "%MON advcfl_W_hf_max = 2.0E-01", "// Begin MONITOR dynamic field statistics", "%MON dynstat_eta_max = broken"]
    df = spark.createDataFrame([("r", n, v) for n, v in enumerate(lines)], "run string, ord long, value string")
    got = [(r["metric"], r["value"]) for r in monitor.metrics(df).orderBy("ord").collect()]
    assert got == [("time_secondsf", 3720.0), ("trAdv_CFL_u_max", 0.1), ("advcfl_W_hf_max", 0.2), ("dynstat_eta_max", None)]


def test_run_log_entries(spark):
    log = """2025-01-02 03:04:05
../results/Line007/input/
Line007 alpha = 0.7. const stratification. u_0=0.6. N_0=0.002.  Four tracers
   topox: [ 0. 15000.
 32998.5] topodepth: [ 0. -200.]


2025-01-01 00:00:00
../results/Line006/input/
alpha = 1.25. dhdx=0.088 const stratification. u_0=0.6. N_0=0.002.
2020-10-23 00:18:20
../results/Wide/input/
Boo

"""
    df = spark.createDataFrame([("f", n, n // 2, v) for n, v in enumerate(log.split("\n"))], "file string, ord long, chunk long, value string")
    rows = catalogue.decoded_comments(catalogue.run_log_entries(df)).orderBy(F.desc("logged_at")).collect()
    assert [r["run"] for r in rows] == ["Line007", "Line006", "Wide"]
    assert rows[0]["comment"].endswith("topodepth: [ 0. -200.]") and "32998.5" in rows[0]["comment"]
    assert (rows[0]["alpha"], rows[0]["u_0"], rows[0]["N_0"], rows[0]["strat"]) == (0.7, 0.6, 0.002, "const")
    assert rows[1]["dhdx"] == 0.088 and rows[2]["alpha"] is None and rows[2]["strat"] is None


def test_run_names(spark):
    names = ["Hill3kmlowU15N0010Amp305f141B059Rough100", "Hill1kmlowU-10Amp305f141", "LineconstN200alpha125u090", "Line007", "HillU10N10Amp610f038"]
    out = {r["run"]: r for r in catalogue.decoded_names(spark.createDataFrame([(n,) for n in names], "run string")).collect()}
    a = out[names[0]]
    assert (a["U0"], a["N_raw"], a["N0"], a["height"], a["f0"], a["B"]) == (0.15, "0010", 0.001, 305.0, 141 / 1e6, 59.0)
    assert out[names[1]]["U0"] == -0.1 and out[names[1]]["N0"] is None
    assert (out[names[2]]["N0"], out[names[2]]["alpha"], out[names[2]]["flow"]) == (0.002, 1.25, 0.9)
    assert all(out["Line007"][c] is None for c in ("U0", "N0", "height", "f0", "alpha"))


def test_parameter_files(spark):
    body = """# comments
 &PARM01
 f0=0.E-4,
# beta=0,
 no_slip=.FALSE.,
 files(1:3,2) = 'A   ',
        'B   ',
        'C   ',
 last=3
 /
&OTHER
 x = 1.5,
/"""
    df = spark.createDataFrame([("r", "data", n, n // 3, v) for n, v in enumerate(body.split("\n"))],
                               "run string, file string, ord long, chunk long, value string")
    got = {(r["grp"], r["name"]): r["value"] for r in catalogue.harvest_parameters(df).collect()}
    assert got[("PARM01", "f0")] == "0.E-4" and got[("PARM01", "no_slip")] == ".FALSE." and got[("OTHER", "x")] == "1.5"
    assert got[("PARM01", "files(1:3,2)")] == "'A   ', 'B   ', 'C   '" and got[("PARM01", "last")] == "3" and len(got) == 5
    flags = spark.createDataFrame([(".TRUE.",), (".false.",), ("1",)], "v string").select(catalogue.flag("v").alias("b")).collect()
    assert [r["b"] for r in flags] == [True, False, None]


def test_job_status(spark):
    lines = spark.createDataFrame([(1, "runA queued 11 12 13"), (2, "runB queued 21"), (3, "runC queued")], "ord long, value string")
    accounting = spark.createDataFrame([("11", "COMPLETED", "None", "0:0", "1:00"), ("12", "PENDING", "Dependency", "0:0", ""),
                                        ("13", "PENDING", "Priority", "0:0", ""), ("21", "RUNNING", "None", "0:0", "0:10")],
                                       "job_id string, state string, reason string, exit_code string, elapsed string")
    out = {r["run"]: r for r in catalogue.job_status(catalogue.job_records(lines), accounting).collect()}
    assert out["runA"]["job_states"] == "11: done: 0:0  12: PENDING Dependency  13" and not out["runA"]["running"]
    assert out["runB"]["running"] and out["runB"]["job_states"] == "21: RUNNING"
    assert out["runC"]["job_states"] == "" and out["runC"]["job_ids"] == ""


def test_late_rows_are_dropped_and_closed_windows_match_batch(spark, tmp_path):
    import time

    def batch(n, rows):
        path = tmp_path / "in" / f"{n}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(f"r,{t},{v}" for t, v in rows) + "\n")
        os.utime(path, (time.time() - 100 + n, time.time() - 100 + n))

    batch(0, [(10, 1.0), (1000, 3.0), (52000, 5.0)])
    batch(1, [(50010, 7.0)])  # a batch drops what was late before the batch ahead of it
    batch(2, [(100, 99.0), (200000, 9.0)])
    stream = (spark.readStream.schema("run string, time_s double, x double").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
              .withColumn("ts", event_time()))
    out = live.drain(live.streaming_average(stream, ["run"], ["x"], 44640.0), "late").orderBy("t0").collect()
    assert [(r["t0"], r["x"], r["n"]) for r in out] == [(0, 2.0, 2), (44640, 6.0, 2)]


def test_last_and_strided_records(spark):
    cells = frame(spark, {"UVEL": np.ones((1, 1, 1))}, rec=0)
    for rec in (2, 3, 7, 8, 9):
        cells = cells.unionByName(frame(spark, {"UVEL": np.ones((1, 1, 1))}, rec=rec))
    records = select.records_of(cells)

    def recs(*a, **k):
        return sorted(r["rec"] for r in select.records_between(cells, records, *a, **k).collect())

    assert recs(-4, -1) == [3, 7, 8] and recs(step=5) == [0, 9] and recs(-1) == [9] and recs(1, 3) == [2, 3] and recs(-50) == [0, 2, 3, 7, 8, 9]


def test_interpolation_matches_numpy(spark):
    from gridspark.functions.interp import edge_bin, piecewise_linear

    xs = np.array([-1.0, 0.0, 0.5, 1.0, 2.5, 4.0, 4.5])
    breaks = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (1.0, 10.0), (4.0, -2.0)]])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["y"] for r in df.select(piecewise_linear("x", breaks, F.lit(-5.0), F.lit(7.0)).alias("y")).collect()]
    np.testing.assert_allclose(got, np.interp(xs, [0, 1, 4], [0, 10, -2], left=-5, right=7))
    edges = [-2.0, 0.5, 1.0, 3.0, 4.0]
    bins = [r["b"] for r in df.select(edge_bin("x", edges).alias("b")).collect()]
    assert bins == list(np.clip(np.digitize(xs, edges) - 1, 0, 3))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_buckets_need_no_shuffle(spark, tmp_path):
    """Stored by water column, vertical and per-cell operators and the metric join do not move cells."""
    from gridspark.operators import layers, metrics, reduce, stencil, timewin
    from tests.grids import grid1d, grid2d

    one = np.ones((3, 4, 5))
    cells = frame(spark, {n: one for n in ("UVEL", "THETA", "PHIHYD", "hFacC", "hFacW", "hFacS")})
    tables.save_by_column(cells, "cells_by_column", 4, f"{tmp_path}/c")
    tables.save_by_column(grid2d(spark, 4, 5), "grid_by_column", 4, f"{tmp_path}/g")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        cells, grid = spark.table("cells_by_column"), spark.table("grid_by_column")
        level = settle(grid1d(spark, 3, t0=[1.0, 2.0, 3.0]), "levels")
        assert "Exchange" not in plan_of(cells.select("k", stencil.interface_value().alias("p")))
        assert "Exchange" not in plan_of(reduce.split_vertical_mean(cells))
        moved = re.compile(r"hashpartitioning\([^)]*\bj#")  # a shuffle on cell keys
        assert not moved.search(plan_of(layers.layer_transport(cells, level, 4)))
        assert not moved.search(plan_of(timewin.tidal_average(cells, ["UVEL"])))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = metrics.with_horizontal(cells, grid, "rA")
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        assert joined.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("cells_by_column", "grid_by_column"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_per_run_tables_are_settled(spark):
    """A per-run table is written and re-read before it is joined, at any size."""
    from gridspark.operators.select import domain_of, middle_row
    from tests.grids import grid2d

    cells, grid = frame(spark, {"UVEL": np.ones((2, 5, 3))}), grid2d(spark, 5, 3)
    assert "FileScan" in plan_of(domain_of(grid))
    assert {r["j"] for r in middle_row(cells, grid).collect()} == {2}


def test_tail_is_limited_before_the_shuffle(spark):
    lines = spark.range(1000).selectExpr("concat('r', id % 2) AS run", "id AS ord", "'time_seconds 1' AS value")
    plan = plan_of(monitor.matching_tail(lines, "time_seconds", 9))
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") >= 2


def test_settled_tables_are_removed_together(tmp_path):
    """Everything an application settled lies in one folder of its own; removing it leaves others alone."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from gridspark.sources.shared import own_dir, remove_settled, settle
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
assert settle(spark.range(3), "x").count() == 3 and own_dir(spark).startswith("file://{tmp_path}/shared/gridspark-")
assert remove_settled(spark) and not remove_settled(spark)
"""
    (tmp_path / "shared" / "other").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
    left = os.listdir(tmp_path / "shared")  # Spark itself keeps a folder there
    assert "other" in left and not [x for x in left if x.startswith("gridspark-")]
