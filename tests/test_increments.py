"""Exactly-once appends, incremental averages, comment changes, stable moments, long breakpoint tables."""

import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.interp import deepest_above, piecewise_linear
from gridspark.operators import catalogue, incremental, ordered, reduce, select, stats
from gridspark.operators.timewin import tidal_average
from gridspark.sources import ledger, tables, text
from tests.grids import frame, grid1d, grid2d

JOBS = "run string, status string, job_ids array<string>"


def test_a_token_appends_once(spark, tmp_path):
    path = str(tmp_path / "jobs")
    one = spark.createDataFrame([("a", "queued", ["1", "2"]), ("b", "queued", [])], JOBS)
    two = spark.createDataFrame([("a", "queued", ["3"])], JOBS)
    assert text.read_job_lines(spark, path).count() == 0
    assert text.append_job_records(one, path, "job-1") and not text.append_job_records(one, path, "job-1")
    assert text.append_job_records(two, path, "job-2")
    assert sorted(r.value for r in text.read_job_lines(spark, path).collect()) == ["a queued 1 2", "a queued 3", "b queued "]


def test_unfinished_and_racing_attempts(spark, tmp_path):
    """Rows without a commit are not read; of two commits of a token the first counts."""
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    ledger.write_attempt(rows(1, 2), f"{path}/rows", "x", "killed")
    read = lambda: sorted(r.v for r in ledger.read_committed(spark, path, "v int").collect())
    assert read() == []
    ledger.write_attempt(rows(3), f"{path}/rows", "x", "first")
    ledger.write_attempt(rows(4), f"{path}/rows", "x", "second")
    ledger.commit(spark, path, "x", "first")
    time.sleep(0.01)
    ledger.commit(spark, path, "x", "second")
    assert read() == [3] and not ledger.append_once(rows(5), path, "x") and ledger.append_once(rows(6), path, "y")
    assert read() == [3, 6]


def cells_of(spark, recs):
    rng = np.random.default_rng(1)
    out = []
    for r in range(6):
        x = rng.normal(size=(2, 3, 4))
        x[0, 0, r % 4] = np.nan
        if r in recs:
            out.append(frame(spark, {"UVEL": x}, rec=r).withColumn("time_s", F.lit(r * 22320.0)))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return tables.clean_missing(whole, "UVEL")


def test_added_records_equal_a_full_run(spark, tmp_path):
    store, sums = str(tmp_path / "cells"), str(tmp_path / "sums")
    cells_of(spark, range(6)).write.partitionBy("run", "stream", "rec").parquet(store)
    cells = spark.read.parquet(store).withColumn("rec", F.col("rec").cast("int"))
    records = select.records_of(cells)
    want = sorted((r.t0, r.k, r.j, r.i, r.n, None if r.UVEL is None else round(r.UVEL, 12)) for r in tidal_average(cells, ["UVEL"]).collect())
    got = lambda: sorted((r.t0, r.k, r.j, r.i, r.n, None if r.UVEL is None else round(r.UVEL, 12)) for r in incremental.averages(spark, sums, ["UVEL"]).collect())
    key = lambda rows: sorted(rows, key=str)
    assert incremental.add_records(cells, records.where("pos < 3"), sums, ["UVEL"]) == 3
    assert incremental.add_records(cells, records.where("pos < 3"), sums, ["UVEL"]) == 0  # a retried job
    assert incremental.add_records(cells, records.where("pos <> 4"), sums, ["UVEL"]) == 2
    before = len(glob.glob(f"{sums}/sums/**/*.parquet", recursive=True))
    assert incremental.add_records(cells, records, sums, ["UVEL"]) == 1
    assert len(glob.glob(f"{sums}/sums/**/*.parquet", recursive=True)) > before
    assert key(got()) == key(want)


def test_one_new_record_reads_only_its_files(spark, tmp_path):
    """The files of records that are known may be broken: they are not read."""
    store, sums = str(tmp_path / "cells"), str(tmp_path / "sums")
    cells_of(spark, range(6)).write.partitionBy("run", "stream", "iter").parquet(store)
    schema = spark.read.parquet(store).schema
    cells = spark.read.schema(schema).parquet(store).withColumn("iter", F.col("iter").cast("bigint"))
    records = select.records_of(cells)
    incremental.add_records(cells, records.where("pos < 5"), sums, ["UVEL"])
    for f in glob.glob(f"{store}/**/*.parquet", recursive=True):
        if "iter=50" not in f:
            open(f, "wb").write(b"broken")
    for f in glob.glob(f"{store}/**/.*.crc", recursive=True):
        if "iter=50" not in f:
            open(f, "wb").write(b"")
    assert incremental.add_records(cells, records.where("pos = 5"), sums, ["UVEL"]) == 1
    assert incremental.averages(spark, sums, ["UVEL"]).agg(F.sum("n")).first()[0] == 6 * 24


def test_a_killed_job_adds_nothing(spark, tmp_path, monkeypatch):
    sums = str(tmp_path / "sums")
    cells = cells_of(spark, range(3))
    records = select.records_of(cells)

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            incremental.add_records(cells, records, sums, ["UVEL"])
    assert incremental.averages(spark, sums, ["UVEL"]).count() == 0
    assert incremental.add_records(cells, records, sums, ["UVEL"]) == 3
    assert incremental.averages(spark, sums, ["UVEL"]).agg(F.sum("n")).first()[0] == 3 * 24


def test_comment_changes(spark):
    """A, B, A are three changes; a NULL comment is one too; days and equal times make no difference."""
    rows = [("r", "2025-01-01 10:00:00", 0, "A"), ("r", "2025-01-01 10:00:00", 1, "A"), ("r", "2025-01-02 00:00:01", 2, "B"), ("r", "2025-01-05 00:00:00", 3, "B"),
            ("r", "2025-01-05 00:00:00", 4, "A"), ("r", "2025-02-01 00:00:00", 5, None), ("r", "2025-02-02 00:00:00", 6, None), ("s", "2025-01-03 00:00:00", 7, None), ("s", "2025-01-03 00:00:01", 8, "A"), (None, "2025-01-03 00:00:01", 9, "A")]
    log = spark.createDataFrame(rows, "run string, logged_at string, ord long, comment string").withColumn("logged_at", F.to_timestamp("logged_at"))
    got = [(r.run, r.change, r.logged_at.strftime("%m-%d"), r.comment, r.before) for r in catalogue.comment_changes(log).orderBy("run", "change").collect()]
    assert got == [(None, 1, "01-03", "A", None), ("r", 1, "01-01", "A", None), ("r", 2, "01-02", "B", "A"), ("r", 3, "01-05", "A", "B"), ("r", 4, "02-01", None, "A"), ("s", 1, "01-03", None, None), ("s", 2, "01-03", "A", None)]


def test_previous_over_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [("k" if rng.random() < 0.8 else None, n, n // 7 if n < 50 else n // 3, None if rng.random() < 0.3 else int(rng.integers(3))) for n in range(90)]
    df = spark.createDataFrame(rows, "key string, ord long, chunk long, v int")
    got = {r.ord: r.before for r in ordered.previous(df, "v", ["key"], "chunk", "ord", "before").collect()}
    last = {}
    for key, n, _, v in rows:
        assert (got[n] is None) == (key not in last) and (got[n] is None or got[n].value == last[key])
        last[key] = v


def test_small_spread_keeps_its_digits(spark):
    """28 + 1e-7 noise, and another record far from it: the deviation is right to 1e-6."""
    rng = np.random.default_rng(3)
    parts, want = [], {}
    for rec, base in ((0, 28.0), (1, -1500.0), (2, 0.0)):
        x, h = base + 1e-7 * rng.normal(size=(5, 4, 6)), rng.integers(0, 3, (5, 4, 6)) / 2.0
        parts.append(frame(spark, {"THETA": x, "hFacC": h}, rec=rec))
        w = h / h.sum()
        m = (w * (x - base)).sum()
        want[rec] = (base + m, np.sqrt((w * (x - base - m) ** 2).sum()), x[h > 0].min(), x[h > 0].max())
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = stats.field_statistics(cells, grid2d(spark, 4, 6), grid1d(spark, 5), ("THETA",)).collect()
    assert len(got) == 3
    for r in got:
        mean, sd, low, high = want[r.rec]
        assert abs(r.sd / sd - 1) < 1e-6 and abs(r.mean - mean) < 1e-12 * max(1, abs(mean)) and (r.min, r.max) == (low, high)


def test_one_outlier_is_part_of_the_spread(spark):
    x = np.full((5, 4, 6), 28.0)
    x[2, 1, 3] = -1e6
    got = stats.field_statistics(frame(spark, {"THETA": x, "hFacC": np.ones((5, 4, 6))}), grid2d(spark, 4, 6), grid1d(spark, 5), ("THETA",)).first()
    assert abs(got.sd / x.std() - 1) < 1e-9 and abs(got.mean / x.mean() - 1) < 1e-9


def test_long_breakpoint_tables(spark):
    """100,000 breakpoints: the row's cost is their logarithm, the results those of numpy."""
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(10**7, 100_000, replace=False)) / 10.0
    y = rng.normal(size=len(x))
    breaks = spark.createDataFrame([(list(zip(x.tolist(), y.tolist())), (-x).tolist())], "breaks array<struct<x:double,y:double>>, depths array<double>")
    at = np.concatenate([rng.uniform(-10, 1.1e6, 400), x[[0, 1, 500, -2, -1]], [x[0] - 1, x[-1] + 1]])
    rows = spark.createDataFrame([(float(v),) for v in at], "v double").coalesce(1).crossJoin(breaks)
    start = time.perf_counter()
    got = rows.select("v", piecewise_linear("v", "breaks").alias("y"), deepest_above("depths", -F.col("v")).alias("k")).collect()
    assert time.perf_counter() - start < 60
    for r in got:
        assert abs(r.y - np.interp(r.v, x, y)) < 1e-9
        n = int(np.searchsorted(x, r.v))  # levels strictly above
        assert r.k == (n - 1 if n else None)


def test_short_and_odd_breakpoints(spark):
    df = spark.createDataFrame([(1.0, [], []), (1.0, None, None), (None, [(0.0, 1.0)], [-1.0]), (5.0, [(5.0, 2.0)], [-1.0]), (4.0, [(5.0, 2.0)], [-4.0]), (2.0, [(1.0, 0.0), (2.0, 5.0), (2.0, 7.0), (3.0, 9.0)], [-1.0, -2.0, -3.0])],
                               "x double, b array<struct<x:double,y:double>>, d array<double>")
    got = [tuple(r) for r in df.select(piecewise_linear("x", "b").alias("y"), deepest_above("d", -F.col("x")).alias("k")).collect()]
    assert got == [(None, None), (None, None), (None, None), (2.0, 0), (2.0, None), (7.0, 0)]


def test_change_over_run_follows_the_records(spark):
    profile = spark.createDataFrame([("a", r, 0, float(r * r)) for r in range(2, 9)] + [("b", 5, 0, 3.0)], "run string, rec int, k int, x double")
    records = select.index_records(profile.select("run", F.lit("s").alias("stream"), "rec", F.col("rec").cast("bigint").alias("iter")))
    assert {r.run: r.d_x for r in reduce.change_over_run(profile, records, "x", ["run"]).collect()} == {"a": 60.0, "b": 0.0}
    assert select.depth_time_section(profile, "x").columns == ["run", "k", *map(str, range(2, 9))]


def test_side_strips_from_one_scan(spark):
    cells, grid = frame(spark, {"UVEL": np.arange(60.0).reshape(1, 6, 10)}), grid2d(spark, 6, 10)
    rows = select.edge_strips(cells, grid)
    for side in "WESN":
        want = sorted(map(tuple, select.edge_strip(cells, grid, side).select("j", "i", "UVEL", "face").collect()))
        assert sorted(map(tuple, rows.where(F.col("side") == side).select("j", "i", "UVEL", "face").collect())) == want
