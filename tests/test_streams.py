"""Stateful streams over batches, limits and rotation of growing logs."""

import os

import pytest
from pyspark.sql import functions as F

from gridspark.operators import monitor
from gridspark.sources import tail
from gridspark.sources.tail import TailReader
from gridspark.streaming import blocks, jobs, live, restarts

BLOCKS = ["time_tsnumber", "time_secondsf", "advcfl_uvel_max"]


def values(reader, start, end):
    return [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b["value"].to_pylist()]


def test_rotation_by_a_larger_file(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("".join(f"old {n}\n" for n in range(50)))
    reader = TailReader(str(tmp_path))
    first = reader.latestOffset()
    assert len(values(reader, {}, first)) == 50
    new = "".join(f"new line {n}\n" for n in range(500))
    log.write_text(new)
    second = reader.latestOffset()
    assert values(reader, first, second) == new.splitlines()
    log.write_text("short\n")
    third = reader.latestOffset()
    assert values(reader, second, third) == ["short"]
    with log.open("a") as more:
        more.write("and more\n" * 300)
    assert values(reader, third, reader.latestOffset()) == ["and more"] * 300
    assert values(TailReader(str(tmp_path)), third, TailReader(str(tmp_path)).latestOffset()) == ["and more"] * 300  # another head, the same file


def test_limit_takes_turns_and_whole_lines(tmp_path):
    want = {}
    for name in "abc":
        want[name] = [f"{name}{n} {'x' * (n % 29)}" for n in range(200)] + ["y" * 900, "end"]
        (tmp_path / name).write_text("\n".join(want[name]) + "\nunfinished")
    reader = TailReader(str(tmp_path), bytes_per_trigger=700)
    start, got, batches = reader.initialOffset(), {n: [] for n in "abc"}, 0
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        assert sum(p.stop - p.start for p in parts) <= 700 + 901
        for p in parts:
            for b in reader.read(p):
                got[os.path.basename(p.file)] += b["value"].to_pylist()
        start, batches = end, batches + 1
    assert got == want and batches > 15
    assert len({os.path.basename(f) for f in end}) == 3


def test_unchanged_files_are_not_opened(tmp_path, monkeypatch):
    for n in range(10_000):
        (tmp_path / f"{n:05d}.log").write_text(f"line {n}\n")
    reader = TailReader(str(tmp_path))
    end = reader.latestOffset()
    assert len(end) == 10_000
    opened, real = [], tail._store

    class Store:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, x):
            return self.store.get_file_info(x)

        def open_input_file(self, path):
            opened.append(path)
            return self.store.open_input_file(path)

    monkeypatch.setattr(tail, "_store", lambda path: (Store(real(path)[0]), real(path)[1]))
    assert reader.latestOffset() == end and opened == []
    with (tmp_path / "00007.log").open("a") as more:
        more.write("another\n")
    after = reader.latestOffset()
    assert len(opened) == 1 and after != end
    assert [(os.path.basename(p.file), p.start) for p in reader.partitions(end, after)] == [("00007.log", 7)]


def test_progress_keeps_the_limit_over_a_restart(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a").write_text("".join(f"{n:09d}\n" for n in range(1000)))
    make = lambda: TailReader(str(tmp_path / "logs"), bytes_per_trigger=1000, progress=str(tmp_path / "seen"))
    reader = make()
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert values(reader, start, end) == [f"{n:09d}" for n in range(100)]
    again = make()  # Spark goes on from `end` and does not ask for an initial offset
    after = again.latestOffset()
    assert values(again, end, after) == [f"{n:09d}" for n in range(100, 200)]
    assert len(os.listdir(tmp_path / "seen")) <= 2
    blind = TailReader(str(tmp_path / "logs"), bytes_per_trigger=1000)
    assert len(values(blind, after, blind.latestOffset())) == 800  # takes all that is there, loses and repeats nothing


def log_of(run, cut):
    lines = []
    for b in range(1, 6):
        lines.append(f"%MON time_tsnumber = {b}")
        lines += [f"%MON time_secondsf = {b * 10}.0E+00", "other text", f"%MON advcfl_uvel_max = {b}.5E-01"]
    return lines


@pytest.mark.parametrize("size", [1, 3, 7])
def test_blocks_cut_over_batches(spark, tmp_path, size):
    """However the log is cut, each block gives one row with all of its metrics."""
    source = tmp_path / "in"
    for n, at in enumerate(range(0, 20, size)):
        rows = [(run, f"{k:05d}", v) for run in ("A", "B") for k, v in list(enumerate(log_of(run, size)))[at : at + size]]
        spark.createDataFrame(rows, "run string, ord string, value string").repartition(2).write.parquet(f"{source}/{n:03d}")
    lines = spark.readStream.schema("run string, ord string, value string").option("maxFilesPerTrigger", 2).option("latestFirst", "false").parquet(f"{source}/*")
    updates = live.drain(blocks.stream_blocks(monitor.metrics(lines), BLOCKS), "cut-blocks", mode="update", timeouts=True)
    got = sorted(map(tuple, blocks.whole_blocks(updates, BLOCKS).collect()))
    assert [x[:2] for x in got] == [(r, float(b)) for r in "AB" for b in range(1, 6)]
    assert all(x[2] == x[1] and x[3] == 10 * x[1] and abs(x[4] - (x[1] / 10 + 0.05)) < 1e-12 for x in got)


def test_lines_before_the_first_block_have_none(spark, tmp_path):
    rows = [("A", "1", "%MON time_secondsf = 5.0"), ("A", "2", "%MON time_tsnumber = 3"), ("A", "3", "%MON time_tsnumber = broken"), ("A", "4", "%MON time_secondsf = 7.0")]
    spark.createDataFrame(rows, "run string, ord string, value string").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("run string, ord string, value string").parquet(str(tmp_path / "in"))
    updates = live.drain(blocks.stream_blocks(monitor.metrics(lines), BLOCKS), "no-block", mode="update", timeouts=True)
    assert [tuple(r) for r in blocks.whole_blocks(updates, BLOCKS[:2]).collect()] == [("A", 3.0, 3.0, 7.0)]


def arrivals(spark, path, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "run string, iter bigint, time_s double, segment int").coalesce(1).write.parquet(f"{path}/{n:03d}")
        for f in os.listdir(f"{path}/{n:03d}"):
            os.utime(f"{path}/{n:03d}/{f}", (1000 + n, 1000 + n))
    return spark.readStream.schema("run string, iter bigint, time_s double, segment int").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_later_segment_wins_by_each_runs_own_clock(spark, tmp_path):
    """A slow run beside a fast one loses nothing; a record is held until its run is past the overlap."""
    batches = [
        [("fast", i, i * 60.0, 0) for i in range(100)] + [("slow", 0, 0.0, 0), ("slow", 1, 60.0, 0)],
        [("slow", 2, 120.0, 0), ("slow", 3, 180.0, 0), ("fast", 97, 97 * 60.0, 1), ("fast", 98, 98 * 60.0, 1)],
        [("slow", 2, 120.0, 1), ("slow", 3, 180.0, 1), ("slow", 4, 240.0, 1), ("fast", 10, 600.0, 1)],  # the last is long decided
        [("slow", None, None, None)],
    ]
    winners = restarts.winning_records(arrivals(spark, tmp_path / "in", batches))
    got = sorted((r.run, r.iter, r.segment) for r in live.drain(winners, "winners", timeouts=True).collect())
    slow = [("slow", 0, 0), ("slow", 1, 0), ("slow", 2, 1), ("slow", 3, 1), ("slow", 4, 1)]
    assert got == [("fast", i, 0) for i in range(97)] + slow  # 97 to 99 are held: the run has not ended


def test_decided_cells_come_once(spark, tmp_path):
    batches = [[("r", i, i * 100.0, 0) for i in range(4)], [("r", i, i * 100.0, 1) for i in range(2, 6)], [("r", None, None, None)]]
    cells = spark.createDataFrame([("r", i, s, k, i + 10.0 * s) for s, span in ((0, range(4)), (1, range(2, 6))) for i in span for k in range(3)], "run string, iter bigint, segment int, k int, x double")
    out = restarts.decided_cells(restarts.winning_records(arrivals(spark, tmp_path / "in", batches)), cells, "decided")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(("r", i, int(i > 1), k, i + 10.0 * (i > 1)) for i in range(6) for k in range(3))
    assert out.where(F.col("k") == 0).count() == 6


def test_a_job_that_never_reports(spark, tmp_path):
    """Reports in time join, late ones do not, and a silent job is put out once its delay has passed."""
    at = lambda h, m=0: f"2025-01-01 {h:02d}:{m:02d}:00"

    def arrive(name, n, rows, schema, ts):
        df = spark.createDataFrame(rows, schema)
        df.withColumn(ts, F.to_timestamp(ts)).coalesce(1).write.parquet(f"{tmp_path}/{name}/{n}")
        for f in os.listdir(f"{tmp_path}/{name}/{n}"):
            os.utime(f"{tmp_path}/{name}/{n}/{f}", (1000 + n, 1000 + n))

    job, report = "run string, job_id string, logged_at string", "job_id string, state string, reason string, exit_code string, elapsed string, reported_at string"
    arrive("jobs", 0, [("r", "1", at(0)), ("r", "2", at(0)), ("r", "3", at(0)), ("r", "4", at(0, 30))], job, "logged_at")
    arrive("reports", 0, [("1", "RUNNING", "x", "0:0", "1", at(0, 5)), ("1", "COMPLETED", "x", "0:0", "2", at(1))], report, "reported_at")
    arrive("jobs", 1, [("r", "9", at(12))], job, "logged_at")
    arrive("reports", 1, [("2", "COMPLETED", "x", "0:0", "1", at(1, 59)), ("3", "COMPLETED", "x", "0:0", "1", at(3)), ("x", "FAILED", "x", "1:0", "1", at(12))], report, "reported_at")
    read = lambda name, schema, ts: spark.readStream.schema(schema.replace(f"{ts} string", f"{ts} timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    out = live.drain(jobs.job_reports(read("jobs", job, "logged_at"), read("reports", report, "reported_at")), "reports")
    assert sorted((r.job_id, r.state) for r in out.collect() if r.state) == [("1", "COMPLETED"), ("1", "RUNNING"), ("2", "COMPLETED")]
    assert sorted(r.job_id for r in out.collect() if r.state is None) == ["3", "4"]  # 9 is still within its delay


def test_arrivals_come_in_order_of_time_over_batches(spark, tmp_path):
    """Rows written in any order arrive by time, a few files a batch, and none comes too late for a watermark."""
    rows = spark.range(400).selectExpr("id", "timestamp_seconds(3600 * (1 + pmod(id * 37, 400))) AS at")
    live.write_arrivals(rows, f"{tmp_path}/in/0", "at", 20)
    stream = live.arrivals(spark, f"{tmp_path}/in", "id long, at timestamp", 4)
    out = live.drain(stream.withWatermark("at", "1 minute").dropDuplicatesWithinWatermark(["id"]), "by-time", mode="update")
    batches = out.groupBy("batch").agg({"at": "min", "id": "count"}).orderBy("batch").collect()
    assert len(batches) == 5 and [r["min(at)"] for r in batches] == sorted(r["min(at)"] for r in batches)
    assert sum(r["count(id)"] for r in batches) == 400


def test_logged_jobs_arrive_in_several_batches(spark, tmp_path, monkeypatch):
    """The join's state is cleared between batches: there are several, whatever the number of jobs."""
    from gridspark.plans import tables, times

    monkeypatch.setattr(times, "JOBS_PER_FILE", 30)
    monkeypatch.setattr(times, "FILES_PER_BATCH", 1)
    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "timestamp'2020-01-01' + make_interval(0, 0, 0, CAST(pmod(id * 37, 100) AS INT)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    out = times.streaming_reports(tables.Tables(spark, str(tmp_path)))
    assert out.count() == 150  # 0 to 3 jobs an order
    assert {r.n for r in out.where("state IS NOT NULL").selectExpr("CAST(job_id AS BIGINT) div 3 % 5 AS n").collect()} == {0, 1, 2}
    folder = next(p for k, p in tables._written.items() if k[1:] == (str(tmp_path), "job_arrivals"))
    assert len(live._data_files(spark, f"{folder}/jobs/0")) > 5


def test_a_long_batch_of_lines_is_held_as_numbers_and_arrow_text():
    """Lines of metrics that are not asked for, and those without a value, are not held at all."""
    import pandas as pd

    batch = pd.DataFrame({"run": "A", "metric": ["x", "time_tsnumber", "time_secondsf", "time_secondsf"], "value": [1.0, 2.0, None, 3.0], "ord": ["4", "3", "2", "1"]})
    rows = blocks._in_order(iter([batch, batch.iloc[:1]]), ["time_secondsf", "time_tsnumber"])
    assert rows.to_pydict() == {"metric": [0, 1], "value": [3.0, 2.0], "ord": ["1", "3"]}
