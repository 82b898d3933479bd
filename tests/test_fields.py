"""The raw-file data source: rows, and what filters leave unopened."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringStartsWith

from gridspark.schema import cells_schema
from gridspark.sources import binary, fields
from tests.test_sources import write_pair

NK, NJ, NI = 4, 6, 5


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(3)
    for run in ("One", "Two"):
        for step in (10, 30, 20):
            u, t = rng.random((NK, NJ, NI)), rng.random((NK, NJ, NI))
            u[0, 0, 0] = np.nan
            write_pair(f"{root}/results/{run}/input", f"spinup.{step:010d}", [u, t])
        write_pair(f"{root}/results/{run}/input", "Depth", [rng.random((1, NJ, NI))], fields=())
    return str(root)


def reader(folder, *filters, names=("UVEL", "THETA"), **options):
    out = fields.FieldReader(cells_schema(list(names)), {"path": folder, **{k: str(v) for k, v in options.items()}})
    assert list(out.pushFilters(list(filters))) == list(filters)
    return out


def opened(made, monkeypatch):
    """(files opened, bytes read of arrays, rows) of all parts."""
    files, reads = [], []
    store = fields._store

    class Data:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.file.close()

        def read(self):
            return self.file.read()

        def read_at(self, n, at):
            reads.append((at, n))
            return self.file.read_at(n, at)

    class Store:
        def __init__(self, real):
            self.real = real

        def get_file_info(self, x):
            return self.real.get_file_info(x)

        def open_input_file(self, path):
            files.append(os.path.basename(path))
            return Data(self.real.open_input_file(path))

    def counted(path):
        real, root = store(path)
        return Store(real), root

    monkeypatch.setattr(fields, "_store", counted)
    batches = [b for p in made.partitions() for b in made.read(p)]
    monkeypatch.setattr(fields, "_store", store)
    return files, sum(n for _, n in reads), pa.Table.from_batches(batches).to_pylist() if batches else []


def test_same_rows_as_the_eager_reader(spark, folder):
    want = binary.read_stream(spark, f"{folder}/results/*/input/spinup.*.meta", ["UVEL", "THETA"], seconds_per_step=6.2)
    got = fields.read_fields(spark, folder, ["UVEL", "THETA"], seconds_per_step=6.2, range_bytes=300).where("stream = 'spinup'")
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_filters_open_only_what_they_leave(folder, monkeypatch):
    row = NI * 8
    files, read, rows = opened(reader(folder), monkeypatch)
    assert len(files) == 16 and read == 2 * (3 * 2 * NK * NJ) * row  # Depth has neither field
    files, read, rows = opened(reader(folder, EqualTo(("run",), "One"), EqualTo(("stream",), "spinup"), EqualTo(("rec",), 1), LessThan(("k",), 2)), monkeypatch)
    assert sorted(files) == ["spinup.0000000020.data", "spinup.0000000020.meta"]
    assert read == 2 * 3 * NJ * row and {r["iter"] for r in rows} == {20}  # a bound counts as inclusive; Spark checks it again
    files, read, rows = opened(reader(folder, In(("iter",), (10, 30)), In(("j",), (0, 1, 4)), EqualTo(("k",), 3), GreaterThan(("i",), 2), names=["THETA"]), monkeypatch)
    assert len(files) == 8 and read == 4 * 3 * row and {(r["j"], r["i"]) for r in rows} == {(j, i) for j in (0, 1, 4) for i in (2, 3, 4)}
    for nothing in (EqualTo(("run",), "Three"), EqualTo(("rec",), 7), StringStartsWith(("run",), "x"), GreaterThan(("iter",), 99)):
        assert opened(reader(folder, nothing), monkeypatch)[0] == []
    files, read, rows = opened(reader(folder, EqualTo(("stream",), "spinup"), EqualTo(("k",), 9)), monkeypatch)
    assert read == 0 and rows == [] and all(f.endswith(".meta") for f in files)


def test_shares_of_a_file_do_not_overlap(folder, monkeypatch):
    made = reader(folder, EqualTo(("stream",), "spinup"), range_bytes=200)
    parts = made.partitions()
    assert len(parts) == 6 * -(-2 * NK * NJ * NI * 8 // 200)
    _, _, rows = opened(made, monkeypatch)
    assert len(rows) == len({(r["run"], r["rec"], r["k"], r["j"], r["i"]) for r in rows}) == 6 * NK * NJ * NI


def test_filters_of_a_query_reach_the_source(spark, folder, tmp_path):
    """Files that the filter leaves out may be broken: they are never opened."""
    import shutil

    copy = f"{tmp_path}/runs"
    shutil.copytree(folder, copy)
    for run in ("One", "Two"):
        for step in (10, 30):
            open(f"{copy}/results/{run}/input/spinup.{step:010d}.meta", "w").write("broken")
    want = fields.read_fields(spark, folder, ["THETA"]).where("stream = 'spinup' and rec = 1 and k in (0, 2) and j > 3 and THETA > 0.5")
    got = fields.read_fields(spark, copy, ["THETA"]).where("stream = 'spinup' and rec = 1 and k in (0, 2) and j > 3 and THETA > 0.5")
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception):
        fields.read_fields(spark, copy, ["THETA"]).where("stream = 'spinup'").count()


def test_given_schema_and_grid_files(spark, folder):
    fields.register(spark)
    got = spark.read.format(fields.NAME).schema("run string, stream string, j int, i int, Depth double").load(folder).where("stream = 'Depth'")
    assert got.count() == 2 * NJ * NI and got.where("Depth is null").count() == 0
