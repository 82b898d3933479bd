"""Raw binary field output as a Spark data source with filters turned into byte ranges.

    register(spark)
    spark.read.format("field_files").option("fields", "UVEL,THETA").load("/runs/results")
        .where("run = 'A' and rec = 3 and k < 5")

Planning lists names only: run, stream and iteration come from the path, ``rec`` from the order
of a stream's iterations, so filters on them leave files unopened, headers included.  Each task
opens its file's header and reads, of the listed fields, only the rows that filters on ``k`` and
``j`` leave; those on ``i`` cut the rows in memory.  A long file is cut into several tasks by
its size.  Filters also stay with Spark, which checks them again, so a filter that the source
does not understand costs reading, never rows.

Columns are those of a cell table: ``run, stream, rec, iter, time_s, k, j, i`` and the fields of
option ``fields`` or of a schema given to the reader.  Other options: ``endian``,
``seconds_per_step``, ``run_in_path`` (a pattern with one group) and ``range_bytes``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

from gridspark.functions.names import RUN_IN_PATH
from gridspark.schema import cells_schema
from gridspark.sources.binary import _NUMPY_TYPES, _ORDERS, _arrow_uri

NAME = "field_files"
RANGE_BYTES = 64 << 20
_KEYS = ("run", "stream", "rec", "iter", "k", "j", "i")
_FILE = re.compile(r"([^/]+?)(?:\.([0-9]{10}))?(?:\.[0-9]{3}){0,2}\.meta$")


def _store(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/(?!/)", "file:///", _arrow_uri(path))
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class Wanted:
    """What filters leave of each key column: listed values, and a range of numbers."""

    def __init__(self):
        self.values: dict[str, set] = {}
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.starts: dict[str, list[str]] = defaultdict(list)

    def add(self, found: Filter) -> None:
        column = getattr(found, "attribute", ("",))
        name, value = column[0], getattr(found, "value", None)
        if len(column) != 1 or name not in _KEYS:
            return
        if isinstance(found, (EqualTo, EqualNullSafe)) and value is not None:
            self._listed(name, {value})
        elif isinstance(found, In):
            self._listed(name, set(found.value))
        elif isinstance(found, (GreaterThan, GreaterThanOrEqual)):
            self.low[name] = max(self.low.get(name, value), value)
        elif isinstance(found, (LessThan, LessThanOrEqual)):
            self.high[name] = min(self.high.get(name, value), value)
        elif isinstance(found, StringStartsWith):
            self.starts[name].append(value)

    def _listed(self, name: str, values: set) -> None:
        self.values[name] = self.values.get(name, values) & values

    def takes(self, name: str, value) -> bool:
        """Whether a row with this value can pass; bounds count as inclusive."""
        if name in self.values and value not in self.values[name]:
            return False
        if (name in self.low or name in self.high) and (value is None or value < self.low.get(name, value) or value > self.high.get(name, value)):
            return False
        return all(value is not None and value.startswith(s) for s in self.starts[name])

    def runs(self, name: str, first: int, last: int) -> list[tuple[int, int]]:
        """Ranges of wanted numbers from ``first`` to ``last``, ends included."""
        low, high = max(first, self.low.get(name, first)), min(last, self.high.get(name, last))
        if name not in self.values:
            return [(int(np.ceil(low)), int(np.floor(high)))] if low <= high else []
        out: list[list[int]] = []
        for v in sorted(int(v) for v in self.values[name] if isinstance(v, int) and low <= v <= high):
            if out and out[-1][1] == v - 1:
                out[-1][1] = v
            else:
                out.append([v, v])
        return [tuple(x) for x in out]


class Part(InputPartition):
    """A share of one file: the ``nth`` of ``of``."""

    def __init__(self, meta: str, run: str, stream: str, rec: int, iter_: int | None, nth: int, of: int):
        self.meta, self.run, self.stream, self.rec, self.iter, self.nth, self.of = meta, run, stream, rec, iter_, nth, of


class Header:
    """Precision, fields and tile bounds of a header; the bounds count from 1."""

    def __init__(self, text: str):
        block = lambda name: (re.search(rf"(?s)\b{name}\s*=\s*[\[{{](.*?)[\]}}]", text) or ["", ""])[1]
        numbers = [int(x) for x in re.findall(r"-?[0-9]+", block("dimList"))]
        self.bounds = {a: (numbers[3 * n + 1], numbers[3 * n + 2]) if len(numbers) > 3 * n + 2 else (1, 1) for n, a in enumerate("ijk")}
        self.kind = _NUMPY_TYPES[block("dataprec").strip().strip("'").strip()]
        self.fields = [f.strip() for f in re.findall(r"'\s*(\w+)\s*'", block("fldList"))]


class FieldReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.names
        self.schema = schema
        self.fields = [f.name for f in schema if isinstance(f.dataType, T.DoubleType) and f.name != "time_s"]
        self.path = options["path"]
        self.order = _ORDERS[options.get("endian", "<")]
        self.seconds = float(options.get("seconds_per_step", 1.0))
        self.run_in_path = options.get("run_in_path", RUN_IN_PATH)
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for found in filters:
            self.wanted.add(found)
            yield found

    def _listed(self) -> list[tuple]:
        """(header path, run, stream, iteration, bytes) by name; nothing is opened."""
        from pyarrow import fs

        store, root = _store(self.path)
        prefix = self.path[: -len(root)] if self.path.endswith(root) else ""
        infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        size = {i.path: i.size for i in infos if i.type == fs.FileType.File}
        out = []
        for path in sorted(size):
            name = _FILE.search(path.rsplit("/", 1)[-1])
            data = path[: -len(".meta")] + ".data"
            if name and data in size:
                run = re.search(self.run_in_path, path)
                out.append((prefix + path, run[1] if run else "", name[1], int(name[2]) if name[2] else None, size[data]))
        return out

    def partitions(self) -> list[Part]:
        found = self._listed()
        steps = defaultdict(set)
        for _, run, stream, step, _ in found:
            steps[run, stream].add(step)
        place = {key: {s: n for n, s in enumerate(sorted(x, key=lambda s: (s is not None, s or 0)))} for key, x in steps.items()}
        out = []
        for meta, run, stream, step, size in found:
            rec = place[run, stream][step]
            if all(self.wanted.takes(k, v) for k, v in (("run", run), ("stream", stream), ("rec", rec), ("iter", step))):
                of = max(1, -(-size // self.range_bytes))
                out += [Part(meta, run, stream, rec, step, n, of) for n in range(of)]
        return out

    def ranges(self, header: Header, part: Part) -> list[tuple[int, int, int]]:
        """(level, first row, last row) wanted of a part, from 0; rows of a level that is cut go to several parts."""
        (j0, j1), (k0, k1) = header.bounds["j"], header.bounds["k"]
        i0, i1 = header.bounds["i"]
        row_bytes = (i1 - i0 + 1) * np.dtype(header.kind).itemsize * max(1, len(header.fields))
        rows = max(1, self.range_bytes // row_bytes)
        out = []
        for a, b in self.wanted.runs("k", k0 - 1, k1 - 1):
            for k in range(a, b + 1):
                for c, d in self.wanted.runs("j", j0 - 1, j1 - 1):
                    out += [(k, j, min(j + rows - 1, d)) for j in range(c, d + 1, rows)]
        n = len(out)
        return out[part.nth * n // part.of : (part.nth + 1) * n // part.of]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, meta = _store(partition.meta)
        with store.open_input_file(meta) as file:
            header = Header(file.read().decode("utf-8", "replace"))
        kind = np.dtype(self.order + header.kind)
        (i0, i1), (j0, j1), (k0, k1) = (header.bounds[a] for a in "ijk")
        ni, nj, nk = i1 - i0 + 1, j1 - j0 + 1, k1 - k0 + 1
        across = np.concatenate([np.arange(a, b + 1) for a, b in self.wanted.runs("i", i0 - 1, i1 - 1)] or [np.zeros(0, int)]).astype("i4")
        ranges = self.ranges(header, partition)
        if not ranges or not len(across):
            return
        with store.open_input_file(meta[: -len(".meta")] + ".data") as data:
            for k, a, b in ranges:
                rows, size = b - a + 1, (b - a + 1) * len(across)
                columns = {
                    "run": pa.repeat(pa.scalar(partition.run, pa.string()), size),
                    "stream": pa.repeat(pa.scalar(partition.stream, pa.string()), size),
                    "rec": pa.repeat(pa.scalar(partition.rec, pa.int32()), size),
                    "iter": pa.repeat(pa.scalar(partition.iter, pa.int64()), size),
                    "time_s": pa.repeat(pa.scalar(None if partition.iter is None else partition.iter * self.seconds, pa.float64()), size),
                    "k": pa.repeat(pa.scalar(k, pa.int32()), size),
                    "j": pa.array(np.repeat(np.arange(a, b + 1, dtype="i4"), len(across))),
                    "i": pa.array(np.tile(across, rows)),
                }
                for n, name in enumerate(header.fields or [partition.stream]):
                    if name in self.fields:
                        first = ((n * nk + k - (k0 - 1)) * nj + a - (j0 - 1)) * ni
                        raw = data.read_at(rows * ni * kind.itemsize, first * kind.itemsize)
                        values = np.frombuffer(raw, kind).reshape(rows, ni)[:, across - (i0 - 1)]
                        columns[name] = pa.array(values.astype("f8").ravel(), from_pandas=True)  # NaN is NULL, the missing value
                yield pa.record_batch([columns.get(c, pa.nulls(size, pa.float64())) for c in self.columns], names=self.columns)


class FieldSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return cells_schema([f.strip() for f in self.options.get("fields", "").split(",") if f.strip()])

    def reader(self, schema: T.StructType) -> FieldReader:
        return FieldReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets filters reach it."""
    spark.dataSource.register(FieldSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_fields(spark: SparkSession, path: str, fields: list[str], **options) -> DataFrame:
    """Cells of all raw files below ``path``; filter the result by run, stream, record or place to read only those."""
    register(spark)
    reader = spark.read.format(NAME).option("fields", ",".join(fields))
    return reader.options(**options).load(path)
