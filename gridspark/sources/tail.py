"""Streaming source for log files that keep growing.

The file source reads a file once; this one remembers how far each file was read.  Offsets
are complete lines in bytes by file, so a line still being written waits for its end.  New
bytes are cut into ranges that tasks read on their own; a task owns the lines that start in
its range, and hands them on as Arrow batches.

A trigger lists names, sizes and times and opens only files that changed since the last one.
A file is told by its name and a digest of its first bytes: one that was rotated is read
from its start, whether it is now shorter or longer than what was read of its predecessor.

``bytes_per_trigger`` limits a batch: files take turns by name, over batches, until the limit is spent,
and each takes whole lines.  After a restart the limit goes on where the last batch ended if ``progress``
names a folder for that; without it the first batch after a restart takes all there is, as
Spark does not tell a source where it was before it asks for the next offset.  With a limit,
use a processing-time trigger: "available now" asks for one offset and stops there.

    register(spark)
    spark.readStream.format("growing_logs").option("path", folder).load()
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridspark.functions.names import RUN_IN_PATH, run_of_path

NAME = "growing_logs"
RANGE_BYTES = 8 << 20
HEAD_BYTES = 1024  #: bytes that tell a file from its successor of the same name
_BACK = 1 << 16
_BATCH = 1 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


def _whole_lines(file, size: int, low: int = 0) -> int:
    """Bytes up to the last line end before ``size``, not below ``low``."""
    end = size
    while end > low:
        start = max(low, end - _BACK)
        at = file.read_at(end - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return low


def _next_line(file, at: int, size: int) -> int:
    """Bytes up to the first line end from ``at`` on, or ``at`` where there is none."""
    here = at
    while here < size:
        piece = file.read_at(min(_BACK, size - here), here)
        found = piece.find(b"\n")
        if found >= 0:
            return here + found + 1
        here += len(piece)
    return at


def _digest(file, n: int) -> str:
    return hashlib.md5(file.read_at(n, 0)).hexdigest()


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class TailReader(DataSourceStreamReader):
    """Offsets are ``{file: [bytes, head bytes, digest of the head]}``."""

    def __init__(self, path: str, pattern: str = ".", range_bytes: int = RANGE_BYTES, bytes_per_trigger: int | None = None, progress: str | None = None):
        self.path, self.pattern, self.range_bytes, self.limit, self.progress = path, pattern, range_bytes, bytes_per_trigger, progress
        self.current: dict | None = None  # the last offset known to be planned
        self.listed: dict[str, tuple] = {}  # size and time at the last look, where nothing was left over
        self.turn = ""  # the last file that used up a limit

    # what was planned, over restarts

    def _remembered(self) -> dict | None:
        from pyarrow import fs

        if self.progress is None:
            return None
        store, root = _store(self.progress)
        names = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.path.endswith(".json")]
        if not names:
            return None
        with store.open_input_file(max(names)) as file:
            return json.loads(file.read())

    def _remember(self, end: dict) -> None:
        from pyarrow import fs

        if self.progress is None:
            return
        store, root = _store(self.progress)
        store.create_dir(root, recursive=True)
        old = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(".json"))
        number = int(old[-1].rsplit("/", 1)[-1][:12]) + 1 if old else 0
        with store.open_output_stream(f"{root}/{number:012d}.tmp") as file:
            file.write(json.dumps(end).encode())
        store.move(f"{root}/{number:012d}.tmp", f"{root}/{number:012d}.json")
        for path in old[:-1]:
            store.delete_file(path)

    # the source's interface

    def initialOffset(self) -> dict:
        self.current = {}
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        limit = self.limit
        if self.current is None:
            self.current = self._remembered()
            if self.current is None:
                self.current, limit = {}, None
        store, root = _store(self.path)
        out, left = dict(self.current), limit
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda i: (i.path <= self.turn, i.path)):
            if info.type != fs.FileType.File or not re.search(self.pattern, info.path):
                continue
            seen = (info.size, info.mtime_ns)
            if self.listed.get(info.path) == seen and info.path in self.current:
                continue
            if left is not None and left <= 0:
                break
            with store.open_input_file(info.path) as file:
                at, head, digest = self.current.get(info.path, (0, 0, ""))
                if at > info.size or head > info.size or at and _digest(file, head) != digest:
                    at, head, digest = 0, 0, ""  # another file under this name
                want = info.size if left is None else min(info.size, at + left)
                stop = _whole_lines(file, want, at)
                if stop == at and want < info.size:
                    stop = _next_line(file, want, info.size)  # a line longer than the limit
                    stop = at if stop == want else stop
                if stop > at and head < HEAD_BYTES:  # the longer head of the same file
                    head = min(HEAD_BYTES, stop)
                    digest = _digest(file, head)
            out[info.path] = [stop, head, digest]
            if left is not None and stop > at:
                left, self.turn = left - (stop - at), info.path
            if want == info.size:  # nothing but an unfinished line is left
                self.listed[info.path] = seen
            else:
                self.listed.pop(info.path, None)
        self.current = out
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.current = end
        self._remember(end)
        store, _ = _store(self.path)
        out = []
        for name, (stop, _, digest) in sorted(end.items()):
            low, head, old = start.get(name, (0, 0, ""))
            if low and old != digest:  # a head that grew, or another file
                with store.open_input_file(name) as file:
                    low = low if file.size() >= head and _digest(file, head) == old else 0
            out += [_Range(name, at, min(at + self.range_bytes, stop)) for at in range(low, stop, self.range_bytes)]
        return out

    def read(self, partition: _Range):
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as file:
            size, at = file.size(), partition.start
            if at > 0 and file.read_at(1, at - 1) != b"\n":  # the line before the range is another task's
                at = _next_line(file, at, size)
                if at == partition.start:
                    return
            while at < partition.stop:
                stop = _whole_lines(file, min(at + _BATCH, size), at)
                if stop == at:  # a line longer than a batch
                    stop = _next_line(file, at, size)
                    if stop == at:
                        return
                lines = file.read_at(stop - at, at).split(b"\n")[:-1]
                starts, place = [], at
                for line in lines:
                    starts.append(place)
                    place += len(line) + 1
                own = sum(s < partition.stop for s in starts)
                yield pa.record_batch(
                    [pa.array([partition.file] * own, pa.string()), pa.array(starts[:own], pa.int64()), pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines[:own]], pa.string())],
                    names=["file", "start", "value"],
                )
                at = stop


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, start bigint, value string"

    def streamReader(self, schema) -> TailReader:
        limit = self.options.get("bytes_per_trigger")
        return TailReader(self.options["path"], self.options.get("pattern", "."), int(self.options.get("range_bytes", RANGE_BYTES)), int(limit) if limit else None, self.options.get("progress"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def growing_lines(spark: SparkSession, path: str, run_in_path: str = RUN_IN_PATH, pattern: str = ".", **options) -> DataFrame:
    """Lines of growing logs as a stream, with their run and an order that holds over batches."""
    register(spark)
    lines = spark.readStream.format(NAME).option("path", path).option("pattern", pattern).options(**options).load()
    return lines.select(run_of_path("file", run_in_path).alias("run"), "value", F.struct("file", "start").alias("ord"))
