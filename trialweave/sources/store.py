"""Run directories as a data source of Spark: ``spark.read.format("runs").load(path)``, and the same to write.

A store is a folder of runs, each with its ``records*.jsonl``. Reading, a task takes a piece of
a file (``SPLIT`` bytes, cut at line ends); filters on run_id keep whole directories from being
listed (with ``spark.sql.python.filterPushdown.enabled``). Lines that are blank, torn or foreign
are left out, unknown fields dropped and missing ones filled, as runs.read_records() does.

Writing, each task writes a file of its own for each run that it meets, under a name that
readers pass over; the driver renames them when all tasks are done, so that a task that is
lost, or tried again, leaves no record twice. ``overwrite`` replaces the runs that are written.

Paths are what pyarrow opens: a local folder that all machines share, or a URI of a store that
it knows. register() makes the name known to a session.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from .runs import DEFAULTS, RECORD

#: Bytes of a file that a task reads, and records in a batch.
SPLIT, BATCH = 64 << 20, 4096
_FILES, _UNDONE = "records*.jsonl", "_undone-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def allowed(run_id: str, filters: Iterable[Filter]) -> bool:
    """Whether a run can have records that pass filters on run_id."""
    tests = {
        EqualTo: lambda f: run_id == f.value, EqualNullSafe: lambda f: run_id == f.value, In: lambda f: run_id in f.value, StringStartsWith: lambda f: run_id.startswith(f.value),
        GreaterThan: lambda f: run_id > f.value, GreaterThanOrEqual: lambda f: run_id >= f.value, LessThan: lambda f: run_id < f.value, LessThanOrEqual: lambda f: run_id <= f.value,
    }
    return all(tests[type(f)](f) for f in filters)


@dataclass
class Piece(InputPartition):
    """Bytes start to stop of a file: the lines that begin among them."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def lines_of(file: Any, start: int, stop: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The lines that begin at start or after it and before stop."""
    at, rest = max(0, start - 1), b""  # from the byte before: a line begins at start if that is a line end
    file.seek(at)
    skip = start > 0
    while True:
        data = file.read(chunk)
        *whole, rest_of = (rest + data).split(b"\n")
        for line in whole:
            begins, at = at, at + len(line) + 1
            if skip:
                skip = False
                continue
            if begins >= stop:
                return
            yield line
        rest = rest_of
        if not data:
            if rest and not skip and at < stop:
                yield rest
            return
        if at >= stop and not skip:
            return


def record_of(line: bytes, schema: StructType) -> dict[str, Any] | None:
    """A line's record with the fields of schema; None if it is none."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    if not isinstance(found, dict) or found.get("run_id") is None:
        return None
    row = {}
    for field in schema.fields:
        value = found.get(field.name)
        if isinstance(field.dataType, StringType) and not isinstance(value, str | None):
            value = json.dumps(value, ensure_ascii=False)  # its JSON, as Spark's reader has it
        row[field.name] = DEFAULTS.get(field.name) if value is None else value
    if "tags" in row:
        row["tags"] = row["tags"] or []
    if "components" in row:
        detail = lambda d: d if d is None or isinstance(d, str) else json.dumps(d, ensure_ascii=False)
        row["components"] = [{**c, "detail": detail(c.get("detail"))} for c in row["components"] or [] if isinstance(c, dict)]
    return row


class RunReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on run_id choose directories; all are left to Spark, which looks at each record."""
        kinds = (EqualTo, EqualNullSafe, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.filters = [f for f in filters if isinstance(f, kinds) and tuple(f.attribute) == ("run_id",)]
        return filters

    def partitions(self) -> list[Piece]:
        files, root = opened(self.path)
        out = []
        for run in files.get_file_info(fs.FileSelector(root)):
            if run.type != fs.FileType.Directory or not allowed(run.base_name, self.filters):
                continue
            for f in files.get_file_info(fs.FileSelector(run.path)):
                if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, _FILES):
                    out += [Piece(f.path, at, min(f.size, at + SPLIT)) for at in range(0, f.size, SPLIT)]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        files, _ = opened(self.path)
        with files.open_input_file(partition.path) as file:
            held: list[dict[str, Any]] = []
            for line in lines_of(file, partition.start, partition.stop):
                if (row := record_of(line, self.schema)) is not None:
                    held.append(row)
                if len(held) == BATCH:
                    yield from _batches(held, schema)
                    held = []
            yield from _batches(held, schema)


def _batches(rows: list[dict[str, Any]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows as a batch; a row whose values have other types is left out, as Spark's own reader does."""
    if not rows:
        return
    try:
        yield pa.RecordBatch.from_pylist(rows, schema)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        if len(rows) > 1:
            yield from _batches(rows[: len(rows) // 2], schema)
            yield from _batches(rows[len(rows) // 2 :], schema)


@dataclass
class Written(WriterCommitMessage):
    """(folder, name) of the files that a task has written."""

    files: list[tuple[str, str]]


class RunWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        name, sinks = f"records-{uuid.uuid4().hex}.jsonl", {}
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    run = row["run_id"]
                    if not run or "/" in run or run in (".", ".."):
                        raise ValueError(f"{run!r} can't name a run's folder")
                    if run not in sinks:
                        files.create_dir(f"{root}/{run}")
                        sinks[run] = files.open_output_stream(f"{root}/{run}/{_UNDONE}{name}")
                    sinks[run].write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
        finally:
            for sink in sinks.values():
                sink.close()
        return Written([(f"{root}/{run}", name) for run in sinks])

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        done = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for folder in {folder for folder, _ in done}:
                for f in files.get_file_info(fs.FileSelector(folder)):
                    if fnmatch.fnmatch(f.base_name, _FILES):
                        files.delete_file(f.path)
        for folder, name in done:
            files.move(f"{folder}/{_UNDONE}{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        for folder, name in (f for m in messages if m is not None for f in m.files):
            files.delete_file(f"{folder}/{_UNDONE}{name}")


class RunStore(DataSource):
    """Records of the runs in a folder."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return RECORD

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a store needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if "run_id" not in schema.fieldNames():
            raise ValueError("records have a run_id")
        return RunWriter(self._path(), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``runs`` known to a session, and lets its filters choose directories."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunStore)
