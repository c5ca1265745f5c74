"""JSON collections as a Spark format: spark.read, readStream and write.format("json_collection").

A collection file is an array of objects, an object that wraps one, or one object a line.  Files of lines are read in ranges of bytes, so that a
large one has many tasks; others are one task each.  Only the fields of the schema are taken from the objects.  A stream's offset is
the place of the last file in order of their time and name.  A write puts each task's lines into a hidden file; the commit moves
them to their names, and a write that fails leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys that an object wraps its rows in, fixed values, tried in this order.
WRAPPERS = ("sources", "bookSources", "feeds", "items", "data", "list")
SPLIT, ROWS = 16 << 20, 5000
_DEFAULT = "name string, url string, `group` string, enabled boolean"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    stop: int = -1  # -1: the whole file


@dataclass
class Written(WriterCommitMessage):
    hidden: str = ""  # both blank: the task had no rows
    name: str = ""


def files_of(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of the collection files of a folder, or of the one file, in order of time and name."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no collection at {path}")
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def _by_lines(fs: pafs.FileSystem, path: str) -> bool:
    """Whether a file has one object a line: it begins with one whose line can be read alone and is no wrapper."""
    with fs.open_input_stream(path) as f:
        head = f.read(1 << 20).lstrip()
    if head[:1] != b"{":
        return False
    line = head.split(b"\n", 1)[0]
    try:
        one = json.loads(line)
    except ValueError:
        return False
    return not any(isinstance(one.get(k), list) for k in WRAPPERS)


def parts_of(path: str, files: list[tuple[int, str, int]], split: int) -> list[Part]:
    fs, _ = opened(path)
    out = []
    for _, file, size in files:
        if size > split and _by_lines(fs, file):
            out += [Part(file, a, min(a + split, size)) for a in range(0, size, split)]
        else:
            out.append(Part(file))
    return out


def _lines(f, start: int, stop: int) -> Iterator[bytes]:
    """The lines that begin in [start, stop)."""
    f.seek(max(0, start - 1))
    held, at = b"", max(0, start - 1)
    skip = start > 0  # up to the first line's beginning
    while True:
        more = f.read(1 << 20)
        held += more
        cut = 0
        while (end := held.find(b"\n", cut)) >= 0:
            if skip:
                skip = False
            elif at + cut < stop:
                yield held[cut:end]
            cut = end + 1
            if at + cut >= stop:
                return
        held, at = held[cut:], at + cut
        if not more:
            if held and not skip and at < stop:
                yield held
            return


def objects(path: str, part: Part) -> Iterator[dict]:
    fs, _ = opened(path)
    with fs.open_input_file(part.path) as f:
        if part.stop >= 0 or _by_lines(fs, part.path):
            size = part.stop if part.stop >= 0 else f.size()
            rows = (json.loads(x) for x in _lines(f, part.start, size) if x.strip())
        else:
            said = f.read()
            rows = json.loads(said) if said.strip() else []
            if isinstance(rows, dict):
                rows = next((rows[k] for k in WRAPPERS if isinstance(rows.get(k), list)), [rows])
        for row in rows:
            if isinstance(row, dict):
                yield row


def value(x, kind: T.DataType):
    """A JSON value as a field of the schema; what does not fit is null, objects are their text where a text is asked for."""
    try:
        if x is None:
            return None
        if isinstance(kind, T.StringType):
            return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        if isinstance(kind, T.BooleanType):
            return x if isinstance(x, bool) else {"true": True, "false": False}.get(str(x).lower())
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return int(x)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(x)
        if isinstance(kind, T.ArrayType):
            return [value(v, kind.elementType) for v in x] if isinstance(x, list) else None
    except (TypeError, ValueError):
        return None
    raise TypeError(f"{kind.simpleString()} is no type of a collection's field")


def batches(path: str, part: Part, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow, rows = to_arrow_schema(schema), []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

    for row in objects(path, part):
        rows.append([value(row.get(f.name), f.dataType) for f in schema])
        if len(rows) >= ROWS:
            yield out()
            rows = []
    if rows:
        yield out()


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, schema: T.StructType):
        self.path, self.split, self.schema = path, split, schema

    def partitions(self) -> list[Part]:
        return parts_of(self.path, files_of(self.path), self.split) or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches(self.path, partition, self.schema)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, split: int, schema: T.StructType):
        self.path, self.split, self.schema = path, split, schema

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = files_of(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        of = lambda o: (o["time"], o["path"])
        return parts_of(self.path, [f for f in files_of(self.path) if of(start) < f[:2] <= of(end)], self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.run = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        hidden, n = f"{at}/_{self.run}-{name}", 0
        with fs.open_output_stream(hidden) as f:
            for row in iterator:
                said = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
                f.write((json.dumps(said, ensure_ascii=False) + "\n").encode())
                n += 1
        if not n:
            fs.delete_file(hidden)
            return Written()
        return Written(hidden, f"{at}/part-{self.run}-{name}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        old = [f for _, f, _ in files_of(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.hidden:
                fs.move(m.hidden, m.name)
        for f in old:
            fs.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove the hidden files of this run, those of tasks that failed half-way too."""
        fs, at = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                fs.delete_file(f.path)


class JsonCollection(DataSource):
    """Options: path, and split (bytes of a file of lines that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "json_collection"

    def schema(self) -> str:
        return _DEFAULT

    def _split(self) -> int:
        return int(self.options.get("split", SPLIT))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._split(), schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._split(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonCollection)
