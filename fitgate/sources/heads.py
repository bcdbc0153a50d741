"""File heads: a data source that lists files and reads no more than the first bytes of each.

``read_heads(spark, folder)``, or ``spark.dataSource.register(FileHeads)`` and ``spark.read.format("file_heads").option("bytes", 65536).load(folder)``. Files are dealt out to
partitions by what is read of them, so a file of a gigabyte weighs as much as one of 256 KiB. Filters on size and name are answered from the listing: what
they exclude is not opened.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, size long, modified timestamp, head binary, error string"
#: Fixed value: what a check of a file's header reads.
HEAD_BYTES = 256 * 1024
#: What a partition reads, about; what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 64 << 10

_TESTS = {
    EqualTo: lambda a, v: a == v,
    In: lambda a, v: a in v,
    GreaterThan: lambda a, v: a > v,
    GreaterThanOrEqual: lambda a, v: a >= v,
    LessThan: lambda a, v: a < v,
    LessThanOrEqual: lambda a, v: a <= v,
    StringStartsWith: lambda a, v: a.startswith(v),
    StringEndsWith: lambda a, v: a.endswith(v),
}


class Heads(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, int]]):
        self.files = files


class HeadsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"], options.get("glob", "*")
        self.bytes = int(options.get("bytes", HEAD_BYTES))
        if self.bytes < 0:
            raise ValueError("bytes must not be negative")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if type(f) in _TESTS and len(f.attribute) == 1 and (column == "size" or column == "name"):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _wanted(self, name: str, size: int) -> bool:
        facts = {"name": name, "size": size}
        return fnmatch.fnmatchcase(name, self.glob) and all(_TESTS[kind](facts[column], value) for column, kind, value in self.tests)

    def _files(self) -> list[tuple[str, str, int, int]]:
        system, root = _filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.base_name, f.size, f.mtime_ns // 1000) for f in found if f.type == fs.FileType.File and self._wanted(f.base_name, f.size))

    def partitions(self) -> list[InputPartition]:
        parts: list[list] = [[]]
        weight = 0
        for f in self._files():
            weight += OPEN_BYTES + min(f[2], self.bytes)
            if parts[-1] and weight > PARTITION_BYTES:
                parts.append([])
                weight = OPEN_BYTES + min(f[2], self.bytes)
            parts[-1].append(f)
        return [Heads(p) for p in parts]

    def read(self, partition: Heads) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.folder)
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("head", pa.binary()), ("error", pa.string())])
        rows: list[tuple] = []
        held = 0
        for path, name, size, modified in partition.files:
            head, error = b"", None
            try:
                if size and self.bytes:
                    with system.open_input_file(path) as file:
                        head = file.read_at(min(size, self.bytes), 0)
            except OSError as e:  # a file that went meanwhile, or may not be read, is a row too
                head, error = None, type(e).__name__
            rows.append((path, name, size, modified, head, error))
            held += len(head or b"")
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("file:///", "/", 1) if folder.startswith("file:///") else folder)


class FileHeads(DataSource):
    """Rows of SCHEMA, one for every file below ``path``, empty ones too. Options: bytes (how much of each file), glob (of names)."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadsReader:
        return HeadsReader(self.options)


def read_heads(spark: SparkSession, folder: str, most: int = HEAD_BYTES, glob: str = "*") -> DataFrame:
    """Rows of SCHEMA for the files below a folder. Switches the session to handing filters on to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", most).option("glob", glob).load(folder)
