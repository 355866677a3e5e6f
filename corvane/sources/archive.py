"""The evidence archive as a data source: objects named evidence/{source}/{day}/sha256/{prefix}/{digest}.

Batch reads have a partition for each source, day and digest prefix; conditions on source_id, day and digest choose the folders before
any object is looked at. Streaming reads have the newest time of a change as offset: objects are created once and never changed, so an
offset that is replayed gives the same objects. Folders are reached by pyarrow's file systems, wherever the archive's URI is.

    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("evidence_archive").load("hdfs://host/archive").where("day >= '2026-01-02'")
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "source_id string, day string, digest string, path string, length bigint, intact boolean, content binary"
DAY, PREFIX, DIGEST = re.compile(r"\d{4}-\d{2}-\d{2}"), re.compile("[0-9a-f]{2}"), re.compile("[0-9a-f]{64}")
#: Bytes of objects that are handed on together.
TOGETHER = 16 << 20


@dataclass
class Folder(InputPartition):
    """Objects of a source, day and digest prefix that changed after one time, up to another (nanoseconds)."""

    source: str
    day: str
    prefix: str
    after: int = -1
    upto: int = 1 << 62


class Archive:
    """Lists and reads an archive's folders; `tests` say for a column which values are wanted."""

    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.tests: dict[str, list] = {"source_id": [], "day": [], "digest": []}

    def open(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        return files, f"{root.rstrip('/')}/evidence"

    def wanted(self, column: str, value: str) -> bool:
        return all(test(value) for test in self.tests[column])

    def folders(self) -> Iterator[tuple[str, str, str]]:
        files, root = self.open()
        names = lambda path: sorted(i.base_name for i in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.Directory)
        for source in names(root):
            for day in names(f"{root}/{source}") if self.wanted("source_id", source) else ():
                if DAY.fullmatch(day) and self.wanted("day", day):
                    for prefix in names(f"{root}/{source}/{day}/sha256"):
                        if PREFIX.fullmatch(prefix) and self.wanted("prefix", prefix):
                            yield source, day, prefix

    def objects(self, folder: Folder) -> Iterator[fs.FileInfo]:
        files, root = self.open()
        for info in sorted(files.get_file_info(fs.FileSelector(f"{root}/{folder.source}/{folder.day}/sha256/{folder.prefix}", allow_not_found=True)), key=lambda i: i.base_name):
            whole = DIGEST.fullmatch(info.base_name) and info.base_name.startswith(folder.prefix) and self.wanted("digest", info.base_name)
            if whole and folder.after < info.mtime_ns <= folder.upto:
                yield info

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        files, _ = self.open()
        rows, size = [], 0
        for info in self.objects(folder):
            with files.open_input_stream(info.path) as f:
                content = f.read()
            rows.append((folder.source, folder.day, info.base_name, info.path, len(content), hashlib.sha256(content).hexdigest() == info.base_name, content))
            size += len(content)
            if size >= TOGETHER:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archive = Archive(options)
        self.archive.tests["prefix"] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on names; those on a digest choose prefixes too."""
        compare = {EqualTo: lambda v: lambda x: x == v, GreaterThan: lambda v: lambda x: x > v, GreaterThanOrEqual: lambda v: lambda x: x >= v, LessThan: lambda v: lambda x: x < v, LessThanOrEqual: lambda v: lambda x: x <= v, In: lambda v: lambda x: x in v, StringStartsWith: lambda v: lambda x: x.startswith(v)}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) not in compare or column not in ("source_id", "day", "digest"):
                yield f
                continue
            self.archive.tests[column].append(compare[type(f)](f.value))
            if column == "digest":
                cut = {EqualTo: lambda v: lambda p: p == v[:2], In: lambda v: lambda p: p in {x[:2] for x in v if x}, StringStartsWith: lambda v: lambda p: p.startswith(v[:2])}.get(type(f))
                if cut:
                    self.archive.tests["prefix"].append(cut(f.value))

    def partitions(self) -> list[Folder]:
        return [Folder(*f) for f in self.archive.folders()]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.archive.read(partition)


class ArchiveStreamReader(DataSourceStreamReader):
    """Objects by the time they came. Those younger than settle_seconds (2) wait, so that equal times don't straddle an offset."""

    def __init__(self, options: dict):
        self.archive = Archive(options)
        self.archive.tests["prefix"] = []
        self.settle = int(float(options.get("settle_seconds", 2)) * 1e9)

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        limit, newest = time.time_ns() - self.settle, -1
        for f in self.archive.folders():
            newest = max([newest, *(i.mtime_ns for i in self.archive.objects(Folder(*f, upto=limit)))])
        return {"upto": newest}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        found = [Folder(*f, start["upto"], end["upto"]) for f in self.archive.folders()] if end["upto"] > start["upto"] else []
        return [f for f in found if next(self.archive.objects(f), None)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.archive.read(partition)

    def commit(self, end: dict) -> None:
        pass


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(self.options)
