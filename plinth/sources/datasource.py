"""``spark.read.format("dxf")``: the scan of drawings as a data source, in batches and in streams.

    spark.dataSource.register(DxfSource)
    spark.read.format("dxf").option("row_kinds", "entity,insert").load(folder)
    spark.readStream.format("dxf").load(folder)

Files are listed where the query is planned, and dealt into partitions of about so many bytes; tasks read and scan them. A stream goes
by the files' times of change and names: a batch has all that came after the one before, so a batch that is run again has the same
files. A file that arrives with an older time than one that was read isn't seen.

Options: ``path``; ``row_kinds``, those that are wanted (all); ``skip_off_layers`` (false); ``partition_bytes`` (64 MB; a larger file is
alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from plinth.sources import dxf


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Files(InputPartition):
    """Drawings that one task reads."""

    paths: tuple[str, ...]


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of the drawings at or below a path, oldest first."""
    system, place = _system(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((int(f.mtime_ns or 0), f.path, int(f.size or 0)) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".dxf"))


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Partitions of files that have at most so many bytes together; a larger file is alone."""
    out, held, size = [], [], 0
    for _, path, n in files:
        if held and size + n > most:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, Files(tuple(held))] if held else out


class _Scans:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("name the drawings' path")
        self.path = options["path"]
        self.kinds = {k.strip() for k in options.get("row_kinds", "").split(",") if k.strip()}
        self.skip = options.get("skip_off_layers", "false").lower() == "true"
        self.part = int(options.get("partition_bytes", 64 << 20))

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        system, _ = _system(self.path)
        schema = dxf.arrow_schema()
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as source:
                content = source.read()
            for batch in dxf.batches(path, content, self.skip, schema):
                yield batch.filter(pa.array([k in self.kinds for k in batch.column("row_kind").to_pylist()])) if self.kinds else batch


class _Reader(_Scans, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(listed(self.path), self.part)


class _StreamReader(_Scans, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.at = {"time": -1, "path": ""}

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        self.at = max([self.at, *({"time": t, "path": p} for t, p, _ in listed(self.path)[-1:])], key=lambda o: (o["time"], o["path"]))
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return dealt([f for f in listed(self.path) if low < f[:2] <= high], self.part)


class DxfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return f"path string, {dxf.SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
