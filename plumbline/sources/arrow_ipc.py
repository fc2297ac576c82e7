"""Arrow IPC / Feather v2 files as a Spark data source: one input partition per record batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[len("file:"):]
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, local = _filesystem(path)
    info = system.get_file_info(local)
    if info.type == fs.FileType.File:
        return [local]
    found = system.get_file_info(fs.FileSelector(local, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".arrow", ".feather")))


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        system, _ = _filesystem(self.path)
        parts = []
        for file in _files(self.path):
            with system.open_input_file(file) as source:
                parts += [InputPartition((file, i)) for i in range(pa.ipc.open_file(source).num_record_batches)]
        return parts

    def read(self, partition):
        if partition is None:  # a folder without batches
            return
        file, batch = partition.value
        system, _ = _filesystem(self.path)
        with system.open_input_file(file) as source:
            yield pa.ipc.open_file(source).get_batch(batch).select(self.names)


class ArrowIpcSource(DataSource):
    """``spark.read.format("arrow_ipc").load(path)`` after registration."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow files under {self.options['path']}")
        system, _ = _filesystem(self.options["path"])
        with system.open_input_file(files[0]) as source:
            return from_arrow_schema(pa.ipc.open_file(source).schema)

    def reader(self, schema):
        return ArrowIpcReader(self.options["path"], schema.fieldNames())
