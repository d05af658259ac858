"""Samples through Spark's Python data sources: a write that is there as a whole or not at all.

``spark.dataSource.register(SampleFiles)``, then ``df.write.format("callscope").mode("append").save(path)`` and
``spark.read.format("callscope").load(path)``. Sinks of other packages can follow the same form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from callscope.model import SAMPLE_SCHEMA
from callscope.sinks.base import Sink, register_sink

FORMAT = "callscope"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path names, and the path in it. The folder has to be one that all workers share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder(options) -> str:
    if "path" not in options:
        raise ValueError("give the folder of the samples: save(path) or load(path)")
    return options["path"].rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """A file that a task left in the staging folder."""

    name: str | None
    rows: int


class SampleWriter(DataSourceArrowWriter):
    """Tasks write into a staging folder of the write; ``commit`` moves the files of the successful ones among the
    samples, ``abort`` deletes the folder. Files of failed or repeated attempts are never moved.

    With the option ``batch`` the write replaces what was stored under that number.
    """

    def __init__(self, options, overwrite: bool):
        self.folder = _folder(options)
        self.overwrite = overwrite
        self.batch = options.get("batch")
        self.write_id = uuid.uuid4().hex
        self.staging = f"{self.folder}/_staged/{self.write_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staging = _store(self.staging)
        store.create_dir(staging, recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(store.open_output_stream(f"{staging}/{name}"), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        own = self.write_id if self.batch is None else f"batch-{self.batch}"
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
        replaced = old if self.overwrite else [p for p in old if p.rpartition("/")[2].startswith(f"{own}-")]
        for path in replaced:
            store.delete_file(path)
        for message in messages:
            if message is not None and message.name is not None:
                store.move(f"{folder}/_staged/{self.write_id}/{message.name}", f"{folder}/{own}-{message.name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


@dataclass
class OneFile(InputPartition):
    path: str


class SampleReader(DataSourceReader):
    """One task per file; only whole writes are seen."""

    def __init__(self, options, schema: T.StructType):
        self.folder = _folder(options)
        self.names = schema.names

    def partitions(self) -> list[OneFile]:
        store, folder = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [OneFile(f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet")]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _store(self.folder)
        with store.open_input_file(partition.path) as file:
            yield from pq.ParquetFile(file).iter_batches(columns=self.names)


class SampleFiles(DataSource):
    """The data source ``callscope``: samples in a shared folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SAMPLE_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SampleReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SampleWriter(self.options, overwrite)


@register_sink("source")
class SourceSink(Sink):
    """Stores batches through a registered data source; a replayed batch replaces itself."""

    def __init__(self, path: str, source: type[DataSource] = SampleFiles):
        self.path = path
        self.source = source

    def setup(self, spark: SparkSession) -> None:
        spark.dataSource.register(self.source)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.format(self.source.name()).option("batch", str(batch_id)).mode("append").save(self.path)
