"""A sink of frames that takes each batch whole and once: ``writeStream.format("client_frames")``.

Tasks write files; a batch's files count once its entry in the log names them. A batch that comes again after its entry
was made changes nothing, one that fails leaves no file. Neither reads what earlier batches wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as files
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """A task's file, if it had rows."""

    name: str | None
    rows: int


class FramesWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[files.FileSystem, str]:
        return files.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(None, 0)
        system, root = self._place()
        name, rows = f"{uuid.uuid4().hex}.parquet", first.num_rows
        system.create_dir(f"{root}/data")
        with system.open_output_stream(f"{root}/data/{name}") as out, pq.ParquetWriter(out, first.schema) as writer:
            writer.write_batch(first)
            for batch in iterator:
                writer.write_batch(batch)
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, root = self._place()
        entry = f"{root}/log/{batchId:012d}.json"
        if system.get_file_info(entry).type != files.FileType.NotFound:
            return self.abort(messages, batchId)  # this batch's first writing counts
        named = [m for m in messages if m and m.name]
        system.create_dir(f"{root}/log")
        with system.open_output_stream(f"{entry}.new") as out:
            out.write(json.dumps({"files": [m.name for m in named], "rows": sum(m.rows for m in named)}).encode())
        system.move(f"{entry}.new", entry)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, root = self._place()
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/data/{m.name}")


class ClientFrames(DataSource):
    """Option: path, a folder that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "client_frames"

    def streamWriter(self, schema: StructType, overwrite: bool) -> FramesWriter:
        path = self.options["path"]
        return FramesWriter(path if ":" in path else f"file://{path}")


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The frames of the batches that are in the log, of which a file has a name for each task."""
    system, root = files.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    begun = system.get_file_info(f"{root}/log").type == files.FileType.Directory
    entries = spark.read.schema("files array<string>").json(f"{path}/log/*.json").collect() if begun else []
    names = [f"{path}/data/{n}" for row in entries for n in row["files"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there now into the sink at ``path``, and reads what counts there."""
    spark = stream.sparkSession
    spark.dataSource.register(ClientFrames)
    query = stream.writeStream.format("client_frames").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return committed(spark, path, stream.schema)
