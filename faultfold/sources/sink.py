"""Queue messages written exactly once per micro-batch, as a Python data source for streams.

Each task writes its messages to one file of its own in ``path/messages`` and tells the driver its name;
the driver lists the names of a batch's finished tasks in ``path/batches/<batch>.json``. Only listed files count:
files of failed or repeated tasks and batches are never read. A batch that is run again writes its list
anew, so it replaces what the first run listed. ``path`` may lie on any file system Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

NAME = "faultfold_messages"


class Written(WriterCommitMessage):
    """The file of a finished task, or nothing if it had no rows."""

    def __init__(self, file: str | None):
        self.file = file


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class MessageWriter(DataSourceStreamWriter):
    def __init__(self, path: str, column: int):
        self.path, self.column = path.rstrip("/"), column

    def write(self, iterator: Iterator) -> Written:
        files, path = _opened(self.path)
        first = next(iterator, None)
        if first is None:
            return Written(None)
        name = f"{uuid.uuid4().hex}.jsonl"
        files.create_dir(f"{path}/messages", recursive=True)
        with files.open_output_stream(f"{path}/messages/{name}") as out:
            out.write(f"{first[self.column]}\n".encode())
            for row in iterator:
                out.write(f"{row[self.column]}\n".encode())
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, path = _opened(self.path)
        files.create_dir(f"{path}/batches", recursive=True)
        listed = json.dumps([m.file for m in messages if m is not None and m.file])
        part = f"{path}/batches/.{batchId}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(listed.encode())
        files.move(part, f"{path}/batches/{batchId}.json")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, path = _opened(self.path)
        for message in messages:
            if message is not None and message.file:
                files.delete_file(f"{path}/messages/{message.file}")


class MessageSink(DataSource):
    """``df.writeStream.format("faultfold_messages").option("path", ...)`` of rows with a column ``value``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite: bool) -> MessageWriter:
        return MessageWriter(self.options["path"], schema.fieldNames().index("value"))


def written_messages(spark: SparkSession, path: str) -> DataFrame:
    """``batch, value``: the messages of all batches that were completed."""
    listed = spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/batches").selectExpr(
        "cast(regexp_extract(_metadata.file_name, '(\\\\d+)', 1) as bigint) as batch",
        "explode(from_json(value, 'array<string>')) as file",
    )
    lines = spark.read.text(f"{path.rstrip('/')}/messages").selectExpr("value", "_metadata.file_name as file")
    return lines.join(listed, "file").select("batch", "value")
