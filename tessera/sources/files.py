"""Binary files written by tasks at fixed places: a folder that all machines share, one row for each piece.

A piece goes to its own offset, so that tasks fill one file together and a repeated task writes the same bytes
again. Files get their names when all tasks have ended.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class _Pieces(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.held = folder, f"{folder}/.writing-{uuid.uuid4().hex}"
        os.makedirs(self.held)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for batch in iterator:
            for name, at, data in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "data")), strict=True):
                if os.path.basename(name) != name or name.startswith("."):
                    raise ValueError(f"not a file name: {name}")
                handle = os.open(f"{self.held}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    left = memoryview(data)
                    while left:
                        done = os.pwrite(handle, left, at)
                        at, left = at + done, left[done:]
                finally:
                    os.close(handle)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in os.listdir(self.held):
            os.replace(f"{self.held}/{name}", f"{self.folder}/{name}")
        os.rmdir(self.held)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.held, ignore_errors=True)


class PieceSink(DataSource):
    """Format tessera_pieces: rows (name, at, data) to the folder in option path."""

    @classmethod
    def name(cls) -> str:
        return "tessera_pieces"

    def schema(self) -> str:
        return "name string, at long, data binary"

    def writer(self, schema, overwrite: bool) -> _Pieces:
        return _Pieces(self.options["path"])


def write_pieces(pieces: DataFrame, folder: str) -> None:
    """Files of (name, at, data) in a folder; existing ones of these names are replaced, all others stay."""
    os.makedirs(folder, exist_ok=True)
    pieces.sparkSession.dataSource.register(PieceSink)
    pieces.select("name", "at", "data").write.format("tessera_pieces").mode("append").option("path", folder).save()
