"""Batch reader of headerless volumes: a task for each slab of planes, of those that are asked for.

Planes are named when the file is loaded, not by a filter that Spark pushes down: in Spark 4.1 the filters pushed to a Python
source stay with the loaded table, so a second query, or the other side of a union, would miss the first one's rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a slab, at least one plane, and voxels that a task hands on at once.
SLAB, BATCH = 16 << 20, 1 << 16


def opened(path: str) -> tuple[FileSystem, str]:
    """A file system by the path's scheme, and the name there; a path without one is in a folder that all machines mount."""
    plain = re.sub("^file:/*", "/", path)
    return FileSystem.from_uri(plain) if "://" in plain else (LocalFileSystem(), os.path.abspath(plain))


def file_size(path: str) -> int:
    system, name = opened(path)
    info = system.get_file_info(name)
    if not info.is_file:
        raise ValueError(f"no file: {path}")
    return info.size


@dataclass
class Slab(InputPartition):
    first: int
    stop: int


class _RawReader(DataSourceReader):
    def __init__(self, path: str, dims: tuple[int, int, int], flip: bool, planes: tuple[int, int], slab: int) -> None:
        self.path, self.dims, self.flip = path, dims, flip
        self.first, self.stop = planes
        self.step = max(1, slab // (4 * dims[0] * dims[1]))

    def partitions(self) -> list[Slab]:
        # Spark would read an empty list as one whole task.
        return [Slab(z, min(z + self.step, self.stop)) for z in range(self.first, self.stop, self.step)] or [Slab(0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = self.dims
        system, name = opened(self.path)
        at, end = partition.first * nx * ny, partition.stop * nx * ny
        with system.open_input_file(name) as file:
            while at < end:
                n = min(BATCH, end - at)
                data = file.read_at(4 * n, 4 * at)
                if len(data) != 4 * n:
                    raise ValueError(f"{self.path} ends early")
                place = np.arange(at, at + n)
                x, y, z = place % nx, place // nx % ny, place // (nx * ny)
                if self.flip:
                    x, y = nx - 1 - x, ny - 1 - y
                columns = [pa.array(x + nx * (y + ny * z)), *(pa.array(c.astype(np.int32)) for c in (x, y, z)), pa.array(np.frombuffer(data, "<f4").astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, ["idx", "x", "y", "z", "value"])
                at += n


class RawSource(DataSource):
    """Format tessera_raw: options path, nx, ny, nz, flip (x and y, from LPS to RAS), first and stop (planes), and slab, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "tessera_raw"

    def schema(self) -> str:
        return "idx long, x int, y int, z int, value float"

    def reader(self, schema) -> _RawReader:
        own = self.options
        dims = tuple(int(own[c]) for c in ("nx", "ny", "nz"))
        if min(dims) < 1 or file_size(own["path"]) != 4 * dims[0] * dims[1] * dims[2]:
            raise ValueError(f"{own['path']} doesn't hold {dims} values")
        planes = max(0, int(own.get("first", 0))), min(dims[2], int(own.get("stop", dims[2])))
        return _RawReader(own["path"], dims, str(own.get("flip", "true")).lower() == "true", planes, int(own.get("slab", SLAB)))
