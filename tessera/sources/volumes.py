"""Volumes from and to files: headerless raw values, uncompressed TIFF planes, PNG slices."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.geometry import ORIENTATIONS, check_layout, check_matrix, export_name, resolved_dims, slice_matrix
from tessera.operators.gather import back_map, turned_grid, turned_pieces, turned_planes
from tessera.operators.volume import lps_to_ras, scalar_range, valid_of, window_gray, with_index
from tessera.sources.files import write_pieces
from tessera.sources.raw import RawSource, file_size
from tessera.sources.tiff import read_planes


def read_raw(spark: SparkSession, path: str, dims: tuple[int, int, int] = (0, 0, 0), flip: bool = True, planes: tuple[int, int] | None = None) -> DataFrame:
    """Voxels (idx, x, y, z, value) of a file of little-endian 32-bit floats, x fastest, with x and y flipped from LPS to RAS.

    A task reads a slab of planes. With planes only z from the first to before the second is read, and other slabs aren't
    opened. ValueError unless the file holds exactly the volume; sizes of zero are taken from its name.
    """
    nx, ny, nz = resolved_dims(path, dims)
    size = file_size(path)
    if size != 4 * nx * ny * nz:
        raise ValueError(f"{size} bytes, not {4 * nx * ny * nz}")
    first, stop = planes or (0, nz)
    spark.dataSource.register(RawSource)
    return spark.read.format("tessera_raw").options(path=path, nx=nx, ny=ny, nz=nz, flip=flip, first=first, stop=stop).load()


def from_buffer(spark: SparkSession, values: np.ndarray, dims: tuple[int, int, int], spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), flip: bool = True) -> tuple[DataFrame, tuple[float, float, float]]:
    """Voxels (idx, x, y, z, value) of an array of the driver, x fastest, with x and y flipped from LPS to RAS, and their origin.

    Larger volumes are read from files. ValueError for a bad layout, or unless the array has a value for each voxel.
    """
    count = check_layout(dims, spacing, origin, np.size(values))
    held = pa.table({"idx": pa.array(np.arange(count)), "value": pa.array(np.ascontiguousarray(values, dtype="<f4").ravel())})
    voxels = with_index(spark.createDataFrame(held), dims[0], dims[1])
    if not flip:
        return voxels.select("idx", "x", "y", "z", "value"), tuple(map(float, origin))
    ends = [-o - (d - 1) * s for o, d, s in zip(origin[:2], dims[:2], spacing[:2], strict=True)]
    return lps_to_ras(voxels, dims[0], dims[1]).select("idx", "x", "y", "z", "value"), (*map(float, ends), float(origin[2]))


def write_turned(voxels: DataFrame, dims: tuple[int, int, int], folder: str, matrix: np.ndarray, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> tuple[str, tuple[int, int, int]]:
    """A file of the volume after an affine matrix, on the grid that is cut to it; its path and sizes.

    Linear between voxels; where the turned volume doesn't reach, the least value of all voxels. The mask is not looked at.
    The matrix is checked before anything is made. Bricks of the new grid write their own rows of the file.
    """
    check_matrix(matrix)
    to, low = turned_grid(dims, spacing, origin, matrix)
    back = back_map(spacing, origin, matrix, low)
    least = scalar_range(voxels).first()[0]  # one row
    name = export_name(to, ".raw")
    write_pieces(turned_pieces(voxels, dims, to, back, 0.0 if least is None else least, name), folder)
    return f"{folder}/{name}", to


def write_raw(voxels: DataFrame, dims: tuple[int, int, int], folder: str) -> str:
    """One file of little-endian 32-bit floats, x fastest; the mask is not looked at. Returns its path.

    Voxels are gathered by rows of x, and each row goes to its own place in the file.
    """
    nx, name = dims[0], export_name(dims, ".raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("values")
            data = [np.asarray(v.values, dtype="<f4").tobytes() for v in values]
            if any(len(d) != 4 * nx for d in data):
                raise ValueError("the volume is not dense")
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(b.column("row").to_numpy() * 4 * nx), pa.array(data, pa.binary())], ["name", "at", "data"])

    rows = voxels.groupBy(F.expr(f"idx div {nx}").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "value"))), lambda s: s["value"]).alias("values"))
    write_pieces(rows.mapInArrow(run, "name string, at long, data binary"), folder)
    return f"{folder}/{name}"


def read_tiff(spark: SparkSession, folder: str, flip: bool = True) -> DataFrame:
    """Voxels of a folder of .tif and .tiff planes, not searched below; planes follow the natural order of their names.

    Images of one channel, in strips or tiles, plain or packed by PackBits, LZW or Deflate, with or without a predictor.
    Every strip or tile is read and decoded by itself. All planes must have the same size and kind of values.
    """
    planes, w, h = read_planes(spark, folder)
    idx = F.col("x") + F.lit(w) * (F.col("y") + F.lit(h).cast("long") * F.col("z"))
    voxels = planes.select(idx.cast("long").alias("idx"), "x", "y", "z", "value")
    return lps_to_ras(voxels, w, h) if flip else voxels


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray picture."""
    rows = np.hstack([np.zeros((gray.shape[0], 1), np.uint8), gray.astype(np.uint8)]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def slice_pictures(voxels: DataFrame, dims: tuple[int, int, int], orientation: str, window: float, center: float) -> DataFrame:
    """(name, at, data): a PNG for each slice of an orientation; invalid voxels are 0, and rows run from the bottom up. A group is one slice."""
    axis, u, v, *_ = ORIENTATIONS[orientation]
    size = dict(zip("xyz", dims, strict=True))
    digits = max(4, len(str(size[axis] - 1)))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        gray = np.zeros((size[v], size[u]), np.uint8)
        gray[rows["v"], rows["u"]] = rows["gray"]
        return pd.DataFrame({"name": [f"{orientation.capitalize()}_{int(rows['k'].iat[0]):0{digits}d}.png"], "at": [0], "data": [png(gray[::-1])]})

    gray = F.when(valid_of(voxels), window_gray(F.col("value"), window, center)).otherwise(0)
    return voxels.select(F.col(axis).alias("k"), F.col(u).alias("u"), F.col(v).alias("v"), gray.alias("gray")).groupBy("k").applyInPandas(draw, "name string, at long, data binary")


def write_slices(voxels: DataFrame, dims: tuple[int, int, int], folder: str, orientation: str, window: float, center: float, matrix: np.ndarray | None = None, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), degrees: float | None = None, about: tuple[float, float, float] = (0, 0, 0)) -> tuple[str, tuple[int, int, int]]:
    """PNG slices of the volume after an affine matrix, on the grid that is cut to it; their folder and the grid's sizes.

    With degrees the volume is turned further, about a point and by the orientation's axis. Values are linear between
    voxels, and the least value of all voxels where the volume doesn't reach; places whose nearest voxel is invalid, or
    missing, are 0 if there is a mask. A suffix of the folder's name is left out. Everything is checked before it is made. Bricks of
    the new grid hand over rectangles of bytes, and a task draws one picture.
    """
    if orientation not in ORIENTATIONS:
        raise ValueError(f"no such orientation: {orientation}")
    if not np.isfinite([window, center]).all():
        raise ValueError("window and centre must be finite")
    place = PurePath(folder)
    folder = str(place.with_suffix("")) if place.suffix else folder
    placed = slice_matrix(np.eye(4) if matrix is None else np.asarray(matrix, dtype=float), orientation, about, degrees)
    check_matrix(placed)
    to, low = turned_grid(dims, spacing, origin, placed)
    back = back_map(spacing, origin, placed, low)
    axes = ORIENTATIONS[orientation][:3]
    size = dict(zip("xyz", to, strict=True))
    width, height = size[axes[1]], size[axes[2]]
    digits = max(4, len(str(size[axes[0]] - 1)))
    span = max(window, 1e-6)

    def shade(values: np.ndarray) -> np.ndarray:
        share = (values.astype(np.float32).astype(float) - (center - span / 2)) / span
        return np.floor(np.clip(share, 0, 1) * 255 + 0.5)

    least = scalar_range(voxels).first()[0]  # one row
    planes = turned_planes(voxels, dims, to, back, 0.0 if least is None else least, axes, shade).withColumn("seen", F.lit(False))
    if "valid" in voxels.columns:
        mask = voxels.select("x", "y", "z", F.when(valid_of(voxels), 1.0).otherwise(0.0).alias("value"))
        planes = planes.union(turned_planes(mask, dims, to, back, 0.0, axes, lambda v: v != 0, nearest=True).withColumn("seen", F.lit(True)))

    def draw(rows: pa.Table) -> pa.Table:
        gray, seen = np.zeros((height, width), np.uint8), np.ones((height, width), np.uint8)
        for u, v, w, data, kind in zip(*(rows[c].to_pylist() for c in ("u", "v", "width", "data", "seen")), strict=True):
            part = np.frombuffer(data, np.uint8).reshape(-1, w)
            (seen if kind else gray)[v : v + len(part), u : u + w] = part
        name = f"{orientation.capitalize()}_{rows['k'][0].as_py():0{digits}d}.png"
        return pa.table({"name": [name], "at": pa.array([0], pa.int64()), "data": pa.array([png((gray * seen)[::-1])], pa.binary())})

    write_pieces(planes.groupBy("k").applyInArrow(draw, "name string, at long, data binary"), folder)
    return folder, to


def png_pixels(data: bytes) -> np.ndarray:
    """Gray values of a picture as png() makes it, the top row first; ValueError for any other kind."""
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        held = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + held) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged picture")
        head, body, at = held if kind == b"IHDR" else head, body + held * (kind == b"IDAT"), at + 12 + size
    if data[:8] != b"\x89PNG\r\n\x1a\n" or head is None or head[8:] != bytes([8, 0, 0, 0, 0]):
        raise ValueError("not an 8-bit gray picture")
    width, height = struct.unpack(">II", head[:8])
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]
