"""TIFF planes by their strips and tiles: headers give a row for each, which are then read by offset and decoded in tasks of their own."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.geometry import natural_key
from tessera.operators.numbering import numbered
from tessera.sources.raw import opened
from tessera.storage import cut

#: Fixed values of the format: numbers of fields, their types, and ways of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, FILL, STRIPS, CHANNELS, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 266, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
SEGMENT = "path string, z long, place long, size long, x int, y int, w int, h int, rows int, width int, height int, kind string, compression int, predictor int"


def header(file, length: int) -> dict[int, tuple[int, ...]]:
    """Fields of the first image; only these parts of the file are read."""
    data = file.read_at(8, 0)
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    end = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(end + "I", data[4:])[0]
    count = struct.unpack(end + "H", file.read_at(2, at))[0]
    entries = file.read_at(12 * count, at + 2)
    fields: dict[int, tuple[int, ...]] = {0: (end == ">",)}
    for i in range(count):
        field, kind, n = struct.unpack_from(end + "HHI", entries, 12 * i)
        if kind not in TYPES:
            continue
        size = n * struct.calcsize(TYPES[kind])
        body = entries[12 * i + 8 : 12 * i + 12]
        if size > 4:
            place = struct.unpack(end + "I", body)[0]
            if place + size > length:
                raise ValueError("a field lies beyond the file's end")
            body = file.read_at(size, place)
        fields[field] = struct.unpack_from(f"{end}{n}{TYPES[kind]}", body)
    return fields


def segments(fields: dict[int, tuple[int, ...]]) -> list[dict]:
    """The strips or tiles of an image of one channel: where they are in the file and in the picture."""
    one = lambda tag, usual=None: fields[tag][0] if tag in fields else usual
    width, height, bits = one(WIDTH), one(HEIGHT), one(BITS, 1)
    if not width or not height or one(CHANNELS, 1) != 1 or len(fields.get(BITS, (1,))) != 1 or bits not in (8, 16, 32, 64) or one(FILL, 1) != 1:
        raise ValueError("only TIFF of one channel and whole bytes can be read")
    letter = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if letter is None or letter == "f" and bits < 32 or one(COMPRESSION, NONE) not in (NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE) or one(PREDICTOR, 1) not in (1, 2, 3):
        raise ValueError("unknown kind of values or compression")
    if one(PREDICTOR, 1) == 2 and letter == "f" or one(PREDICTOR, 1) == 3 and letter != "f":
        raise ValueError("the predictor doesn't fit the values")
    common = {"width": width, "height": height, "kind": f"{'>' if fields[0][0] else '<'}{letter}{bits // 8}", "compression": one(COMPRESSION, NONE), "predictor": one(PREDICTOR, 1)}
    if TILES in fields:
        tw, th = one(TILE_WIDTH), one(TILE_HEIGHT)
        across = -(-width // tw)
        corners = [(tw * (i % across), th * (i // across)) for i in range(across * -(-height // th))]
        places, sizes = fields[TILES], fields[TILE_BYTES]
    else:
        tw, th = width, min(one(STRIP_ROWS, height), height)
        corners = [(0, y) for y in range(0, height, th)]
        places = fields[STRIPS]
        sizes = fields.get(STRIP_BYTES, ())
    if len(places) != len(corners) or len(sizes) != len(corners):
        raise ValueError("strips don't fill the image")
    # The last strip has only the rows that are left; tiles are always whole.
    stored = lambda y: th if TILES in fields else min(th, height - y)
    return [common | {"place": p, "size": n, "x": x, "y": y, "w": tw, "h": min(th, height - y), "rows": stored(y)} for (x, y), p, n in zip(corners, places, sizes, strict=True)]


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count and literal bytes, or a negative count and a byte to repeat; -128 says nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW of 9 to 12 bits, highest first; the width grows one code before the table needs it."""
    out, table, last = bytearray(), [], b""
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if not table or code > len(table) or code == len(table) and not last:
            raise ValueError("damaged LZW data")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def decoded(data: bytes, compression: int, predictor: int, kind: str, w: int, rows: int) -> np.ndarray:
    """Values [row, column] of a strip or tile."""
    if compression == LZW:
        data = unpacked_lzw(data)
    elif compression == PACKBITS:
        data = unpacked_bits(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    dtype = np.dtype(kind)
    need = w * rows * dtype.itemsize
    if len(data) < need:
        raise ValueError("strips don't fill the image")
    data = data[:need]
    if predictor == 3:  # bytes of a row by significance, highest first, each as its difference to the one before
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
        data = np.ascontiguousarray(planes.reshape(rows, dtype.itemsize, w).transpose(0, 2, 1)).tobytes()
        return np.frombuffer(data, dtype.newbyteorder(">")).reshape(rows, w)
    values = np.frombuffer(data, dtype).reshape(rows, w)
    return np.cumsum(values, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else values


def read_planes(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    """Voxels (x, y, z, value float) of the .tif and .tiff files in a folder, not searched below, and their width and height.

    Planes follow the natural order of their names. ValueError if there are none or if they differ in size or in the kind of
    their values. Damaged data fail the task that meets them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(folder)
    named = files.select("path", "length").where(F.lower("path").rlike(r"\.tiff?$")).withColumn("k", natural_key(F.element_at(F.split("path", "/"), -1)))
    planes = numbered(named, ["k", "path"], "planes").select("path", "length", F.col("number").alias("z"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                system, name = opened(row["path"])
                with system.open_input_file(name) as file:
                    found = [s | {"path": row["path"], "z": row["z"]} for s in segments(header(file, row["length"]))]
                yield pa.RecordBatch.from_pylist(found, schema)

    whole = {"path": pa.string(), "kind": pa.string(), "z": pa.int64(), "place": pa.int64(), "size": pa.int64()}
    schema = pa.schema([(f.split()[0], whole.get(f.split()[0], pa.int32())) for f in SEGMENT.split(", ")])
    found = cut(planes.mapInArrow(heads, SEGMENT), "segments")
    sizes = found.select("width", "height", F.substring("kind", 2, 2).alias("kind")).distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError("planes differ in size or kind, or there are none")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                system, name = opened(s["path"])
                with system.open_input_file(name) as file:
                    data = file.read_at(s["size"], s["place"])
                values = decoded(data, s["compression"], s["predictor"], s["kind"], s["w"], s["rows"])[: s["h"], : s["width"] - s["x"]]
                y, x = (a.ravel() for a in np.indices(values.shape))
                columns = [(x + s["x"]).astype(np.int32), (y + s["y"]).astype(np.int32), np.full(values.size, s["z"], np.int32), values.astype(np.float32).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "z", "value"])

    spread = found.repartition(spark.sparkContext.defaultParallelism * 4, "path", "place")  # strips of a plane go to several tasks
    return spread.mapInArrow(read, "x int, y int, z int, value float"), sizes[0].width, sizes[0].height
