import struct
import zlib

import numpy as np
import pytest

from tessera.sources import tiff, volumes


def packbits(data):
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            while at + n < len(data) and n < 128 and data[at + n] != data[at + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out) + b"\x80"


def lzw(data):
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    put(256, 9)
    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    count = 258
    for k in data:
        longer = word + bytes([k])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = count
        count += 1
        if count == 4095:
            put(256, 12)
            table, width, count = {bytes([k]): k for k in range(256)}, 9, 258
        else:
            width = max(9, count.bit_length())
        word = bytes([k])
    if word:
        put(table[word], width)
        count += 1
        width = max(9, count.bit_length())
    put(257, width)
    put(0, -bits % 8)
    return bytes(out)


PACK = {1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: packbits, 32946: zlib.compress}


def differences(values, predictor, kind):
    if predictor == 2:
        return np.diff(values, axis=1, prepend=np.zeros((len(values), 1), values.dtype)).astype(kind).tobytes()
    if predictor == 3:
        rows = values.astype(values.dtype.newbyteorder(">"))
        planes = np.frombuffer(rows.tobytes(), np.uint8).reshape(*values.shape, -1).transpose(0, 2, 1).reshape(len(values), -1)
        return np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), np.uint8)).astype(np.uint8).tobytes()
    return values.astype(kind).tobytes()


def written(values, kind, compression=1, predictor=1, rows=None, tile=None):
    """A file of one image in strips of so many rows, or in square tiles."""
    h, w = values.shape
    end = kind[0]
    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), values.dtype)
        padded[:h, :w] = values
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [values[y : y + rows] for y in range(0, h, rows)]
    packed = [PACK[compression](differences(p, predictor, kind)) for p in parts]
    places = np.cumsum([8] + [len(p) for p in packed]).tolist()
    at = places.pop()
    letter = {"u": 1, "i": 2, "f": 3}[kind[1]]
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8 * int(kind[2])]), (259, 3, [compression]), (317, 3, [predictor]), (339, 3, [letter])]
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, places), (325, 4, [len(p) for p in packed])] if tile else [(273, 4, places), (278, 3, [rows]), (279, 4, [len(p) for p in packed])]
    entries, more = b"", b""
    beyond = at + 2 + 12 * len(tags) + 4
    for tag, t, v in sorted(tags):
        body = struct.pack(f"{end}{len(v)}{'HI'[t - 3]}", *v)
        if len(body) > 4:
            body, more = struct.pack(end + "I", beyond + len(more)), more + body
        entries += struct.pack(end + "HHI", tag, t, len(v)) + body.ljust(4, b"\0")
    return (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", at) + b"".join(packed) + struct.pack(end + "H", len(tags)) + entries + bytes(4) + more


CASES = [("<u2", 1, 1, 4, None), (">u2", 5, 2, 3, None), ("<u1", 32773, 1, 2, None), ("<f4", 8, 3, 5, None), (">f4", 5, 1, None, 16), ("<i2", 32946, 2, None, 16), (">u4", 5, 2, None, 16), ("<f8", 8, 3, None, 16), (">f4", 1, 3, 7, None), ("<u1", 5, 1, 23, None)]


@pytest.mark.parametrize("kind, compression, predictor, rows, tile", CASES)
def test_planes_of_each_kind(spark, tmp_path, kind, compression, predictor, rows, tile):
    rng = np.random.default_rng(compression + predictor)
    low, high = (-900, 900) if kind[1] in "if" else (0, 250)
    whole = (rng.integers(low, high, (3, 23, 37)) // 7 * 7).astype(kind[1:])
    whole[1, 4:20] = whole[1, 4, 0]  # runs
    for z, plane in enumerate(whole):
        (tmp_path / f"p{z + 9}.tif").write_bytes(written(plane, kind, compression, predictor, rows, tile))
    (tmp_path / "p1.tifx").write_bytes(b"no image")
    got = volumes.read_tiff(spark, str(tmp_path), flip=False)
    assert {(r.x, r.y, r.z): r.value for r in got.collect()} == {(x, y, z): float(np.float32(v)) for (z, y, x), v in np.ndenumerate(whole)}
    planes, w, h = tiff.read_planes(spark, str(tmp_path))
    assert (w, h) == (37, 23)
    tasks = planes.select("z").withColumn("task", tiff.F.spark_partition_id()).distinct().groupBy("z").count()
    assert rows == 23 or all(r["count"] > 1 for r in tasks.collect())  # a plane is not one task


def test_long_lzw_data_fill_the_table():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), b"ab" * 40_000, b"", b"x"):
        assert tiff.unpacked_lzw(lzw(data)) == data
    with pytest.raises(ValueError):
        tiff.unpacked_lzw(b"\x80\x7f\xff\xff")


def test_planes_that_do_not_agree(spark, tmp_path):
    with pytest.raises(ValueError):
        volumes.read_tiff(spark, str(tmp_path))
    values = np.ones((4, 4))
    (tmp_path / "a.tif").write_bytes(written(values.astype("u2"), "<u2", rows=4))
    (tmp_path / "b.tif").write_bytes(written(values.astype("f4"), "<f4", rows=4))
    with pytest.raises(ValueError):
        volumes.read_tiff(spark, str(tmp_path))
    (tmp_path / "b.tif").write_bytes(written(values.astype("u2"), ">u2", rows=4))
    assert volumes.read_tiff(spark, str(tmp_path)).count() == 32
    (tmp_path / "b.tif").write_bytes(b"II*\0" + bytes(20))
    with pytest.raises(Exception, match="TIFF|index|buffer|channel"):
        volumes.read_tiff(spark, str(tmp_path)).count()


@pytest.mark.parametrize("change", [{256: (0,)}, {277: (3,)}, {258: (1,)}, {259: (7,)}, {317: (2,), 339: (3,), 258: (32,)}, {273: (8, 9)}])
def test_headers_that_are_refused(change):
    good = {0: (False,), 256: (4,), 257: (4,), 258: (16,), 273: (8,), 279: (32,), 278: (4,)}
    assert len(tiff.segments(good)) == 1
    with pytest.raises(ValueError):
        tiff.segments(good | change)
