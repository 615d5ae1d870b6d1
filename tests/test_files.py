import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import bricks, mesh, volume as V
from tessera.sources import volumes
from tessera.sources.files import write_pieces


def ramp(spark, n, formula="x + y + z"):
    grid = V.with_index(spark.range(n**3).withColumnRenamed("id", "idx"), n, n)
    return grid.withColumns({"value": F.expr(f"cast({formula} as float)"), "valid": F.lit(True)})


def volume_of(triangles):
    """Signed volume that a closed mesh encloses."""
    t = triangles.toPandas().to_numpy().reshape(-1, 3, 3)
    return float(np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6)


BALL = "10 - sqrt(pow(x - 20, 2) + pow(y - 20, 2) + pow(z - 20, 2))"


def test_raw_round_trip_flips_twice(spark, tmp_path):
    v = V.with_index(spark.range(60).withColumnRenamed("id", "idx"), 3, 4).withColumn("value", (F.col("idx") / 3).cast("float"))
    path = volumes.write_raw(v, (3, 4, 5), str(tmp_path))
    assert path.endswith("3x4x5_transform.raw")
    assert np.array_equal(np.fromfile(path, "<f4"), (np.arange(60) / 3).astype("<f4"))
    named = tmp_path / "scan_3x4x5.raw"
    named.write_bytes(open(path, "rb").read())
    back = volumes.read_raw(spark, str(named))
    flipped = V.lps_to_ras(v, 3, 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flipped.select(*back.columns).collect()))
    with pytest.raises(ValueError):
        volumes.read_raw(spark, str(named), (3, 4, 6))
    with pytest.raises(ValueError):
        volumes.read_raw(spark, str(named), (3, 0, 5))


def test_pieces_keep_other_files_and_refuse_paths(spark, tmp_path):
    (tmp_path / "other").write_text("stays")
    rows = [("a.bin", 3, b"def"), ("a.bin", 0, b"abc")]
    write_pieces(spark.createDataFrame(rows, "name string, at long, data binary"), str(tmp_path))
    assert (tmp_path / "a.bin").read_bytes() == b"abcdef" and sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "other"]
    with pytest.raises(Exception, match="not a file name"):
        write_pieces(spark.createDataFrame([("../b", 0, b"x")], "name string, at long, data binary"), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "other"]


def tiff(values):
    body = values.astype("<u2").tobytes()
    tags = [(256, 3, values.shape[1]), (257, 3, values.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, 8), (278, 3, values.shape[0]), (279, 4, len(body))]
    head = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags))
    return head + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)


def test_tiff_planes_in_natural_order(spark, tmp_path):
    for name, add in (("p10.tif", 200), ("p9.TIFF", 100), ("p1.tif", 0)):
        (tmp_path / name).write_bytes(tiff(np.arange(6).reshape(2, 3) + add))
    got = {(r.x, r.y, r.z): r.value for r in volumes.read_tiff(spark, str(tmp_path), flip=False).collect()}
    assert got == {(x, y, z): 100 * z + 3 * y + x for x in range(3) for y in range(2) for z in range(3)}
    (tmp_path / "p2.tif").write_bytes(tiff(np.zeros((3, 3))))
    with pytest.raises(ValueError):
        volumes.read_tiff(spark, str(tmp_path))


def test_slices_as_pictures(spark, tmp_path):
    rows = [(0, 0, 0, 0, 0.0, True), (1, 1, 0, 0, 100.0, False), (2, 0, 1, 0, 75.0, True), (3, 1, 1, 0, 100.0, True)]
    v = spark.createDataFrame(rows, "idx long, x int, y int, z int, value float, valid boolean")
    got = volumes.slice_pictures(v, (2, 2, 1), "top_down", 100.0, 50.0)
    write_pieces(got, str(tmp_path))
    data = (tmp_path / "Top_down_0000.png").read_bytes()
    at = data.index(b"IDAT")
    body = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert body == bytes([0, 191, 255, 0, 0, 0])  # the upper row comes first, each after its filter byte


def test_iso_surface_is_closed_across_bricks(spark):
    t = bricks.iso_surface(ramp(spark, 41, BALL), 0.0).cache()
    ends = [F.array(*[F.col(c) for c in cs]) for cs in mesh.CORNERS]
    key = t.select(F.explode(F.array(*[F.array_sort(F.array(ends[i], ends[(i + 1) % 3])) for i in range(3)])).alias("e"))
    assert key.groupBy("e").count().where("count % 2 = 1").count() == 0
    assert volume_of(t) == pytest.approx(4 / 3 * np.pi * 1000, rel=0.02)
    outward = mesh.points(t).select(((F.col("x") - 20) * F.col("nx") + (F.col("y") - 20) * F.col("ny") + (F.col("z") - 20) * F.col("nz")).alias("d")).agg(F.min("d")).first()[0]
    assert outward > 9
    assert bricks.iso_surface(ramp(spark, 5).withColumn("valid", F.lit(False)), 2.5).count() == 0


def test_moving_and_clipping_meshes(spark):
    t = bricks.iso_surface(ramp(spark, 41, BALL), 0.0).cache()
    m = np.diag([-2.0, 1, 1, 1]) + np.array([[0, 0, 0, 5], [0] * 4, [0] * 4, [0] * 4])
    assert volume_of(mesh.moved(t, m)) == pytest.approx(2 * volume_of(t), rel=1e-9)
    with pytest.raises(ValueError):
        mesh.moved(t, np.zeros((4, 4)))
    half = mesh.clipped(t, lambda p: p[0] > 20)
    got = half.select(F.min(F.least("x0", "x1", "x2"))).first()[0]
    assert 19 <= got <= 20.1
    area = lambda d: d.select(F.sqrt(sum((c * c for c in mesh.triangle_normal()), F.lit(0.0))).alias("a")).agg(F.sum("a")).first()[0] / 2
    assert area(half) + area(mesh.clipped(t, lambda p: p[0] <= 20)) == pytest.approx(area(t), rel=1e-9)


@pytest.mark.parametrize("suffix", [".ply", ".stl", ".obj"])
def test_mesh_files(spark, tmp_path, suffix):
    t = bricks.iso_surface(ramp(spark, 4), 2.5).cache()
    data = open(mesh.write_mesh(t, str(tmp_path), (4, 4, 4), suffix, (0, 255, 70) if suffix == ".ply" else None), "rb").read()
    n, m = t.count(), mesh.points(t).count()
    if suffix == ".stl":
        assert len(data) == 84 + 50 * n and int.from_bytes(data[80:84], "little") == n
        found = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
        assert np.allclose(np.linalg.norm(found["n"], axis=1), 1, atol=1e-5) and np.allclose(found["p"].sum(2), 2.5)
    elif suffix == ".ply":
        start = data.index(b"end_header\n") + 11
        points = np.frombuffer(data, np.dtype([("p", "<f4", 3), ("n", "<f4", 3), ("c", "u1", 3)]), m, start)
        faces = np.frombuffer(data, np.dtype([("k", "u1"), ("i", "<i4", 3)]), n, start + points.nbytes)
        assert start + points.nbytes + faces.nbytes == len(data) and (faces["k"] == 3).all()
        assert set(faces["i"].ravel()) == set(range(m)) and (points["c"] == (0, 255, 70)).all() and np.allclose(points["p"].sum(1), 2.5)
    else:
        lines = data.decode().splitlines()
        assert [sum(x.startswith(k) for x in lines) for k in ("v ", "vn ", "f ")] == [m, m, n]
        assert max(int(a.split("//")[0]) for x in lines if x.startswith("f ") for a in x.split()[1:]) == m


def test_empty_mesh_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        mesh.write_mesh(bricks.iso_surface(ramp(spark, 4), 99.0), str(tmp_path), (4, 4, 4), ".ply")


def test_diffusion_smooths_noise_and_keeps_the_step(spark):
    noisy = ramp(spark, 36, "case when x < 18 then 0.25 else 0.75 end + 0.005 * sin(7 * x + 13 * y + 29 * z)")
    before, after = noisy.where("x < 17").agg(F.var_pop("value")).first()[0], bricks.denoised(noisy)
    assert after.count() == 36**3 and after.where("x < 17").agg(F.var_pop("value")).first()[0] < 0.8 * before
    sides = after.groupBy((F.col("x") < 18).alias("left")).agg(F.avg("value").alias("v")).collect()
    assert abs(sides[0].v - sides[1].v) > 0.45


def test_names_matrices_and_requests():
    assert G.raw_dims("/a/scan_3x4x5.raw") == (3, 4, 5) and G.raw_dims("scan_0x4x5.raw") is None and G.raw_dims("scan_3x4x5.bin") is None
    assert G.downsampled_dims((900, 450, 225)) == (766, 383, 191) and G.downsampled_dims((900, 450, 225), 256) == (256, 128, 64) and G.downsampled_dims((128, 64, 32), 256) == (128, 64, 32)
    assert G.is_affine(np.diag([1e-8, 1e-8, 1e-8, 1])) and not G.is_affine(np.diag([1.0, 1, 0, 1])) and not G.is_affine(np.full((4, 4), np.nan)) and not G.is_affine(np.ones((4, 4)))
    assert np.allclose(G.slice_matrix(np.eye(4), "left_right", (0, 1, 0), 90) @ [0, 2, 0, 1], [0, 1, 1, 1])
    assert np.allclose(G.model_matrix(np.eye(4), (1, 0, 0), (0, 0, 90), (2, 0, 1)) @ [1, 0, 0, 1], [1, 2, 0, 1])
    assert G.world_bounds(G.box_matrix((0, 0, 0), (2, 4, 6)), (-1, -1, -1), (1, 1, 1)) == ([0, 0, 0], [2, 4, 6])
    assert G.window_drag(100, 50, 100, 100, 2, -4) == (8, -10) and G.export_format("iso") == ".ply"
    box = {"id": 1, "shape": "box", "mode": "keep", "matrix": np.diag([2.0, 4, 5, 1])}
    assert G.crop_table([box])[0]["inverse"][1] == [0, 0.25, 0, 0]
    for bad in ([box, box], [box | {"id": 0}], [box | {"shape": "cylinder"}], [box | {"matrix": np.zeros((4, 4))}], [{"id": 2, "shape": "plane", "mode": "keep", "center": (0, 0, 0), "normal": (0, 0, 0)}]):
        with pytest.raises(ValueError):
            G.crop_table(bad)
    for nodes in ([], [(0.5, 0), (0.4, 1)], [(0, 2)]):
        with pytest.raises(ValueError):
            G.check_nodes(nodes)


def test_mesh_colours(spark):
    nodes = [(0, 0, 1, 0), (1, 0, 1, 1)]
    assert tuple(spark.range(1).select(*mesh.color(F.lit(2.5), nodes, 0, 9)).first()) == (0, 255, 71)
    assert tuple(spark.range(1).select(*mesh.color(F.lit(2.5), [], 0, 9)).first()) == (71, 71, 71)
    assert tuple(spark.range(1).select(*mesh.color(F.lit(3.0), [], 3, 3)).first()) == (255, 255, 255)
