import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import volume as V
from tessera.sources import export

N = 24
NODES = [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.5, 0.0)]


def ball(spark):
    grid = V.with_index(spark.range(N**3).withColumnRenamed("id", "idx"), N, N)
    return grid.withColumn("value", F.expr("cast(8.3 - sqrt(pow(x - 12, 2) + pow(y - 12, 2) + pow(z - 12, 2)) as float)"))


def ply(path):
    data = open(path, "rb").read()
    start = data.index(b"end_header\n") + 11
    n, m = (int(data.split(b"element " + k + b" ")[1].split(b"\n")[0]) for k in (b"vertex", b"face"))
    points = np.frombuffer(data, np.dtype([("p", "<f4", 3), ("n", "<f4", 3), ("c", "u1", 3)]), n, start)
    faces = np.frombuffer(data, np.dtype([("k", "u1"), ("i", "<i4", 3)]), m, start + points.nbytes)
    assert start + points.nbytes + faces.nbytes == len(data)
    return points, faces["i"]


def test_colours_of_a_volume_at_the_points(spark, tmp_path):
    v = ball(spark)
    move = G.translation((3.0, 1.0, -2.0)) @ G.rotation(2, 90)
    tint = v.withColumn("value", (F.col("x") / (N - 1)).cast("float"))
    lo, hi = map(float, V.scalar_range(v).first())
    points, faces = ply(export.export(v, (N, N, N), str(tmp_path), ".PLY", move, iso=0.0, nodes=NODES, tint=tint))
    own = points["p"].astype(float) @ np.linalg.inv(move)[:3, :3].T + np.linalg.inv(move)[:3, 3]
    assert np.abs(np.linalg.norm(own - 12, axis=1) - 8.3).max() < 0.1
    share = (own[:, 0] / (N - 1) - lo) / (hi - lo)
    assert np.abs(points["c"] - 255 * np.stack([share, share / 2, 0 * share], 1)).max() <= 0.51
    assert set(faces.ravel()) == set(range(len(points))) and len(points) - len(faces) * 3 // 2 + len(faces) == 2
    plain, _ = ply(export.export(v, (N, N, N), str(tmp_path / "one"), ".ply", np.eye(4), iso=0.0, nodes=NODES))
    share = -lo / (hi - lo)
    assert (np.abs(plain["c"] - np.array([255 * share, 127.5 * share, 0])) <= 0.51).all()


def test_meshes_follow_the_mask(spark, tmp_path):
    v = ball(spark).withColumn("valid", F.col("x") <= 12)
    points, faces = ply(export.export(v, (N, N, N), str(tmp_path), ".ply", np.diag([2.0, 1, 1, 1]), iso=0.0))
    assert points["p"][:, 0].max() == pytest.approx(25.0) and len(faces) > 100
    with pytest.raises(ValueError):
        export.export(v.withColumn("valid", F.lit(False)), (N, N, N), str(tmp_path / "none"), ".stl", np.eye(4), iso=0.0)
    assert not (tmp_path / "none").exists()


def test_everything_is_checked_before_a_folder_is_made(spark, tmp_path):
    v, away = ball(spark), str(tmp_path / "new")
    assert export.export(v, (N, N, N), str(tmp_path), ".Raw", np.eye(4)).endswith(f"{N}x{N}x{N}_transform.raw")
    for bad in ({"suffix": ".vtk"}, {"matrix": np.zeros((4, 4))}, {"iso": None}, {"iso": float("nan")}, {"nodes": [(2.0, 0, 0, 0)]}):
        with pytest.raises(ValueError):
            export.export(v, (N, N, N), away, **({"suffix": ".ply", "matrix": np.eye(4), "iso": 0.0} | bad))
    assert not (tmp_path / "new").exists()
