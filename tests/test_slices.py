import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import crop, gather, volume as V
from tessera.sources import volumes
from tests.test_places import field, linear, rows_of


@pytest.mark.parametrize(("orientation", "degrees"), [("top_down", 30.0), ("front_back", -50.0), ("left_right", 75.0), ("front_back", None)])
def test_slices_of_a_turned_volume(spark, tmp_path, orientation, degrees):
    dims, spacing, origin = (7, 6, 40), (1.0, 1.5, 0.5), (3.0, -2.0, 1.0)
    values = field(np.random.default_rng(3), dims)
    v = rows_of(spark, values).withColumn("valid", F.col("idx") % 7 != 3)
    move = G.rotation(2, 15) @ np.diag([1.0, 1.0, 1.25, 1.0])
    folder, to = volumes.write_slices(v, dims, str(tmp_path / "out.png"), orientation, 700.0, 300.0, move, spacing, origin, degrees, (1.0, 2.0, 3.0))
    assert folder == str(tmp_path / "out")
    placed = G.slice_matrix(move, orientation, (1.0, 2.0, 3.0), degrees)
    grid, low = gather.turned_grid(dims, spacing, origin, placed)
    assert to == grid
    z, y, x = (a.ravel() for a in np.indices(to[::-1]))
    world = np.stack([x, y, z], 1) * np.array(spacing) + low
    model = (np.linalg.inv(placed) @ np.concatenate([world, np.ones((len(world), 1))], 1).T).T[:, :3]
    at = (model - np.array(origin)) / np.array(spacing)
    want = linear(values, at, float(values.min())).astype(np.float32).astype(float)
    gray = np.floor(np.clip((want + 50.0) / 700.0, 0, 1) * 255 + 0.5)
    near = np.floor(at + 0.5).astype(int)
    there = ((near >= 0) & (near < np.array(dims))).all(1)
    idx = near[:, 0] + dims[0] * (near[:, 1] + dims[1] * near[:, 2])
    gray = np.where(there & (idx % 7 != 3), gray, 0).reshape(to[::-1])
    axis, u, w, *_ = G.ORIENTATIONS[orientation]
    planes = gray.transpose(tuple("zyx".index(c) for c in (axis, w, u)))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == [f"{orientation.capitalize()}_{k:04d}.png" for k in range(len(planes))]
    got = np.stack([volumes.png_pixels((tmp_path / "out" / n).read_bytes())[::-1] for n in names])
    assert got.shape == planes.shape
    assert (np.abs(got - planes) > 1).mean() < 0.01 and (got != planes).mean() < 0.02 and got.max() > 0  # places on a voxel's border may fall either way


def test_slices_without_a_mask_are_those_of_the_volume(spark, tmp_path):
    dims = (130, 5, 9)
    values = field(np.random.default_rng(5), dims)
    folder, to = volumes.write_slices(rows_of(spark, values), dims, str(tmp_path), "front_back", 950.0, 425.0)
    assert to == dims
    for k in range(5):
        gray = np.floor(np.clip((values[:, k, :].astype(float) + 50.0) / 950.0, 0, 1) * 255 + 0.5)
        assert (volumes.png_pixels((tmp_path / f"Front_back_{k:04d}.png").read_bytes())[::-1] == gray).all()


def test_slice_requests_are_checked_before_a_folder_is_made(spark, tmp_path):
    v = rows_of(spark, field(np.random.default_rng(1), (2, 2, 2)))
    good = {"orientation": "top_down", "window": 10.0, "center": 5.0, "matrix": np.eye(4)}
    for bad in ({"orientation": "sideways"}, {"window": float("nan")}, {"matrix": np.zeros((4, 4))}, {"spacing": (1.0, 0.0, 1.0)}, {"origin": (0.0, float("inf"), 0.0)}):
        with pytest.raises(ValueError):
            volumes.write_slices(v, (2, 2, 2), str(tmp_path / "new"), **(good | bad))
    assert not (tmp_path / "new").exists()
    with pytest.raises(ValueError):
        volumes.png_pixels(volumes.png(np.zeros((2, 2)))[:-6] + b"damage")


def test_a_buffer_becomes_a_flipped_volume(spark):
    values = np.arange(24, dtype="<f4").reshape(4, 3, 2)
    v, origin = volumes.from_buffer(spark, values, (2, 3, 4), (0.5, 2.0, 1.0), (10.0, -1.0, 7.0))
    assert origin == (-10.5, -3.0, 7.0)
    assert {(r.x, r.y, r.z): (r.value, r.idx) for r in v.collect()} == {(x, y, z): (values[z, 2 - y, 1 - x], x + 2 * y + 6 * z) for z in range(4) for y in range(3) for x in range(2)}
    plain, same = volumes.from_buffer(spark, values.ravel(), (2, 3, 4), flip=False)
    assert same == (0, 0, 0) and [r.value for r in plain.orderBy("idx").collect()] == list(range(24))
    for bad in ((2, 3, 5), (2, 3, 0), (-2, -3, 4)):
        with pytest.raises(ValueError):
            volumes.from_buffer(spark, values, bad)


def test_checks_of_snapshots_inputs_and_compiled_operations(spark):
    assert G.check_layout((2, 3, 4)) == 24
    for bad in (((1 << 30, 1 << 30, 2),), ((1, 1, 1), (1, 1, float("nan"))), ((1, 1, 1), (1, 1, 1), (0, 0, 0), 2)):
        with pytest.raises(ValueError):
            G.check_layout(*bad)
    good = {"version": 3, "dims": (2, 2, 2), "image_dims": (2, 2, 2), "spacing": (1, 1, 1), "origin": (0, 0, 0), "span": (1.0, 1.0)}
    G.check_snapshot(**good)
    for bad in ({"version": 0}, {"dims": (2, 2, 3)}, {"spacing": (1, -1, 1)}, {"span": (2.0, 1.0)}, {"span": (float("nan"), 1.0)}):
        with pytest.raises(ValueError):
            G.check_snapshot(**(good | bad))
    shape = {"dims": (2, 2, 2), "spacing": (1, 1, 1), "origin": (0, 0, 0), "direction": np.eye(3)}
    mask, t, bounds = shape | {"type": "uint8", "components": 1}, spark.range(1), [(0, 1)] * 3
    crop.check_input(1, bounds, shape, mask)
    crop.check_input(1, bounds, triangles=t)
    for bad in ((0, bounds, shape), (1, [(0, 1), (1, 1), (0, 1)], shape), (1, bounds), (1, bounds, shape, None, t), (1, bounds, None, mask, t), (1, bounds, shape, mask | {"dims": (2, 2, 1)})):
        with pytest.raises(ValueError):
            crop.check_input(*bad)
    ops = G.crop_table([{"id": 1, "shape": "box", "mode": "keep", "matrix": np.diag([2.0, 4, 5, 1])}, {"id": 2, "shape": "plane", "mode": "remove", "center": (0, 0, 0), "normal": (0, 0, 3)}])
    G.check_compiled(ops, 2)
    G.check_compiled([*ops, {"shape": "cone", "mode": "keep"}], 2)  # only the active ones count
    for bad, count in (([*ops, {"shape": "cone", "mode": "keep"}], 3), (ops, 3), (ops, -1), ([ops[0] | {"inverse": np.zeros((3, 4))}], 1), ([ops[0] | {"inverse": np.eye(4)}], 1), ([ops[1] | {"normal": (0, 0, 0)}], 1), ([ops[1] | {"center": (0, float("inf"), 0)}], 1)):
        with pytest.raises(ValueError):
            G.check_compiled(bad, count)
    v = V.with_index(spark.range(8).withColumnRenamed("id", "idx"), 2, 2).withColumn("value", F.lit(1.0))
    with pytest.raises(ValueError):
        crop.cropped(v, ops, 3)
