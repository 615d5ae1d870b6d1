import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_files import ramp, volume_of
from tests.test_volume import cube
from tessera.operators import bricks, crop, voids, volume as V

HOLE = (2, 3, 4)
SEVEN = (7, 7, 7)


@pytest.mark.parametrize("erosions, left", [(0, 27), (1, 27), (2, 0)])
def test_chain_over_an_enclosed_cube(spark, erosions, left):
    v = cube(spark, 7, HOLE)
    iso = voids.iso_by_ratio(v, 0.5)
    assert iso == 0.5
    cells = voids.candidates(v, iso, 0.1, SEVEN, erosions)
    regions = voids.region_table(cells)
    labelled = voids.labels(v, cells, regions)
    assert cells.count() == left and regions.count() == (left > 0) and labelled.where("label = 1").count() == left
    s = voids.statistics(labelled).first()
    assert (s.object_voxels, s.void_voxels, s.porosity) == (343 - left, left, pytest.approx(left / 343))
    if erosions == 1:
        r = regions.first()
        assert (r.id, r.voxels, r.volume, r.cx, r.cy, r.cz, r.extent_x) == (1, 27, 27, 3, 3, 3, 3)
        assert 20 < volume_of(voids.void_mesh(labelled)) < 27


def test_a_masked_voxel_opens_the_void_and_whole_numbers_count_alike(spark):
    v = cube(spark, 7, HOLE, {(3, 3, 3)})
    assert voids.candidates(v, 0.5, 0.1, SEVEN, 0).count() == 0
    short = cube(spark, 7, HOLE).withColumn("value", F.col("value").cast("short").cast("float"))
    assert voids.candidates(short, 0.5, 0.1, SEVEN, 1).count() == 27


def test_a_bright_plane_parts_two_regions_and_small_ones_are_dropped(spark):
    v = cube(spark, 9, (2, 3, 4, 5, 6)).withColumn("value", F.when(F.col("x").eqNullSafe(3) & (F.col("value") == 0), 0.3).otherwise(F.col("value")).cast("float"))
    cells = voids.candidates(v, 0.5, 0.1, (9, 9, 9), 0)
    regions = voids.region_table(cells)
    assert sorted((r.id, r.voxels) for r in regions.collect()) == [(1, 25), (2, 75)]
    # The thin one has no voxel with six dark neighbours.
    assert {r.voxels for r in voids.region_table(voids.candidates(v, 0.5, 0.1, (9, 9, 9), 1)).collect()} == {75}
    large = voids.region_table(cells, min_volume=26)
    labelled = voids.labels(v, cells, large)
    assert [(r.id, r.voxels) for r in large.collect()] == [(1, 75)] and voids.statistics(labelled).first().void_voxels == 75


def test_bad_labels_and_ratios_are_refused(spark):
    v = cube(spark, 3, (1,), {(0, 0, 0)})
    for label in ("-1", "1"):
        with pytest.raises(Exception, match="labels don't fit"):
            voids.statistics(v.withColumn("label", F.expr(f"if(idx = 0, {label}, 0)"))).collect()
    with pytest.raises(ValueError):
        voids.statistics(v.withColumn("label", F.lit(0)), (1, 0, 1))
    with pytest.raises(ValueError):
        voids.iso_by_ratio(v, 1.5)


def test_voxels_that_are_no_numbers_are_left_out(spark):
    v = spark.createDataFrame([(float("nan"),), (0.0,), (3.0,), (1.0,)], "value float")
    assert tuple(V.scalar_range(v).first()) == (0, 3)
    assert [r.frequency for r in V.histogram(v, 4).orderBy("bin").collect()] == [1, 1, 0, 1]
    assert [tuple(r) for r in V.percentile_preset(spark.createDataFrame([(7.0,)] * 3, "value float")).collect()] == [(0, 1)]
    assert sorted(tuple(r) for r in V.percentile_preset(v).collect()) == [(0, 0), (1, 1)]


def test_crop_results_and_empty_ones(spark):
    v = cube(spark, 4, (), {(3, 3, 3)})
    plane = {"shape": "plane", "center": [1, 0, 0], "normal": [1, 0, 0], "mode": "keep"}
    masked = crop.cropped(v, [plane, plane | {"mode": "remove"}], 1)
    assert masked.where("valid").count() == 31 and {r.z: r.kept for r in crop.kept_counts(masked).collect()} == {0: 8, 1: 8, 2: 8, 3: 7}
    with pytest.raises(crop.EmptyResult):
        crop.cropped(v, [plane, plane | {"mode": "remove"}], 2)
    shape = bricks.iso_surface(ramp(spark, 4), 2.5).cache()
    assert crop.cropped_mesh(shape, [plane], 1).count() > 0
    with pytest.raises(crop.EmptyResult):
        crop.cropped_mesh(shape, [plane, plane | {"mode": "remove"}], 2)


def test_a_history_of_513_operations(spark, monkeypatch):
    box = {"shape": "box", "mode": "keep", "inverse": [[0.5, 0, 0, 0.1], [0, 0.5, 0, 0], [0, 0, 0.5, 0]]}
    plane = {"shape": "plane", "mode": "remove", "center": [0.3, 0, 0], "normal": [0.6, 0, 0.8]}
    points = [(float(np.float32(v)),) for v in (-9, -1.9, 0, 0.1, 0.3, 0.30000001, 1.8, 1.8000001, 3, float("nan"), float("inf"))]
    rows = spark.createDataFrame(points, "v float").coalesce(1)
    p = (F.col("v"),) * 3
    want = [r[0] for r in rows.select(V.kept(p, [box, plane], 2)).collect()]
    assert [r[0] for r in rows.select(V.kept(p, [box, plane] * 257, 513)).collect()] == want and True in want
    monkeypatch.setattr(V, "COMPILED", 0)
    assert [r[0] for r in rows.select(V.kept(p, [box, plane], 2)).collect()] == want
    assert [r[0] for r in rows.select(V.kept(p, [box, plane], 1)).collect()] != want


def test_masks_corners_and_operations(spark):
    volume = {"type": "float32", "components": 1, "dims": (3, 4, 5), "spacing": (1, 1, 1), "origin": (0, 0, 0), "direction": np.eye(3)}
    mask = volume | {"type": "uint8"}
    crop.check_mask(volume, mask)
    for wrong in ({"type": "int16"}, {"components": 2}, {"dims": (3, 4, 6)}, {"spacing": (1, 1, 1 + 1e-12)}, {"direction": -np.eye(3)}):
        with pytest.raises(ValueError):
            crop.check_mask(volume, mask | wrong)
    crop.check_corners((3, 4, 5), np.eye(4))
    for wrong in (np.diag([1e39, 1, 1, 1]), np.diag([np.nan, 1, 1, 1])):
        with pytest.raises(ValueError):
            crop.check_corners((3, 4, 5), wrong)
    box = crop.box_operation(np.diag([2.0, 2, 2, 1]), np.diag([0.5, 1, 1, 1]), "keep", 1)
    assert np.allclose(np.diag(box["matrix"]), [1, 2, 2, 1])
    assert crop.same_operation(box, box | {"matrix": box["matrix"] * (1 + 1e-12)}) and not crop.same_operation(box, box | {"mode": "remove"}) and not crop.same_operation(box, box | {"matrix": np.eye(4)})
    plane = crop.plane_operation((1, 0, 0), (1, 1, 0), np.diag([2.0, 1, 1, 1]), "keep", 2)
    assert plane["center"] == [2, 0, 0] and np.allclose(plane["normal"], np.array([0.5, 1, 0]) / np.sqrt(1.25))
    with pytest.raises(ValueError):
        crop.plane_operation((0, 0, 0), (0, 0, 0), np.eye(4), "keep", 3)
    m = crop.box_from_corners((1, 1, 1), (3, 1, 1), (1, 5, 1), (1, 1, 7))
    assert np.allclose(m @ [-1, -1, -1, 1], [1, 1, 1, 1]) and np.allclose(m @ [1, 1, 1, 1], [3, 5, 7, 1])
    with pytest.raises(ValueError):
        crop.box_from_corners((0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 0, 1))


def test_downsampled_grids(spark):
    assert V.isotropic((900, 450, 225), (1, 1, 2), 766)[0] == (766, 383, 191) and V.isotropic((8, 4, 2), (1, 1, 2), 9) == ((8, 4, 2), (1, 1, 2))
    v = ramp(spark, 8)
    assert V.downsampled(v, (8, 8, 8), 4).agg(F.max(F.abs(F.col("value") - 2 * (F.col("x") + F.col("y") + F.col("z"))))).first()[0] == 0
    assert V.downsampled(v.withColumn("valid", F.col("x") < 4), (8, 8, 8), 4, mask=True).where("valid").agg(F.max("x")).first()[0] == 1
