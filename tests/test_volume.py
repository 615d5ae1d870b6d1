import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import components, dealing, volume as V


def faces(p):
    return [tuple(a + d * (i == axis) for i, a in enumerate(p)) for axis in range(3) for d in (-1, 1)]


def cube(spark, n, hole, mask=()):
    rows = [(x + n * y + n * n * z, x, y, z, 0.0 if all(a in hole for a in (x, y, z)) else 1.0, (x, y, z) not in mask) for z in range(n) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "idx long, x int, y int, z int, value float, valid boolean")


def test_enclosed_cube_is_one_region(spark):
    v = cube(spark, 7, (2, 3, 4))
    cells = V.interior(v, 0.5, (7, 7, 7))
    r = V.regions(cells).collect()
    assert len(r) == 1 and (r[0].id, r[0].voxels, r[0].cx, r[0].cy, r[0].cz) == (1, 27, 3, 3, 3)
    assert (r[0].min_x, r[0].max_x, r[0].n_xy) == (2, 4, 9)
    s = V.surfaces(cells).first()
    assert s.crossings == 386 and s.surface == pytest.approx(29.6923077) and s.gap == pytest.approx(1.8186528)
    assert s.compactness == pytest.approx(3.1495466) and s.sphericity == pytest.approx(1.4658268)
    p = V.porosity(v, cells).first()
    assert (p.object_voxels, p.void_voxels, p.porosity) == (316, 27, pytest.approx(27 / 343))


def test_invalid_voxel_opens_the_void(spark):
    assert V.interior(cube(spark, 7, (2, 3, 4), {(3, 3, 3)}), 0.5, (7, 7, 7)).count() == 0


def test_erosion_and_regrowth(spark):
    cells = V.interior(cube(spark, 7, (2, 3, 4)), 0.5, (7, 7, 7))
    assert V.opened(cells, 1).count() == 27 and V.opened(cells, 2).count() == 0


def test_crop_in_single_precision(spark):
    e = 1e-6
    box = {"shape": "box", "mode": "keep", "inverse": [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]}
    rows = spark.createDataFrame([(1 - e,), (1.0,), (1 + e,), (1 + 2 * e,), (float("nan"),)], "x double").select(F.col("x").cast("float").alias("x"), F.lit(0).cast("float").alias("y"), F.lit(0).cast("float").alias("z"))
    p = (F.col("x"), F.col("y"), F.col("z"))
    assert [r[0] for r in rows.select(V.kept(p, [box], 1)).collect()] == [True, True, True, False, False]
    plane = {"shape": "plane", "center": [0, 0, 0], "normal": [1, 0, 0]}
    points = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "x float").select("x", F.lit(0).cast("float").alias("y"), F.lit(0).cast("float").alias("z"))
    for mode, want in (("keep", [False, False, True]), ("remove", [True, True, False])):
        assert [r[0] for r in points.select(V.kept(p, [plane | {"mode": mode}], 1)).collect()] == want


def test_histogram_and_percentiles(spark):
    v = spark.createDataFrame([(float(i),) for i in range(4)], "value float")
    assert [(r.intensity, r.frequency) for r in V.histogram(v, 4).orderBy("bin").collect()] == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert [r.value for r in V.histogram_percentile(v, [0, 0.5, 1, -0.1], 4).orderBy("q").collect()] == [None, 0, 1, 3]
    same = spark.createDataFrame([(7.0,)] * 4, "value float")
    assert V.histogram_percentile(same, [0.37]).first().value == 7


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(3, 3), (29, 2)]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {i: 100 for i in range(100, 141)} | {i: 2 for i in [2, *range(5, 30)]}


def counted(monkeypatch, module):
    """The names of the tables that module writes from now on."""
    names, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name, *more: names.append(name) or cut(df, name, *more))
    return names


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    names = counted(monkeypatch, components)
    edges = [(1, i) for i in range(2, 30)] + [(40, 31), (31, 41), (7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {i: 1 for i in range(1, 30)} | {i: 31 for i in (31, 40, 41)} and len(got) == 32
    assert names == ["edges"]
    none = components.connected_components(spark.createDataFrame([], "src long, dst long"))
    assert none.count() == 0 and names == ["edges"] * 2


def test_components_after_further_edges(spark):
    random = np.random.default_rng(11)
    for more in (0, 1, 25):
        first, then = ([tuple(int(x) for x in pair) for pair in random.integers(0, 150, (n, 2))] for n in (60, more))
        root = list(range(150))
        find = lambda i: i if root[i] == i else find(root[i])
        for a, b in first + then:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        tables = [spark.createDataFrame(x, "src long, dst long") for x in (first, then)]
        got = components.joined_components(components.connected_components(tables[0]), tables[1]).collect()
        met = {i for a, b in first + then if a != b for i in (a, b)}
        assert len(got) == len(met) and {r.node: r.component for r in got} == {i: find(i) for i in met}


def test_garbage_of_the_driver_is_collected_after_some_tables(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(storage, "collect_garbage", calls.append)
    for _ in range(2 * storage.TABLES):
        storage.cut(spark.range(1), "one")
    assert calls == [spark, spark]


def test_bricks_label_erode_and_count_as_the_whole_does(spark):
    n, random = 9, np.random.default_rng(5)
    there = random.random((n, n, n)) < 0.55
    rows = [(int(x + n * y + n * n * z), int(x), int(y), int(z)) for z, y, x in np.argwhere(there)]
    cells = spark.createDataFrame(rows, "idx long, x int, y int, z int")
    at = {(x, y, z): i for i, x, y, z in rows}
    root: dict[int, int] = {}
    for place in sorted(at, key=at.get):
        todo = [] if at[place] in root else [place]
        while todo:
            p = todo.pop()
            if root.setdefault(at[p], at[place]) == at[place]:
                todo += [q for q in faces(p) if q in at and at[q] not in root]
    want = sorted(root.items())
    held = V.labelled(cells, 4)
    assert sorted((r.idx, r.root) for r in held.collect()) == want
    left = {p for p in at if all(q in at for q in faces(p))}
    assert {r.root for r in dealing.eroded_roots(held, 1, 4).collect()} == {root[at[p]] for p in left}
    left = {p for p in left if all(q in left for q in faces(p))}
    assert {r.root for r in dealing.eroded_roots(held, 2, 4).collect()} == {root[at[p]] for p in left}
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]
    inside = Counter(root[i] for p, i in at.items() for s in steps if root.get(at.get(tuple(a + b for a, b in zip(p, s)))) == root[i])
    assert {r.root: (r.voxels, r.inside) for r in dealing.contacts(held, 4).collect()} == {k: (v, inside[k]) for k, v in Counter(root.values()).items()}
    assert V.labelled(cells.limit(0)).count() == 0
