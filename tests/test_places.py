import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import bricks, dealing, gather, mesh, volume as V
from tessera.plans import catalog, places
from tessera.sources import volumes

SF = "/root/testdata/sf0.001"


def field(rng, dims):
    return rng.integers(-50, 900, dims[::-1]).astype("<f4")


def rows_of(spark, values):
    z, y, x = (a.ravel() for a in np.indices(values.shape))
    idx = np.arange(values.size)
    return spark.createDataFrame(list(zip(idx.tolist(), x.tolist(), y.tolist(), z.tolist(), values.ravel().tolist(), strict=True)), "idx long, x int, y int, z int, value float")


def linear(values, at, outside=None, closed=True):
    """Plain trilinear values at index coordinates (n, 3) of x, y and z."""
    out = np.full(len(at), np.nan if outside is None else outside)
    last = np.array(values.shape[::-1]) - 1
    for n, p in enumerate(at):
        if not all(0 <= c <= d if closed else 0 <= c < d for c, d in zip(p, last, strict=True)):
            continue
        base = np.floor(p).astype(int)
        total = 0.0
        for k in range(8):
            bits = np.array([k & 1, k >> 1 & 1, k >> 2])
            w = np.prod(np.where(bits, p - base, 1 - (p - base)))
            if w > 0:
                x, y, z = np.minimum(base + bits, last)
                total += w * float(values[z, y, x])
        out[n] = total
    return out


MATRICES = {
    "turn": G.translation((3.0, -2.0, 7.0)) @ G.rotation(2, 30) @ G.rotation(0, 20),
    "mirror and shear": np.array([[-1, 0.3, 0, 2], [0, 0.8, 0.1, -5], [0, 0, 1.6, 0], [0, 0, 0, 1.0]]),
    "quarter": G.rotation(1, 90),
}


@pytest.mark.parametrize("name", MATRICES)
def test_turned_file_by_plain_numpy(spark, tmp_path, name):
    dims, spacing, origin, m = (37, 9, 6), (0.5, 1.0, 2.0), (1.0, -4.0, 0.25), MATRICES[name]
    values = field(np.random.default_rng(6), dims)
    path, to = volumes.write_turned(rows_of(spark, values).withColumn("valid", F.lit(False)), dims, str(tmp_path), m, spacing, origin)
    corners = np.array([[o + s * b * (d - 1) for o, s, b, d in zip(origin, spacing, bits, dims, strict=True)] for bits in np.ndindex(2, 2, 2)])
    turned = corners @ m[:3, :3].T + m[:3, 3]
    low, high = turned.min(0), turned.max(0)
    assert to == tuple(int(np.floor(d + 1e-3)) + 1 for d in (high - low) / spacing)
    assert path.endswith(f"/{to[0]}x{to[1]}x{to[2]}_transform.raw")
    z, y, x = (a.ravel() for a in np.indices(to[::-1]))
    back = (np.linalg.inv(np.block([[np.diag(spacing), np.array(origin)[:, None]], [np.zeros((1, 3)), 1]])) @ np.linalg.inv(m) @ np.block([[np.diag(spacing), low[:, None]], [np.zeros((1, 3)), 1]]))[:3]
    at = np.stack([x * r[0] + y * r[1] + z * r[2] + r[3] for r in back], 1)
    assert np.array_equal(np.fromfile(path, "<f4"), linear(values, at, float(values.min())).astype("<f4"))
    assert np.fromfile(path, "<f4").min() == values.min()


def test_no_file_for_a_matrix_without_inverse(spark, tmp_path):
    with pytest.raises(ValueError):
        volumes.write_turned(rows_of(spark, np.zeros((2, 2, 2), "f4")), (2, 2, 2), str(tmp_path / "new"), np.diag([1.0, 0, 1, 1]))
    assert not (tmp_path / "new").exists()


@pytest.mark.parametrize("to, back, outside", [((70, 3, 5), [[0.5, 0, 0, -1.25], [0, 1.5, 0, 0], [0, 0, 0.75, 0.5]], -7.0), ((9, 9, 9), [[4.0, 0, 0, 0], [0, 0, 0.4, 0], [0, 0.5, 0, 1]], None), ((4, 3, 5), [[0, 0, 0, 3.5], [0, 0, 0, 1], [0, 0, 1, 0]], -1.0)])
def test_regridded_by_plain_numpy(spark, to, back, outside):
    dims = (35, 5, 4)
    values = field(np.random.default_rng(1), dims)
    z, y, x = (a.ravel() for a in np.indices(to[::-1]))
    at = np.stack([x * r[0] + y * r[1] + z * r[2] + r[3] for r in np.array(back, float)], 1)
    want = linear(values, np.clip(at, 0, np.array(dims) - 1) if outside is None else at, outside)
    got = gather.regridded(rows_of(spark, values), dims, to, back, outside).orderBy("idx").toPandas()
    assert (got["idx"] == np.arange(len(want))).all() and (got["x"] == x).all() and (got["z"] == z).all()
    assert np.allclose(got["value"], want, rtol=0, atol=1e-9)
    near = gather.regridded(rows_of(spark, values), dims, to, back, -9.0, nearest=True).orderBy("idx").toPandas()["value"]
    n = np.floor(at + 0.5).astype(int)
    inside = ((n >= 0) & (n < dims)).all(1)
    assert (near[inside] == values[n[inside, 2], n[inside, 1], n[inside, 0]]).all() and (near[~inside] == -9).all()


def test_no_row_is_made_eightfold(spark):
    v = rows_of(spark, np.zeros((4, 4, 4), "f4"))
    for made in (V.resampled(v, (4, 4, 4), (3, 3, 3)), V.resliced(v, (4, 4, 4), (3, 3, 3), np.eye(4)[:3].tolist()), V.downsampled(v, (4, 4, 4), 2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Generate") <= 6  # bricks along three axes, once in each of the plan's forms


def test_points_between_bricks_and_outside(spark, monkeypatch):
    rng = np.random.default_rng(7)
    dims, spacing, origin = (70, 34, 33), (0.5, 2.0, 1.0), (-3.0, 1.0, 0.0)
    values = field(rng, dims)
    at = np.concatenate([rng.uniform(-2, 72, (150, 3)), rng.integers(0, 33, (60, 3)), [[32, 32, 32], [69, 33, 32], [31.5, 31.5, 31.5], [np.nan, 1, 1]], np.repeat([[5.5, 6.5, 7.5]], 50, 0)])
    two = np.roll(at, 1, axis=0)
    place = lambda p: (p * spacing + origin).tolist()
    data = [(i, *place(p), *place(q), "kept") for i, (p, q) in enumerate(zip(at, two, strict=True))]
    asked = spark.createDataFrame(data, "id int, x double, y double, z double, u double, v double, w double, value string")
    monkeypatch.setattr(gather, "POINTS", 20)
    for closed, outside in ((True, -1.0), (False, 0.0)):
        got = gather.sampled(asked, [("x", "y", "z"), ("u", "v", "w")], ["s", "t"], rows_of(spark, values), dims, spacing, origin, outside, closed).orderBy("id").toPandas()
        assert got.columns.tolist() == [*asked.columns, "s", "t"] and len(got) == len(at) and (got["value"] == "kept").all()
        back = lambda p: (np.array(place(p)) - origin) / spacing
        for name, own in (("s", at), ("t", two)):
            want = linear(values, np.array([back(p) for p in own]), outside, closed)
            assert np.allclose(got[name], want, rtol=0, atol=1e-9)
    assert gather.sampled(asked.limit(0), [("x", "y", "z")], ["s"], rows_of(spark, values), dims).count() == 0


def cut_triangle(p, s, level):
    """Area left of a triangle whose corners have the values s, by plain clipping of a polygon."""
    poly = []
    for i in range(3):
        a, b = (p[i], s[i]), (p[(i + 1) % 3], s[(i + 1) % 3])
        if a[1] > level:
            poly.append(a[0])
        if (a[1] > level) != (b[1] > level):
            poly.append(a[0] + (level - a[1]) / (b[1] - a[1]) * (b[0] - a[0]))
    return sum(np.linalg.norm(np.cross(poly[i] - poly[0], poly[i + 1] - poly[0])) / 2 for i in range(1, len(poly) - 1)) if len(poly) > 2 else 0.0


def test_mesh_clipped_by_a_mask(spark):
    n = 36
    grid = V.with_index(spark.range(n**3).withColumnRenamed("id", "idx"), n, n)
    ball = grid.withColumn("value", F.expr("cast(10.3 - sqrt(pow(x - 18, 2) + pow(y - 18, 2) + pow(z - 18, 2)) as float)"))
    masked = ball.withColumn("valid", F.expr("x + 2 * y < 58 or z % 7 = 0"))
    t = bricks.iso_surface(ball, 0.0).cache()
    got = mesh.clipped_by_mask(t, masked, (n, n, n)).toPandas().to_numpy()[:, :9].reshape(-1, 3, 3)
    mask = np.zeros((n, n, n))
    for r in masked.where("valid").select("x", "y", "z").collect():
        mask[r.z, r.y, r.x] = 255
    corners = t.toPandas().to_numpy()[:, :9].astype(float).reshape(-1, 3, 3)
    values = linear(mask, corners.reshape(-1, 3), -1.0).reshape(-1, 3)
    area = lambda x: np.linalg.norm(np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]), axis=1).sum() / 2
    assert area(got) == pytest.approx(sum(cut_triangle(p, s, 127.5) for p, s in zip(corners, values, strict=True)), rel=1e-9)
    left = linear(mask, got.reshape(-1, 3), -1.0)
    assert 0 < len(got) < len(corners) * 1.5 and (left > 0).all()
    whole = mesh.clipped_by_mask(t, ball, (n, n, n))
    assert whole.count() == t.count()
    away = mesh.clipped_by_mask(mesh.moved(t, G.translation((100.0, 0, 0))), ball, (n, n, n))
    assert away.count() == 0


def test_large_triangles_take_values_from_several_bricks(spark):
    dims = (70, 40, 5)
    values = np.full(dims[::-1], 0, "<f4")
    mask = rows_of(spark, values).withColumn("valid", F.col("x") >= 35)
    t = spark.createDataFrame([(1.0, 1.0, 1.0, 65.0, 1.0, 1.0, 65.0, 38.0, 1.0)], ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))
    got = mesh.clipped_by_mask(t, mask, dims).toPandas().to_numpy().reshape(-1, 3, 3)
    area = np.linalg.norm(np.cross(got[:, 1] - got[:, 0], got[:, 2] - got[:, 0]), axis=1).sum() / 2
    p = t.toPandas().to_numpy().reshape(3, 3)
    assert len(got) == 2 and area == pytest.approx(cut_triangle(p, [0, 255, 255], 127.5))


@pytest.mark.parametrize("formula, euler", [("10.3 - sqrt(pow(x - 20, 2) + pow(y - 20, 2) + pow(z - 20, 2))", 2), ("4.2 - sqrt(pow(sqrt(pow(x - 20, 2) + pow(y - 20, 2)) - 12, 2) + pow(z - 20, 2))", 0), ("10 - sqrt(pow(x - 20, 2) + pow(y - 20, 2) + pow(z - 20, 2))", 2)])
def test_points_have_one_number(spark, formula, euler):
    t = bricks.numbered_surface(V.with_index(spark.range(41**3).withColumnRenamed("id", "idx"), 41, 41).withColumn("value", F.expr(f"cast({formula} as float)")), 0.0).cache()
    r = mesh.counts(t).first()
    assert r.euler == euler and 2 * r.edges == 3 * r.triangles == 3 * t.count()
    found, faces = mesh.indexed(t)
    places_ = {r.number: (r.x, r.y, r.z) for r in found.collect()}
    assert len(set(places_.values())) == len(places_) == r.points and set(places_) == set(range(r.points))
    own = sorted(tuple(tuple(p[3 * i : 3 * i + 3]) for i in range(3)) for p in t.select(*[c for cs in mesh.CORNERS for c in cs]).collect())
    assert sorted(tuple(places_[p] for p in (f.p0, f.p1, f.p2)) for f in faces.collect()) == own
    joins = [line for line in faces._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("x0" in line or "y0" in line for line in joins)


def test_a_slice_opens_only_its_slab(spark, tmp_path):
    dims = (4, 3, 10)
    values = np.arange(120, dtype="<f4").reshape(10, 3, 4)
    path = tmp_path / "a_4x3x10.raw"
    path.write_bytes(values.tobytes())
    for flip in (True, False):
        whole = volumes.read_raw(spark, str(path), flip=flip)
        turned = values[:, ::-1, ::-1] if flip else values
        assert {(r.x, r.y, r.z): (r.value, r.idx) for r in whole.collect()} == {(x, y, z): (turned[z, y, x], x + 4 * y + 12 * z) for z in range(10) for y in range(3) for x in range(4)}
    options = {"path": f"file://{path}", "nx": 4, "ny": 3, "nz": 10, "slab": 96}  # two planes a task
    read = lambda **own: spark.read.format("tessera_raw").options(**options, **own).load()
    assert read().rdd.getNumPartitions() == 5
    for first, stop, tasks in ((3, 4, 1), (4, 6, 1), (3, 8, 3), (9, 40, 1), (-5, 1, 1), (6, 6, 1)):
        found = read(first=first, stop=stop)
        assert found.rdd.getNumPartitions() == tasks
        assert sorted({r.z for r in found.collect()}) == list(range(max(0, first), min(stop, 10)))
    one, two = (volumes.read_raw(spark, str(path), planes=(z, z + 1)) for z in (1, 2))
    both = one.union(two)
    assert both.count() == 24 and {r.z for r in both.collect()} == {1, 2} and volumes.read_raw(spark, str(path)).where("z = 3").count() == 12
    for bad in ((4, 3, 9), (4, 3, 11), (0, 3, 10)):
        with pytest.raises(ValueError):
            volumes.read_raw(spark, str(path), bad)
    with pytest.raises(ValueError):
        volumes.read_raw(spark, str(tmp_path / "none_4x3x10.raw"))


def test_region_plans(spark):
    cells = catalog.voids(spark, SF)
    found = V.regions(cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Window" not in plan
    brute = {}
    for r in cells.collect():
        for p in ("xy", "xz", "yz"):
            brute.setdefault((r.root, p), set()).add((r[p[0]], r[p[1]]))
    assert {(r.root, p): r[f"n_{p}"] for r in found.collect() for p in ("xy", "xz", "yz")} == {k: len(v) for k, v in brute.items()}


def test_projections_across_bricks(spark):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(int(x), int(y), int(z), int(r)) for x, y, z, r in {(*rng.integers(0, 20, 3).tolist(), k % 3) for k in range(900)}], "x int, y int, z int, root long").dropDuplicates(["x", "y", "z"])
    got = dealing.projections(cells, 8).groupBy("root", "plane").agg(F.sum(F.bitmap_count("bits")).alias("n"), F.count("*").alias("rows"))
    united = dealing.projections(cells, 8).groupBy("root", "plane", "bu", "bv").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy("root", "plane").agg(F.sum("n").alias("n"))
    want = {}
    for r in cells.collect():
        for p in ("xy", "xz", "yz"):
            want.setdefault((r.root, p), set()).add((r[p[0]], r[p[1]]))
    assert {(r.root, r.plane): r.n for r in united.collect()} == {k: len(v) for k, v in want.items()}
    assert got.count() == 9


def test_no_task_gathers_the_exterior(spark):
    """Of a volume that is all open but for a few closed boxes, no join reads more rows of the exterior than a brick has."""
    n = 40
    grid = V.with_index(spark.range(n**3).withColumnRenamed("id", "idx"), n, n)
    shell = "greatest(abs(x - 20), abs(y - 20), abs(z - 20))"
    v = grid.select("*", F.expr(f"cast(if({shell} = 4, 100, 0) as float)").alias("value"), F.lit(True).alias("valid"))
    got = V.interior(v, 50.0, (n, n, n))
    assert got.count() == 7**3 and got.select("root").distinct().count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_queries_of_places_agree_with_arrays(spark):
    v, dims = places.bar(spark, SF)
    assert dims[:2] == (10, 10) and v.count() == np.prod(dims)
    found = places.raw_turned(spark, SF)
    assert found.count() > v.count() and set(found.columns) == {"idx", "x", "y", "z", "value"}
