"""Queries of the whole void analysis and of crop results, over a volume with caverns that grows with the part table, its gray values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import bricks, crop, voids, volume as V
from tessera.plans import catalog
from tessera.plans.catalog import BOX, HIST, NEAR, PLANE, VOXEL, query, table

#: A block of 16 x 16 x 16 voxels for every 200 parts, stacked along z.
N, PARTS = 16, 200
RATIO, GRAY_MAX, MIN_VOLUME = 0.2, 8.0, 20.0
#: Squared distances from the middles of two enclosed caverns of a block and one that is open at x = 0.
_BALLS = tuple(f"{xy} + (z % {N} - {c}) * (z % {N} - {c}) <= {r}" for xy, c, r in (("(x - 5) * (x - 5) + (y - 5) * (y - 5)", 5, 11), ("(x - 11) * (x - 11) + (y - 10) * (y - 10)", 9, 5), ("x * x + (y - 11) * (y - 11)", 4, 9)))
_SHADE = "CASE WHEN " + " OR ".join(_BALLS) + " THEN p_size % 10 ELSE 50 + p_size END"
CAVERN = f"""top AS (SELECT greatest(1, (max(p_partkey) + 1) // {PARTS}) * {N} - 1 AS last FROM part),
g AS (SELECT i AS idx, CAST(i % {N} AS INT) AS x, CAST(i // {N} % {N} AS INT) AS y, CAST(i // {N * N} AS INT) AS z, {PARTS} * (i // {N**3}) + i % {PARTS} AS p_partkey FROM (SELECT unnest(range({N * N} * (last + 1))) AS i FROM top)),
voxel AS (SELECT idx, x, y, z, CAST({_SHADE} AS FLOAT) AS value, idx % 112 <> 0 AS valid FROM g JOIN part USING (p_partkey)),
iso AS (SELECT CAST(min(value) + (max(value) - min(value)) * {RATIO}::DOUBLE AS FLOAT) AS v FROM voxel WHERE valid)"""
_STEP = "o.x = {a}.x + s.i AND o.y = {a}.y + s.j AND o.z = {a}.z + s.k"
DARK = f"""{CAVERN}, op AS (SELECT voxel.* FROM voxel, iso WHERE NOT valid OR value < iso.v),
reach AS (SELECT idx, x, y, z FROM op, top WHERE NOT valid OR 0 IN (x, y, z) OR {N - 1} IN (x, y) OR z = last UNION SELECT o.idx, o.x, o.y, o.z FROM reach r, {NEAR}, op o WHERE {_STEP.format(a="r")}),
dark AS (SELECT * FROM op WHERE idx NOT IN (SELECT idx FROM reach) AND value <= {GRAY_MAX}),
walk AS (SELECT idx AS start, idx, x, y, z FROM dark UNION SELECT w.start, o.idx, o.x, o.y, o.z FROM walk w, {NEAR}, dark o WHERE {_STEP.format(a="w")}),
part_of AS (SELECT d.*, r.root FROM dark d JOIN (SELECT idx, min(start) AS root FROM walk GROUP BY idx) r USING (idx)),
left1 AS (SELECT c.idx, c.x, c.y, c.z, c.root FROM part_of c, {NEAR}, part_of o WHERE {_STEP.format(a="c")} GROUP BY ALL HAVING count(*) = 6),
left2 AS (SELECT c.idx, c.root FROM left1 c, {NEAR}, left1 o WHERE {_STEP.format(a="c")} GROUP BY ALL HAVING count(*) = 6),
cell AS (SELECT * FROM part_of WHERE root IN (SELECT root FROM left2)),
region AS (SELECT root, CAST(row_number() OVER (ORDER BY root) AS INT) AS id, count(*) AS voxels FROM cell GROUP BY root HAVING count(*) * 0.5 >= {MIN_VOLUME / 4}),
label AS (SELECT v.*, coalesce(r.id, 0) AS label FROM voxel v LEFT JOIN cell c ON c.idx = v.idx LEFT JOIN region r ON r.root = c.root)"""
SPACING = (1.0, 1.0, 0.5)


def cavern(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    parts = table(spark, sf_dir, "part")
    depth = N * max(1, (parts.agg(F.max("p_partkey")).first()[0] + 1) // PARTS)
    grid = V.with_index(spark.range(N * N * depth).withColumnRenamed("id", "idx"), N, N)
    grid = grid.withColumn("p_partkey", PARTS * F.expr(f"idx div {N**3}") + F.col("idx") % PARTS)
    voxels = grid.join(parts.select("p_partkey", "p_size"), "p_partkey")
    return voxels.select("idx", "x", "y", "z", F.expr(_SHADE).cast("float").alias("value"), (F.col("idx") % 112 != 0).alias("valid")), (N, N, depth)


def chain(spark: SparkSession, sf_dir: str, erosions: int) -> DataFrame:
    v, dims = cavern(spark, sf_dir)
    return voids.candidates(v, voids.iso_by_ratio(v, RATIO), GRAY_MAX, dims, erosions)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = chain(spark, sf_dir, 2)
    return voids.labels(cavern(spark, sf_dir)[0], cells, voids.region_table(cells, SPACING, min_volume=MIN_VOLUME / 4))


@query(f"WITH {CAVERN} SELECT v::DOUBLE AS iso FROM iso")
def iso_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(voids.iso_by_ratio(cavern(spark, sf_dir)[0], RATIO),)], "iso double")


@query(f"WITH RECURSIVE {DARK} SELECT idx, root FROM part_of")
def void_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir, 0).select("idx", "root")


@query(f"WITH RECURSIVE {DARK} SELECT idx, root FROM cell")
def void_candidates_eroded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir, 2).select("idx", "root")


@query(f"""WITH RECURSIVE {DARK} SELECT r.id, r.root, r.voxels, round(r.voxels * 0.5::DOUBLE, 6) AS volume, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z) * 0.5::DOUBLE, 6) AS cz,
round(avg(value::DOUBLE), 6) AS mean_gray, (max(x) - min(x) + 1)::DOUBLE AS extent_x, (max(y) - min(y) + 1)::DOUBLE AS extent_y, (max(z) - min(z) + 1) * 0.5::DOUBLE AS extent_z
FROM region r JOIN cell USING (root) GROUP BY r.id, r.root, r.voxels""")
def void_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voids.region_table(chain(spark, sf_dir, 2), SPACING, min_volume=MIN_VOLUME / 4)
    return found.select("id", "root", "voxels", *[F.round(c, 6).alias(c) for c in ("volume", "cx", "cy", "cz", "mean_gray")], "extent_x", "extent_y", "extent_z")


@query(f"WITH RECURSIVE {DARK} SELECT idx, label FROM label")
def void_label_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("idx", "label")


@query(f"""WITH RECURSIVE {DARK}, n AS (SELECT count(*) FILTER (WHERE valid) AS whole, count(*) FILTER (WHERE label > 0) AS void FROM label)
SELECT whole - void AS object_voxels, void AS void_voxels, (whole - void) * 0.5::DOUBLE AS object_volume, void * 0.5::DOUBLE AS void_volume, round(void / whole::DOUBLE, 9) AS porosity FROM n""")
def void_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voids.statistics(labelled(spark, sf_dir), SPACING).withColumn("porosity", F.round("porosity", 9))


#: A grid edge or diagonal of the six tetrahedra of a cell; the surface crosses those with one labelled end, half way.
_LINES = "(values (1,0,0),(0,1,0),(0,0,1),(1,1,0),(1,0,1),(0,1,1),(1,1,1)) s(i,j,k)"


@query(f"""WITH RECURSIVE {DARK} SELECT DISTINCT l.x + s.i * 0.5::DOUBLE AS x, l.y + s.j * 0.5::DOUBLE AS y, l.z + s.k * 0.5::DOUBLE AS z
FROM label l, {_LINES}, label o WHERE {_STEP.format(a="l")} AND (l.label > 0) <> (o.label > 0)""")
def void_mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = voids.void_mesh(labelled(spark, sf_dir))
    ends = F.explode(F.array(*[F.struct(*[F.col(f"{c}{i}").alias(c) for c in "xyz"]) for i in range(3)])).alias("p")
    return mesh.select(ends).select("p.x", "p.y", "p.z").distinct()


_OPS = [BOX | {"mode": "keep"}, PLANE | {"mode": "remove"}]
_KEPT = f"valid AND {catalog._BOX} AND NOT {catalog._PLANE}"


@query(f"WITH {VOXEL} SELECT idx, value, {_KEPT} AS valid FROM voxel")
def crop_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.cropped(catalog.voxels(spark, sf_dir), _OPS, 2).select("idx", "value", "valid")


@query(f"WITH {VOXEL} SELECT z, count(*) FILTER (WHERE {_KEPT}) AS kept FROM voxel GROUP BY z")
def crop_kept_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.kept_counts(crop.cropped(catalog.voxels(spark, sf_dir), _OPS, 2))


@query(f"WITH {VOXEL} SELECT idx, CASE WHEN valid THEN value ELSE (SELECT min(value) FROM voxel) END AS value FROM voxel")
def masked_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_background(catalog.voxels(spark, sf_dir)).select("idx", "value")


def _side(axis: str, step: int) -> str:
    return f"LEFT JOIN u {axis}{'p' if step > 0 else 'm'} ON " + " AND ".join(f"{axis}{'p' if step > 0 else 'm'}.{c} = u.{c}" + (f" + {step}" if c == axis else "") for c in "xyz")


@query(f"""WITH {VOXEL}, u AS (SELECT x, y, z, value::DOUBLE AS v FROM voxel WHERE valid), d AS (SELECT u.x, u.y, u.z,
(coalesce(xp.v, u.v) - coalesce(xm.v, u.v)) / 2 AS dx, (coalesce(yp.v, u.v) - coalesce(ym.v, u.v)) / 4 AS dy, (coalesce(zp.v, u.v) - coalesce(zm.v, u.v)) / 1 AS dz
FROM u {" ".join(_side(c, s) for c in "xyz" for s in (1, -1))}), m AS (SELECT x, y, z, sqrt(dx * dx + dy * dy + dz * dz) AS g FROM d)
SELECT x, y, z, round(CASE WHEN g <= 10 THEN 0.0 WHEN g < 200 THEN (g - 10) / 190.0::DOUBLE ELSE 1.0 END, 6) AS opacity FROM m""")
def gradient_opacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bricks.gradients(catalog.voxels(spark, sf_dir), (1.0, 2.0, 0.5))
    return found.select("x", "y", "z", F.round(V.piecewise(F.col("gradient"), [(10.0, 0.0), (200.0, 1.0)]), 6).alias("opacity"))


@query(f"""WITH {VOXEL}, g AS (SELECT i AS idx, CAST(i % 7 AS INT) AS x, CAST(i // 7 % 7 AS INT) AS y, CAST(i // 49 AS INT) AS z FROM range(343) t(i))
SELECT g.idx, g.x, g.y, g.z, coalesce(v.valid, false) AS valid FROM g LEFT JOIN voxel v ON v.x = floor(g.x * (12 / 7.0::DOUBLE) + 0.5) AND v.y = floor(g.y * (12 / 7.0::DOUBLE) + 0.5) AND v.z = floor(g.z * (12 / 7.0::DOUBLE) + 0.5)""")
def downsample_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.downsampled(catalog.voxels(spark, sf_dir), catalog.DIMS, 7, mask=True)


@query(f"""WITH {HIST}, t AS (SELECT max(ln(frequency + 1)) AS most FROM h), b AS (SELECT CAST(x AS INT) AS x, floor(ln(frequency + 1) / most * 600 * 0.9::DOUBLE) AS bar FROM range(800) c(x) JOIN h ON h.bin = x * 2048 // 800, t)
SELECT x, CAST(y AS INT) AS y, CASE WHEN y < bar THEN 128 ELSE CAST(x * 255 // 800 AS INT) END AS gray FROM b, range(600) r(y)""")
def histogram_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram_picture(V.histogram(catalog.voxels(spark, sf_dir)))


_META = ("p_partkey AS volume_id", "p_size % 7 AS version", "p_size * 0.5 AS ox", "p_size * -1.5 AS oy", "p_size * 2.0 AS oz", "p_size % 9 AS nx", "p_size % 4 AS ny", "0.25 AS sx", "p_size % 3 + 0.5 AS sy", "1.0 AS sz")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").selectExpr(*_META)
    return m.select("volume_id", F.col("version").cast("long").alias("version"), *[F.col(c).cast("double").alias(c) for c in ("ox", "oy", "oz", "nx", "ny", "sx", "sy", "sz")])


@query(f"""WITH m AS (SELECT {", ".join(_META)} FROM part) SELECT volume_id, CAST(-ox - CASE WHEN nx > 0 THEN (nx - 1) * sx ELSE 0 END AS DOUBLE) AS ox, CAST(-oy - CASE WHEN ny > 0 THEN (ny - 1) * sy ELSE 0 END AS DOUBLE) AS oy, CAST(oz AS DOUBLE) AS oz FROM m""")
def ras_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ras_origin(_meta(spark, sf_dir)).select("volume_id", "ox", "oy", "oz")


@query(f"""WITH m AS (SELECT {", ".join(_META)} FROM part) SELECT volume_id, CAST(version + CASE WHEN sy = 1.5 THEN 0 ELSE 1 END AS BIGINT) AS version, 0.25::DOUBLE AS sx, 1.5::DOUBLE AS sy, 1.0::DOUBLE AS sz FROM m""")
def replaced_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.respaced(_meta(spark, sf_dir), (0.25, 1.5, 1.0)).select("volume_id", "version", "sx", "sy", "sz")
