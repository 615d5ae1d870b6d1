"""Dense scalar volumes as voxel rows: idx, x, y, z, value, with an optional validity column."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.components import connected_components
from tessera.operators.dealing import SIDE, contacts, eroded_roots, parts, projections
from tessera.operators.gather import regridded
from tessera.operators.numbering import numbered
from tessera.storage import cut, small_side


def with_index(voxels: DataFrame, nx: int, ny: int) -> DataFrame:
    """Coordinates from the linear, x-fastest index."""
    return voxels.withColumns({"x": (F.col("idx") % nx).cast("int"), "y": (F.expr(f"idx div {nx}") % ny).cast("int"), "z": F.expr(f"cast(idx div {nx * ny} as int)")})


def voxelize(lineitem: DataFrame, n: int = 12) -> DataFrame:
    """A dense n^3 volume of summed quantities; voxels without rows are 0."""
    x, y = F.col("l_orderkey") % n, F.col("l_partkey") % n
    z = (F.expr(f"l_orderkey div {n}") + F.col("l_linenumber")) % n
    sums = lineitem.groupBy((x + n * y + n * n * z).alias("idx")).agg(F.sum(F.round("l_quantity").cast("long")).alias("total"))
    grid = with_index(lineitem.sparkSession.range(n**3).withColumnRenamed("id", "idx"), n, n)
    return grid.join(sums, "idx", "left").select("idx", "x", "y", "z", F.coalesce("total", F.lit(0)).cast("float").alias("value"))


def valid(column: str = "valid") -> Column:
    """A null mask is valid everywhere."""
    return F.coalesce(F.col(column), F.lit(True))


def valid_of(voxels: DataFrame) -> Column:
    """valid(), or true for a volume without a mask."""
    return valid() if "valid" in voxels.columns else F.lit(True)


def scalar_range(voxels: DataFrame) -> DataFrame:
    """Unmasked minimum and maximum of the voxels that are numbers."""
    number = F.when(~F.isnan("value"), F.col("value").cast("double"))
    return voxels.agg(F.min(number).alias("lo"), F.max(number).alias("hi"))


def masked_range(voxels: DataFrame) -> DataFrame:
    """Minimum and maximum of valid voxels that are numbers; 0 and 0 without any."""
    good = F.when(valid() & ~F.isnan("value"), F.col("value").cast("double"))
    return voxels.agg(F.coalesce(F.min(good), F.lit(0.0)).alias("lo"), F.coalesce(F.max(good), F.lit(0.0)).alias("hi"))


def histogram(voxels: DataFrame, bins: int = 2048) -> DataFrame:
    """(bin, intensity, frequency, log_frequency): bins from the least value on; the largest falls in the last one.

    Voxels that aren't numbers are in none.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    span = scalar_range(voxels)
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / max(1, bins - 1)).otherwise(1.0)
    rated = voxels.where(~F.isnan("value")).crossJoin(F.broadcast(span.withColumn("width", width)))  # one row
    at = F.least(F.floor((F.col("value").cast("double") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = rated.groupBy(at.alias("bin")).agg(F.count("*").alias("frequency"))
    grid = voxels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(span.withColumn("width", width)))
    out = grid.join(counts, "bin", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("intensity"), "frequency", F.log1p(F.col("frequency").cast("double")).alias("log_frequency"))


def histogram_percentile(voxels: DataFrame, quantiles: list[float], bins: int = 2048) -> DataFrame:
    """(q, value): nearest rank over the histogram, as the bin's lower edge; 0 and 1 give the range, others outside null."""
    hist = histogram(voxels, bins)
    running = hist.withColumn("cum", F.sum("frequency").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # as many rows as bins
    total, span = hist.agg(F.sum("frequency").alias("n")), scalar_range(voxels)
    asked = voxels.sparkSession.createDataFrame([(float(q),) for q in quantiles], "q double").crossJoin(total).crossJoin(span)
    hit = F.min(F.when(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))), F.col("intensity")))
    found = asked.crossJoin(F.broadcast(running)).groupBy("q", "lo", "hi").agg(hit.alias("edge"))
    q = F.col("q")
    value = F.when((q < 0) | (q > 1), F.lit(None)).when(q == 0, F.col("lo")).when(q == 1, F.col("hi")).otherwise(F.greatest("lo", F.least("hi", "edge")))
    return found.select("q", value.cast("double").alias("value"))


def percentile_preset(voxels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(position, level) nodes of a ramp between two percentiles, as shares of the range within 0 and 1.

    From 0 to 1 where the percentiles meet; one node of level 1 at 0 for a constant volume.
    """
    p = histogram_percentile(voxels, [low, high]).agg(F.min("value").alias("a"), F.max("value").alias("b")).crossJoin(scalar_range(voxels))  # one row each
    width = F.col("hi") - F.col("lo")
    share = lambda c: F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(c) - F.col("lo"), width)))).otherwise(0.0)
    at = p.select(share("a").alias("a"), share("b").alias("b"), (width == 0).alias("flat"))
    apart = F.col("b") > F.col("a")
    node = lambda x, y: F.struct(x.alias("position"), F.lit(y).alias("level"))
    ramp = F.array(node(F.when(apart, F.col("a")).otherwise(0.0), 0.0), node(F.when(apart, F.col("b")).otherwise(1.0), 1.0))
    return at.select(F.explode(F.when(F.col("flat"), F.array(node(F.lit(0.0), 1.0))).otherwise(ramp)).alias("n")).select("n.*")


def ras_origin(meta: DataFrame) -> DataFrame:
    """meta(ox, oy, oz, nx, ny, sx, sy, ...): the origin after lps_to_ras(); the flipped axes end where they began."""
    moved = {f"o{c}": -F.col(f"o{c}") - F.when(F.col(f"n{c}") > 0, (F.col(f"n{c}") - 1) * F.col(f"s{c}")).otherwise(0.0) for c in "xy"}
    return meta.withColumns(moved)


def respaced(meta: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """meta(version, sx, sy, sz, ...) with another spacing under the next version; as it is where the spacing is the same."""
    if not all(0 < s < float("inf") for s in spacing):
        raise ValueError("spacings are positive numbers")
    other = ~(F.lit(True) & (F.col("sx") == spacing[0]) & (F.col("sy") == spacing[1]) & (F.col("sz") == spacing[2]))
    return meta.withColumns({"version": F.col("version") + other.cast("long"), **{f"s{c}": F.lit(float(s)) for c, s in zip("xyz", spacing, strict=True)}})


def with_background(voxels: DataFrame) -> DataFrame:
    """voxels whose masked ones have the volume's least value."""
    least = F.broadcast(scalar_range(voxels).select(F.col("lo").cast("float").alias("least")))  # one row
    return voxels.crossJoin(least).withColumn("value", F.when(valid_of(voxels), F.col("value")).otherwise(F.col("least"))).drop("least")


def histogram_picture(hist: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """(x, y, gray) of a bar chart of histogram()'s log frequencies, y up from the bottom: bars of 128 before a ramp along x."""
    top = F.broadcast(hist.agg(F.count("*").alias("bins"), F.max("log_frequency").alias("most")))  # one row
    columns = hist.sparkSession.range(width).select(F.col("id").cast("int").alias("x")).crossJoin(top).withColumn("bin", F.expr(f"cast(x * bins div {width} as int)"))
    share = F.when(F.col("most") > 0, F.try_divide("log_frequency", "most")).otherwise(F.col("log_frequency"))
    bars = columns.join(hist.select("bin", "log_frequency"), "bin").select("x", F.floor(share * height * 0.9).alias("bar"))
    pixels = bars.select("x", "bar", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return pixels.select("x", "y", F.when(F.col("y") < F.col("bar"), F.lit(128)).otherwise(F.expr(f"cast(x * 255 div {width} as int)")).alias("gray"))


def lps_to_ras(voxels: DataFrame, nx: int, ny: int) -> DataFrame:
    """Flip x and y."""
    flipped = voxels.withColumns({"x": F.lit(nx - 1) - F.col("x"), "y": F.lit(ny - 1) - F.col("y")})
    return flipped.withColumn("idx", (F.col("x") + nx * F.col("y") + nx * ny * F.col("z")).cast("long"))


def window_gray(value: Column, window: float, center: float) -> Column:
    w = max(window, 1e-6)
    scaled = (value.cast("double") - (center - w / 2)) / w
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) * 255 + 0.5).cast("int")


def piecewise(value: Column, nodes: list[tuple[float, float]]) -> Column:
    """Linear between nodes (position, level), constant outside; of equal positions the last one holds."""
    kept = sorted(dict(nodes).items())
    out = F.lit(kept[-1][1])
    for (a, left), (b, right) in reversed(list(zip(kept, kept[1:], strict=False))):
        out = F.when(value < b, F.lit(left) + (value - a) / (b - a) * (right - left)).otherwise(out)
    return F.when(value <= kept[0][0], F.lit(kept[0][1])).otherwise(out)


def single(x: float) -> Column:
    return F.lit(x).cast("float")


def in_box(p: tuple[Column, Column, Column], inverse: list[list[float]]) -> Column:
    """Single precision: each row of the inverse affine gives at most 1 + 1e-6."""
    rows = [single(r[0]) * p[0] + single(r[1]) * p[1] + single(r[2]) * p[2] + single(r[3]) for r in inverse[:3]]
    return reduce(lambda a, b: a & b, [F.abs(r) <= single(1 + 1e-6) for r in rows])


def above_plane(p: tuple[Column, Column, Column], center: list[float], normal: list[float]) -> Column:
    parts = [(q - single(c)) * single(n) for q, c, n in zip(p, center, normal, strict=True)]
    return parts[0] + parts[1] + parts[2] > single(0)


#: Operations that are compiled into one expression.
COMPILED = 32


def all_of(conditions: list[Column]) -> Column:
    """All hold; as a balanced tree, so that long lists don't nest deeply."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a & b, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def kept(p: tuple[Column, Column, Column], ops: list[dict], count: int) -> Column:
    """All of the first `count` operations hold; points that aren't finite never do.

    An operation has shape (box or plane), mode (keep or remove) and inverse, or center and normal. Up to COMPILED
    of them are compiled into the expression; longer histories are one constant list that each point runs through.
    """
    held = [~F.isnan(q) & (F.abs(q) < float("inf")) for q in p]
    for op in ops[: count if count <= COMPILED else 0]:
        inside = in_box(p, op["inverse"]) if op["shape"] == "box" else above_plane(p, op["center"], op["normal"])
        held.append(inside if op["mode"] == "keep" else ~inside)
    if count > COMPILED:
        held.append(_kept_by_list(p, ops[:count]))
    return all_of(held)


def _kept_by_list(p: tuple[Column, Column, Column], ops: list[dict]) -> Column:
    numbers = [[v for r in op["inverse"][:3] for v in r] if op["shape"] == "box" else [*op["center"], *op["normal"], *[0] * 6] for op in ops]
    rows = [{"box": op["shape"] == "box", "keep": op["mode"] == "keep", "m": [float(np.float32(v)) for v in m]} for op, m in zip(ops, numbers, strict=True)]
    held = F.from_json(F.lit(json.dumps(rows)), "array<struct<box:boolean,keep:boolean,m:array<float>>>")

    def holds(op: Column) -> Column:
        m = [op["m"][i] for i in range(12)]
        box = all_of([F.abs(m[r] * p[0] + m[r + 1] * p[1] + m[r + 2] * p[2] + m[r + 3]) <= single(1 + 1e-6) for r in (0, 4, 8)])
        plane = (p[0] - m[0]) * m[3] + (p[1] - m[1]) * m[4] + (p[2] - m[2]) * m[5] > single(0)
        return F.when(op["box"], box).otherwise(plane) == op["keep"]

    return F.forall(held, holds)


def point(spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> tuple[Column, Column, Column]:
    return tuple((F.col(c).cast("double") * s + o).cast("float") for c, s, o in zip("xyz", spacing, origin, strict=True))


def labelled(cells: DataFrame, side: int = SIDE, apart_from: Column | None = None) -> DataFrame:
    """cells with root, the smallest idx of their 6-connected component; without components that hold a cell of apart_from.

    Bricks are labelled by themselves; only their parts that meet in a rim are edges of a graph, whose components
    name the whole. A voxel moves once, to its brick, and then meets its part, which has at most a brick's voxels: what holds
    for a component is worked out from its parts, so that no join gathers the voxels of a large component.
    """
    found = cut(parts(cells, side), "parts")
    own = found.where("own").drop("own")
    met = found.where("not own").select("idx", F.col("part").alias("src")).join(own.select("idx", F.col("part").alias("dst")), "idx")
    joined = cut(connected_components(met.select("src", "dst")), "components")
    named = joined.withColumnRenamed("node", "part")
    if apart_from is None:
        return own.join(small_side(named, 64), "part", "left").select(*cells.columns, F.coalesce("component", "part").alias("root"))
    touched = own.groupBy("part").agg(F.max(apart_from).alias("touched")).join(small_side(named, 64), "part", "left").withColumn("root", F.coalesce("component", "part"))
    touched = cut(touched.select("part", "root", "touched"), "part-roots")
    gone = cut(touched.where("touched").select("root").distinct(), "touched-roots")
    free = cut(touched.join(small_side(gone, 16), "root", "left_anti").select("part", "root"), "free-parts")
    return own.join(small_side(free, 24), "part").select(*cells.columns, "root")


def interior(voxels: DataFrame, iso: float, dims: tuple[int, int, int]) -> DataFrame:
    """Valid voxels below iso that no open way joins with a face or an invalid voxel; with root, their component."""
    is_open = voxels.where(~valid() | (F.col("value") < single(iso)) & ~F.isnan("value"))
    face = reduce(lambda a, b: a | b, [(F.col(c) == 0) | (F.col(c) == d - 1) for c, d in zip("xyz", dims, strict=True)])
    return labelled(is_open, apart_from=face | ~valid())


def opened(cells: DataFrame, erosions: int) -> DataFrame:
    """Erode by 6-neighbours, then regrow what is left within its component."""
    return cells.join(small_side(cut(eroded_roots(cells, erosions), "eroded"), 16), "root", "left_semi") if erosions else cells


def regions(cells: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), min_volume: float = 0) -> DataFrame:
    """A row for each component: number, size, centroid, closed bounds, gray values, moments and projected areas.

    Areas (n_xy, n_xz, n_yz, in voxels) are counted in bitmaps of the planes, which bricks make and regions unite.
    """
    sx, sy, sz = spacing
    mm = [(F.col(c) * s) for c, s in zip("xyz", spacing, strict=True)]
    v = F.col("value").cast("double")
    sums = [F.sum(m).alias(f"s{c}") for c, m in zip("xyz", mm, strict=True)]
    pairs = [F.sum(mm[a] * mm[b]).alias(f"s{'xyz'[a]}{'xyz'[b]}") for a in range(3) for b in range(a, 3)]
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]
    out = cells.groupBy("root").agg(F.count("*").alias("voxels"), *sums, *pairs, *bounds, F.min(v).alias("min_gray"), F.max(v).alias("max_gray"), F.sum(v).alias("sum_gray"), F.sum(v * v).alias("sum_gray2"))
    out = out.withColumn("volume", F.col("voxels") * (sx * sy * sz)).where(F.col("volume") >= min_volume)
    found = numbered(out, ["root"], "regions").withColumn("id", (F.col("number") + 1).cast("int")).drop("number")
    shadows = projections(cells).groupBy("root", "plane", "bu", "bv").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    areas = shadows.groupBy("root").agg(*[F.coalesce(F.sum(F.when(F.col("plane") == p, F.col("n"))), F.lit(0)).alias(f"n_{p}") for p in ("xy", "xz", "yz")])
    n = F.col("voxels")
    out = found.join(areas, "root").withColumns({f"c{c}": F.col(f"s{c}") / n + o for c, o in zip("xyz", origin, strict=True)})
    mean = F.col("sum_gray") / n
    return out.withColumns({"mean_gray": mean, "std_gray": F.sqrt(F.greatest(F.lit(0.0), F.col("sum_gray2") / n - mean * mean)), "diameter": F.pow(6 * F.col("volume") / F.pi(), F.lit(1 / 3))})


def surfaces(cells: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(root, crossings, surface, gap, compactness, sphericity) of each component, from its 26-neighbourhood."""
    sx, sy, sz = spacing
    out = contacts(cells).withColumn("crossings", 26 * F.col("voxels") - F.col("inside"))
    s, v = F.col("surface"), F.col("voxels") * (sx * sy * sz)
    out = out.withColumn("surface", F.col("crossings") * ((sx * sy + sx * sz + sy * sz) / 3) / 13)
    some = lambda c: F.when(s > 1e-9, c).otherwise(0.0)
    compact = 36 * F.pi() * v * v / (s * s * s)
    return out.select("root", "voxels", "crossings", "surface", some(2 * v / s).alias("gap"), some(compact).alias("compactness"), some(F.pow(compact, F.lit(1 / 3))).alias("sphericity"))


def porosity(voxels: DataFrame, cells: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    size = spacing[0] * spacing[1] * spacing[2]
    joined = voxels.join(cells.select("idx", F.lit(True).alias("void")), "idx", "left")
    counts = joined.agg(F.count_if(valid()).alias("whole"), F.count_if(F.coalesce("void", F.lit(False))).alias("void"))
    return counts.select((F.col("whole") - F.col("void")).alias("object_voxels"), F.col("void").alias("void_voxels"), (F.col("void") * size).alias("void_volume"), F.when(F.col("whole") > 0, F.col("void") / F.col("whole")).otherwise(0.0).alias("porosity"))


def resampled(voxels: DataFrame, dims: tuple[int, int, int], to: tuple[int, int, int]) -> DataFrame:
    """Linear resampling to another grid over the same extent; places beyond the last voxel take its value."""
    step = [d / t for d, t in zip(dims, to, strict=True)]
    return regridded(voxels, dims, to, [[step[0], 0, 0, 0], [0, step[1], 0, 0], [0, 0, step[2], 0]], None)


def resliced(voxels: DataFrame, dims: tuple[int, int, int], to: tuple[int, int, int], back: list[list[float]], background: float = 0.0) -> DataFrame:
    """(idx, x, y, z, value) of another grid: `back` (three rows of four) takes its indices to those of the volume.

    Linear between voxels; the background where the place is outside the volume.
    """
    return regridded(voxels, dims, to, back, background)


def resliced_mask(voxels: DataFrame, to: tuple[int, int, int], back: list[list[float]]) -> DataFrame:
    """(idx, x, y, z, valid) of another grid, by the nearest voxel; false outside the volume."""
    mask = voxels.select("x", "y", "z", valid_of(voxels).cast("int").alias("value"))
    found = regridded(mask, (1 << 31,) * 3, to, back, 0.0, nearest=True)  # beyond its voxels the mask is false anyway
    return found.select("idx", "x", "y", "z", (F.col("value") > 0).alias("valid"))


def isotropic(dims: tuple[int, int, int], spacing: tuple[float, float, float], target: int) -> tuple[tuple[int, int, int], tuple[float, float, float]]:
    """Dims and spacing after shrinking the longest axis to `target` voxels, if it is longer; the origin stays."""
    factor = min(1.0, target / max(dims))
    return tuple(max(1, int(d * factor)) for d in dims), tuple(s / factor for s in spacing)


def downsampled(voxels: DataFrame, dims: tuple[int, int, int], target: int, mask: bool = False) -> DataFrame:
    """The volume (linear) or its mask (nearest) on the grid of isotropic(); a grid that isn't larger stays."""
    to, _ = isotropic(dims, (1, 1, 1), target)
    step = 1 / min(1.0, target / max(dims))
    back = [[step, 0, 0, 0], [0, step, 0, 0], [0, 0, step, 0]]
    return resliced_mask(voxels, to, back) if mask else resliced(voxels, dims, to, back)


def _eigenvalues(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Of symmetric matrices, largest first, none below zero; a batch at a time."""
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).astype(float).reshape(-1, 3, 3)
    found = np.maximum(np.linalg.eigvalsh(m)[:, ::-1], 0.0)
    return pd.DataFrame(found, columns=["l1", "l2", "l3"])


def principal(found: DataFrame) -> DataFrame:
    """regions() with l1 >= l2 >= l3, the eigenvalues of a region's covariance, and elongation, flatness, share and ratio."""
    n = F.col("voxels")
    cov = [F.col(f"s{a}{b}") / n - F.col(f"s{a}") / n * (F.col(f"s{b}") / n) for a in "xyz" for b in "xyz" if a <= b]
    eigenvalues = F.pandas_udf(_eigenvalues, "l1 double, l2 double, l3 double")
    out = found.withColumn("own", eigenvalues(*cov)).select("*", "own.*").drop("own")
    some = lambda a, b: F.when(F.col(b) > 1e-9, F.col(a) / F.col(b)).otherwise(0.0)
    share = F.when(F.col("l1") > 1e-9, F.col("l1") / (F.col("l1") + F.col("l2") + F.col("l3"))).otherwise(0.0)
    return out.withColumns({"elongation": F.sqrt(some("l2", "l1")), "flatness": F.sqrt(some("l3", "l2")), "share": share, "ratio": some("l1", "l3")})
