"""Triangle meshes as rows of nine coordinates; points that triangles share are equal to the last bit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geometry import export_name, is_affine, transformed
from tessera.operators.gather import sampled
from tessera.operators.numbering import numbered
from tessera.operators.volume import piecewise, valid_of
from tessera.sources.files import write_pieces
from tessera.storage import cut

Point = tuple[Column, Column, Column]
CORNERS = [[f"{c}{i}" for c in "xyz"] for i in range(3)]
#: Numbers of a triangle's points, where it has them: equal for the same point, as bricks.numbered_surface() gives them.
KEYS = ["k0", "k1", "k2"]


def corner(i: int) -> Point:
    return tuple(F.col(c) for c in CORNERS[i])


def moved(triangles: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Corners after an affine matrix; one that mirrors also turns triangles round, so that normals keep their side."""
    if not is_affine(matrix):
        raise ValueError("not an invertible affine matrix")
    order = (0, 1, 2) if np.linalg.det(np.asarray(matrix)[:3, :3]) > 0 else (0, 2, 1)
    keys = [F.col(KEYS[at]).alias(k) for k, at in zip(KEYS, order, strict=True)] if KEYS[0] in triangles.columns else []
    return triangles.select(*[c.alias(n) for i, at in enumerate(order) for c, n in zip(transformed(corner(at), matrix), CORNERS[i], strict=True)], *keys)


def clipped(triangles: DataFrame, keep: Callable[[Point], Column], level: float = 0.5) -> DataFrame:
    """What is left of triangles where a point predicate holds: corners count 1 or 0, and edges are cut at `level` between."""
    return clipped_at(triangles.withColumns({f"_s{i}": F.when(keep(corner(i)), 1.0).otherwise(0.0) for i in range(3)}), ["_s0", "_s1", "_s2"], level)


def clipped_at(triangles: DataFrame, values: list[str], level: float) -> DataFrame:
    """What is left of triangles where a field is over `level`; values names the columns of its values at the corners.

    The field is linear along an edge, which is cut where it equals the level. Cut points are worked out from the
    smaller end of an edge, so that neighbours agree.
    """
    p = F.array(*[F.struct(*[F.col(c).alias(a) for c, a in zip(CORNERS[i], "xyz", strict=True)], F.col(values[i]).alias("s")) for i in range(3)])
    kept = [F.coalesce(F.col(v) > level, F.lit(False)) for v in values]
    rows = triangles.select(p.alias("p"), F.array(*kept).alias("k"), sum((k.cast("int") for k in kept), F.lit(0)).alias("n")).where("n > 0")
    # The corner that differs from the two others comes first; the order round the triangle stays.
    first = F.when(F.col("n") == 3, 0).otherwise(F.array_position("k", F.col("n") == 1) - 1).cast("int")
    turned = rows.select("n", *[F.col("p")[(first + i) % 3].alias(f"q{i}") for i in range(3)])

    def on(a: Column, b: Column) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        t = (F.lit(float(level)) - low["s"]) / (high["s"] - low["s"])
        return F.struct(*[(low[c] + t * (high[c] - low[c])).alias(c) for c in "xyz"], F.lit(float(level)).alias("s"))

    cross_ = F.col("n") < 3
    q0, q1, q2, c1, c2 = (F.col(c) for c in ("q0", "q1", "q2", "c1", "c2"))
    points_ = turned.withColumns({"c1": F.when(cross_, on(q0, q1)), "c2": F.when(cross_, on(q0, q2))})
    pieces = F.when(F.col("n") == 3, F.array(F.array(q0, q1, q2))).when(F.col("n") == 1, F.array(F.array(q0, c1, c2))).otherwise(F.array(F.array(q1, q2, c2), F.array(q1, c2, c1)))
    left = points_.select(F.explode(pieces).alias("t"))
    return left.select(*[F.col("t")[i][c].alias(f"{c}{i}") for i in range(3) for c in "xyz"])


def clipped_by_mask(triangles: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """What is left of triangles within the mask of a volume: 255 at valid voxels and 0 at others, linear between, cut at 127.5.

    Outside the volume the mask is -1. A volume without a mask leaves what lies within it.
    """
    mask = voxels.select("x", "y", "z", F.when(valid_of(voxels), 255.0).otherwise(0.0).alias("value"))
    names = [f"_s{i}" for i in range(3)]
    flat = triangles.select(*[c for cs in CORNERS for c in cs])
    return clipped_at(sampled(flat, [tuple(cs) for cs in CORNERS], names, mask, dims, spacing, origin, -1.0), names, 127.5)


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def triangle_normal() -> Point:
    """Twice the area long."""
    side = [tuple(u - v for u, v in zip(corner(i), corner(0), strict=True)) for i in (1, 2)]
    return cross(*side)


def points(triangles: DataFrame) -> DataFrame:
    """(x, y, z, nx, ny, nz): distinct points with unit normals, those of their triangles weighted by area; zero where they cancel out.

    With key where triangles have the numbers of their points, which then tell points apart; else the coordinates do.
    """
    keyed = KEYS[0] in triangles.columns
    normal = [c.alias(f"n{a}") for c, a in zip(triangle_normal(), "xyz", strict=True)]
    at = [F.struct(*[F.col(c).alias(a) for c, a in zip(CORNERS[i], "xyz", strict=True)]).alias("p") for i in range(3)]
    ends = F.explode(F.array(*[F.struct(*[F.col(KEYS[i]).alias("key")] * keyed, at[i]) for i in range(3)])).alias("end")
    rows = triangles.select(ends, *normal).select("end.*", *[f"n{a}" for a in "xyz"])
    sums = rows.groupBy("key" if keyed else "p").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"], *[F.min(f"p.{a}").alias(a) for a in "xyz"])
    size = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in "xyz"), F.lit(0.0)))
    unit = [F.when(F.col("size") > 0, F.col(f"n{a}") / F.col("size")).otherwise(0.0).alias(f"n{a}") for a in "xyz"]
    return sums.withColumn("size", size).select(*["key"] * keyed, "x", "y", "z", *unit)


def indexed(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered points, and triangles (number, p0, p1, p2) of those numbers. Points meet by key where triangles have keys."""
    keyed = KEYS[0] in triangles.columns
    found = numbered(points(triangles), ["key"] if keyed else ["x", "y", "z"], "mesh-points")
    flat = [c for cs in CORNERS for c in cs]
    out = numbered(triangles.select(*KEYS), KEYS, "mesh-triangles") if keyed else numbered(triangles, flat, "mesh-triangles")
    for i in range(3):
        own = [F.col("key").alias(KEYS[i])] if keyed else [F.col(c).alias(f"{c}{i}") for c in "xyz"]
        out = out.join(found.select(*own, F.col("number").alias(f"p{i}")), [KEYS[i]] if keyed else CORNERS[i])
    return found, out.select("number", "p0", "p1", "p2")


def counts(triangles: DataFrame) -> DataFrame:
    """(points, edges, triangles, euler) of triangles with the numbers of their points; euler is 2 for a closed surface without holes."""
    held = cut(triangles.select(*KEYS), "mesh-keys")
    ends = held.select(F.explode(F.array(*KEYS)).alias("k")).distinct().agg(F.count("*").alias("points"))
    sides = F.array(*[F.struct(F.least(KEYS[i], KEYS[i - 1]).alias("a"), F.greatest(KEYS[i], KEYS[i - 1]).alias("b")) for i in range(3)])
    edges = held.select(F.explode(sides).alias("e")).distinct().agg(F.count("*").alias("edges"))
    found = ends.crossJoin(edges).crossJoin(held.agg(F.count("*").alias("triangles")))  # one row each
    return found.withColumn("euler", F.col("points") - F.col("edges") + F.col("triangles"))


def color(scalar: Column, nodes: list[tuple[float, float, float, float]], lo: float, hi: float) -> list[Column]:
    """Red, green and blue bytes of a transfer function (position, r, g, b) over a range; a gray ramp without one, or white where the range is empty."""
    if hi < lo:
        raise ValueError("the range is upside down")
    nodes = nodes or ([(0, 0, 0, 0), (1, 1, 1, 1)] if hi > lo else [(0, 1, 1, 1)])
    return [F.round(255 * piecewise(scalar.cast("double"), [(lo + n[0] * (hi - lo), float(n[k])) for n in nodes])).cast("int").alias(c) for k, c in ((1, "red"), (2, "green"), (3, "blue"))]


def colored(points: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], nodes: list[tuple[float, float, float, float]], span: tuple[float, float], spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """points(x, y, z, ...) with red, green and blue: color() of a volume's linear value at each, the range's low end outside it."""
    found = sampled(points, [("x", "y", "z")], ["_at"], voxels, dims, spacing, origin, span[0])
    return found.select(*points.columns, *color(F.col("_at"), nodes, *span))


def _pieces(rows: DataFrame, columns: list[str], kind: np.dtype, start: int, name: str) -> DataFrame:
    """(name, at, data) of records of fixed size, each at its number's place after `start`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, dtype=kind)
            for c, f in zip(columns, [f for f in kind.names if not f.startswith("fixed")], strict=True):
                out[f] = b.column(c).to_numpy()
            for f in kind.names:
                if f.startswith("fixed"):
                    out[f] = int(f.removeprefix("fixed"))
            at = b.column("number").to_numpy() * kind.itemsize + start
            cuts = np.flatnonzero(np.diff(at) != kind.itemsize) + 1
            data = out.tobytes()
            ends = [0, *cuts.tolist(), len(out)]
            parts = [data[i * kind.itemsize : j * kind.itemsize] for i, j in zip(ends, ends[1:]) if j > i]
            firsts = [int(at[i]) for i, j in zip(ends, ends[1:]) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(firsts, pa.int64()), pa.array(parts, pa.binary())], ["name", "at", "data"])

    return rows.mapInArrow(run, "name string, at long, data binary")


def _lines(rows: DataFrame, text: Column, width: int, start: int, name: str) -> DataFrame:
    """Lines of text, filled up to a fixed width, at their numbers' places."""
    line = F.concat(F.rpad(text, width - 1, " "), F.lit("\n"))
    return rows.select(F.lit(name).alias("name"), (F.col("number") * width + start).alias("at"), F.encode(line, "UTF-8").alias("data"))


def write_mesh(triangles: DataFrame, folder: str, dims: tuple[int, int, int], suffix: str, rgb: tuple[int, int, int] | Callable[[DataFrame], DataFrame] | None = None) -> str:
    """A mesh as .ply (binary, with colours if given), .stl (binary) or .obj, of records of fixed size that tasks write in place.

    rgb is one colour, or gives the points (x, y, z and more) with bytes red, green and blue. Returns the file's path;
    ValueError if there are no triangles.
    """
    name = export_name(dims, suffix)
    spark = triangles.sparkSession
    triangles = cut(triangles, "mesh")
    n = triangles.count()
    if not n:
        raise ValueError("the mesh is empty")
    if suffix == ".stl":
        normal, flat = triangle_normal(), [c for cs in CORNERS for c in cs]
        size = F.sqrt(sum((c * c for c in normal), F.lit(0.0)))
        rows = numbered(triangles, flat, "mesh-triangles").select("number", *[F.when(size > 0, c / size).otherwise(0.0).alias(f"n{a}") for c, a in zip(normal, "xyz", strict=True)], *flat)
        columns = ["nx", "ny", "nz", *flat]
        body = _pieces(rows, columns, np.dtype([(c, "<f4") for c in columns] + [("fixed0", "<u2")]), 84, name)
        head = b"triangles".ljust(80) + n.to_bytes(4, "little")
    else:
        found, faces = indexed(triangles)
        m = found.count()
        if suffix == ".ply":
            fields = [(c, "<f4") for c in ("x", "y", "z", "nx", "ny", "nz")]
            if rgb:
                found = rgb(found) if callable(rgb) else found.select("*", *[F.lit(v).alias(c) for v, c in zip(rgb, ("red", "green", "blue"), strict=True)])
                fields += [(c, "u1") for c in ("red", "green", "blue")]
            kinds = {"<f4": "float", "u1": "uchar"}
            listed = "".join(f"property {kinds[k]} {c}\n" for c, k in fields)
            head = f"ply\nformat binary_little_endian 1.0\nelement vertex {m}\n{listed}element face {n}\nproperty list uchar int vertex_indices\nend_header\n".encode()
            point, face = np.dtype(fields), np.dtype([("fixed3", "u1"), ("p0", "<i4"), ("p1", "<i4"), ("p2", "<i4")])
            body = _pieces(found.orderBy("number"), [f for f, _ in fields], point, len(head), name)
            body = body.union(_pieces(faces.orderBy("number"), ["p0", "p1", "p2"], face, len(head) + m * point.itemsize, name))
        elif suffix == ".obj":
            head = b"# triangles\n"
            at = F.format_string("v %.9g %.9g %.9g", "x", "y", "z")
            to = F.format_string("vn %.9g %.9g %.9g", "nx", "ny", "nz")
            p = [F.col(f"p{i}") + 1 for i in range(3)]
            body = _lines(found, at, 64, len(head), name).union(_lines(found, to, 64, len(head) + 64 * m, name))
            body = body.union(_lines(faces, F.format_string("f %d//%d %d//%d %d//%d", p[0], p[0], p[1], p[1], p[2], p[2]), 96, len(head) + 128 * m, name))
        else:
            raise ValueError(f"no mesh format: {suffix}")
    start = spark.createDataFrame([(name, 0, bytearray(head))], "name string, at long, data binary")
    write_pieces(start.union(body), folder)
    return f"{folder}/{name}"
