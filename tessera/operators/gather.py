"""Volumes read at other places: whole grids after an affine map, and free points. Voxels move once, to bricks with a rim.

Every place lies in the cell of exactly one brick, which has all eight corners with its rim, so a value is worked out
where the brick is. For a grid, bricks hand what they made to bricks of the new grid, as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geometry import check_layout, check_matrix
from tessera.operators.dealing import BRICK, SIDE, dealt
from tessera.storage import cut, small_side

Dims = tuple[int, int, int]
#: Voxels of a brick of a new grid along x, y and z: cubes for what follows, long rows for files; and across and in planes.
CUBE, ROWS, FLAT = (32, 32, 32), (256, 16, 8), (8, 128, 64)
#: Points that one brick answers in a group; a brick with more is copied.
POINTS = 1 << 16


def back_map(spacing: tuple[float, float, float], origin: tuple[float, float, float], matrix: np.ndarray, to_origin: np.ndarray) -> np.ndarray:
    """Three rows of four that take indices of a grid of the same spacing from to_origin to indices of the volume, whose model goes through matrix."""
    check_matrix(matrix)
    place = np.diag([*spacing, 1.0])
    own, new = place.copy(), place.copy()
    own[:3, 3], new[:3, 3] = origin, to_origin
    return (np.linalg.inv(own) @ np.linalg.inv(np.asarray(matrix, dtype=float)) @ new)[:3]


def turned_grid(dims: Dims, spacing: tuple[float, float, float], origin: tuple[float, float, float], matrix: np.ndarray) -> tuple[Dims, np.ndarray]:
    """Sizes and origin of the grid that is cut to a volume after matrix, with its spacing.

    It begins at the least coordinates of the eight turned corners (middles of the outermost voxels) and ends at the last
    step within the largest ones; a thousandth of a step beyond them counts as within.
    """
    check_layout(dims, spacing, origin)
    ends = np.array([[o + s * (d - 1) * b for o, s, d, b in zip(origin, spacing, dims, bits, strict=True)] + [1.0] for bits in product((0, 1), repeat=3)])
    corners = (ends @ np.asarray(matrix, dtype=float).T)[:, :3]
    low, high = corners.min(0), corners.max(0)
    return tuple(int(math.floor((h - a) / s + 1e-3)) + 1 for a, h, s in zip(low, high, spacing, strict=True)), low


def _block(rows: pa.Table, low: list[int], side: int, kind: np.dtype) -> np.ndarray:
    """values[z, y, x] of a brick with its rim; missing ones are 0."""
    out = np.zeros((side + 1,) * 3, kind)
    at = [rows[c].to_numpy() - a for c, a in zip("zyx", low[::-1], strict=True)]
    out[tuple(at)] = rows["value"].to_numpy(zero_copy_only=False)
    return out


def _read(block: np.ndarray, base: list[np.ndarray], share: list[np.ndarray]) -> np.ndarray:
    """Linear between the corners at base and one further along x, y and z; those of no weight don't count, whatever they hold."""
    out = np.zeros(base[0].shape)
    for bits in product((0, 1), repeat=3):
        weight = np.ones(base[0].shape)
        for b, s in zip(bits, share, strict=True):
            weight = weight * (s if b else 1 - s)
        some = weight > 0
        x, y, z = (np.minimum(a + b, block.shape[0] - 1)[some] for a, b in zip(base, bits, strict=True))
        out[some] += weight[some] * block[z, y, x]
    return out


def _made(voxels: DataFrame, dims: Dims, to: Dims, back: list[list[float]], shape: Dims, nearest: bool, clamp: bool) -> DataFrame:
    """(ox, oy, oz, at, values): what each brick gives to a brick of the new grid: 16-bit places in it and doubles, as bytes."""
    m = np.asarray(back, dtype=float)
    square = m[:, :3]
    forward = np.linalg.inv(square) if abs(np.linalg.det(square)) > 1e-12 * np.prod(np.linalg.norm(square, axis=1)) else None
    grow = 1.0 if forward is None else max(1.0, float(np.abs(forward).sum(1).max()))
    side = max(4, min(SIDE, int(2 * SIDE / grow)))  # so that a task of an enlarged volume makes no more than others
    last = np.array(dims) - 1
    ends = np.array(list(product(*[(0.0, n - 1.0) for n in to])))
    reach = ends @ square.T + m[:, 3]

    def span(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the new grid that a brick can reach; with a margin, since each place is tested by itself."""
        a, b = low - 1e-6 - 0.5 * nearest, low + side + 1e-6
        if clamp:
            a, b = np.where(low <= 0, np.minimum(a, reach.min(0)), a), np.where(low + side > last, np.maximum(b, reach.max(0)), b)
        if forward is None:
            return np.zeros(3, int), np.array(to) - 1
        found = (np.array(list(product(*zip(a, b, strict=True)))) - m[:, 3]) @ forward.T
        return np.maximum(np.floor(found.min(0) - 1e-6).astype(int), 0), np.minimum(np.ceil(found.max(0) + 1e-6).astype(int), np.array(to) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        low = [int(rows[b][0].as_py()) * side for b in BRICK]
        block = _block(rows, low, side, np.float64)
        first, end = span(np.array(low))
        if (first > end).any():
            return
        for o in product(*[range(a // s, b // s + 1) for a, b, s in zip(first, end, shape, strict=True)]):
            axes = [np.arange(max(a, k * s), min(b, k * s + s - 1) + 1) for a, b, k, s in zip(first, end, o, shape, strict=True)]
            x, y, z = axes[0][None, None, :], axes[1][None, :, None], axes[2][:, None, None]
            f = [x * r[0] + y * r[1] + z * r[2] + r[3] for r in m]
            inside = np.ones(f[0].shape, bool)
            base, share = [], []
            for c, d, a in zip(f, dims, low, strict=True):
                if clamp:
                    c = np.clip(c, 0, d - 1)
                b = np.floor(c + 0.5) if nearest else np.floor(c)
                inside &= (b >= 0) & (b <= d - 1) & (b >= a) & (b < a + side) & (nearest | (c <= d - 1))
                base.append(b)
                share.append(c - b)
            if not inside.any():
                continue
            at = (axes[0] % shape[0])[None, None, :] + shape[0] * ((axes[1] % shape[1])[None, :, None] + shape[1] * (axes[2] % shape[2])[:, None, None])
            own = [b[inside].astype(int) - a for b, a in zip(base, low, strict=True)]
            values = block[own[2], own[1], own[0]] if nearest else _read(block, own, [s[inside] for s in share])
            data = [pa.array([int(k)], pa.int32()) for k in o] + [pa.array([x.tobytes()], pa.binary()) for x in (at[inside].astype("<u2"), values.astype("<f8"))]
            yield pa.RecordBatch.from_arrays(data, ["ox", "oy", "oz", "at", "values"])

    rows = voxels.select("x", "y", "z", F.col("value").cast("double").alias("value"))
    return dealt(rows, 0, 1, side).groupBy(*BRICK).applyInArrow(run, "ox int, oy int, oz int, at binary, values binary")


def _whole(made: DataFrame, to: Dims, shape: Dims, outside: float, schema: str, give) -> DataFrame:
    """give(low, sizes, values[z, y, x]) of every brick of the new grid, with `outside` where no brick of the volume reached."""
    count = [-(-n // s) for n, s in zip(to, shape, strict=True)]
    grid = made.sparkSession.range(count[0] * count[1] * count[2])
    empty = F.lit(b"")
    at = [F.expr(f"cast(id % {count[0]} as int)"), F.expr(f"cast(id div {count[0]} % {count[1]} as int)"), F.expr(f"cast(id div {count[0] * count[1]} as int)")]
    seeds = grid.select(*[a.alias(n) for a, n in zip(at, ("ox", "oy", "oz"), strict=True)], empty.alias("at"), empty.alias("values"))

    def run(rows: pa.Table) -> pa.Table:
        low = [rows[n][0].as_py() * s for n, s in zip(("ox", "oy", "oz"), shape, strict=True)]
        values = np.full(shape[0] * shape[1] * shape[2], outside)
        for places, data in zip(rows["at"], rows["values"], strict=True):
            values[np.frombuffer(places.as_buffer(), "<u2")] = np.frombuffer(data.as_buffer(), "<f8")
        sizes = [min(s, n - a) for s, n, a in zip(shape, to, low, strict=True)]
        return give(low, sizes, values.reshape(shape[::-1])[: sizes[2], : sizes[1], : sizes[0]])

    return made.union(seeds).groupBy("ox", "oy", "oz").applyInArrow(run, schema)


def regridded(voxels: DataFrame, dims: Dims, to: Dims, back: list[list[float]], outside: float | None = 0.0, nearest: bool = False) -> DataFrame:
    """(idx, x, y, z, value double) of a dense grid `to`, whose indices `back` (three rows of four) takes to those of the volume.

    Linear between voxels, or the value of the nearest one (a half rounds up). Places beyond the middles of the outermost
    voxels (for the nearest: beyond half a voxel more) get `outside`; with None they get the value at the volume's
    edge. Voxels that are missing count as 0.
    """
    made = _made(voxels, dims, to, back, CUBE, nearest, outside is None)

    def give(low: list[int], sizes: list[int], values: np.ndarray) -> pa.Table:
        z, y, x = (a.ravel() + b for a, b in zip(np.indices(values.shape), low[::-1], strict=True))
        idx = x + to[0] * (y + to[1] * z)
        return pa.table({"idx": pa.array(idx), **{n: pa.array(a.astype(np.int32)) for n, a in zip("xyz", (x, y, z), strict=True)}, "value": pa.array(values.ravel())})

    return _whole(made, to, CUBE, 0.0 if outside is None else float(outside), "idx long, x int, y int, z int, value double", give)


def turned_pieces(voxels: DataFrame, dims: Dims, to: Dims, back: list[list[float]], outside: float, name: str) -> DataFrame:
    """(name, at, data): the linear values on the grid `to` as pieces of a file of 32-bit floats, x fastest, straight from its bricks."""
    made = _made(voxels, dims, to, back, ROWS, False, False)

    def give(low: list[int], sizes: list[int], values: np.ndarray) -> pa.Table:
        lines = np.ascontiguousarray(values.astype("<f4")).reshape(-1, sizes[0])
        z, y = (a.ravel() for a in np.indices(values.shape[:2]))
        at = 4 * (low[0] + to[0] * (low[1] + y + to[1] * (low[2] + z).astype(np.int64)))
        return pa.table({"name": pa.array([name] * len(lines)), "at": pa.array(at), "data": pa.array([r.tobytes() for r in lines], pa.binary())})

    return _whole(made, to, ROWS, outside, "name string, at long, data binary", give)


def turned_planes(voxels: DataFrame, dims: Dims, to: Dims, back: list[list[float]], outside: float, axes: tuple[str, str, str], shade: Callable[[np.ndarray], np.ndarray], nearest: bool = False) -> DataFrame:
    """(k, u, v, width, data): bytes that shade() makes of values on the grid `to`, as rectangles of the planes across an axis.

    axes are the one across the planes and the two in them; k is the plane, u and v the rectangle's first place in it.
    """
    shape = tuple(dict(zip(axes, FLAT, strict=True))[c] for c in "xyz")
    order = tuple("zyx".index(c) for c in (axes[0], axes[2], axes[1]))
    made = _made(voxels, dims, to, back, shape, nearest, False)

    def give(low: list[int], sizes: list[int], values: np.ndarray) -> pa.Table:
        planes = shade(values).astype(np.uint8).transpose(order)
        k, u, v = (dict(zip("xyz", low, strict=True))[c] for c in axes)
        n = len(planes)
        places = {"k": range(k, k + n), "u": [u] * n, "v": [v] * n, "width": [planes.shape[2]] * n}
        return pa.table({**{c: pa.array(p, pa.int32()) for c, p in places.items()}, "data": pa.array([p.tobytes() for p in planes], pa.binary())})

    return _whole(made, to, shape, outside, "k int, u int, v int, width int, data binary", give)


Place = tuple[str, str, str]


def sampled(rows: DataFrame, places: list[Place], names: list[str], voxels: DataFrame, dims: Dims, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), outside: float = 0.0, closed: bool = True) -> DataFrame:
    """rows with the linear value of a volume at each of their places (three columns), as double columns `names`.

    `outside` is the value of places beyond the middles of the outermost voxels, and of those on the last ones unless
    `closed`, since these have no whole cell; it is also that of places that aren't numbers or are null. Rows are dealt
    to the brick of their first place, which answers the others too that lie in it; only rows with places elsewhere move
    again. A brick that is asked by more than POINTS rows is copied for each share of them.
    """
    done = None
    for i in range(len(places)):
        kept = names[:i]
        found = _sampled(rows, places, names, kept, i, voxels, dims, spacing, origin, outside, closed)
        if i + 1 < len(places):
            found = cut(found, "sampled")
            known = F.forall(F.array(*names[i + 1 :]), lambda v: v.isNotNull())
            done = found.where(known) if done is None else done.unionByName(found.where(known))
            left = found.where(~known)
            if left.isEmpty():
                return done
            rows = left
        else:
            done = found if done is None else done.unionByName(found)
    return done


def _sampled(rows: DataFrame, places: list[Place], names: list[str], kept: list[str], first: int, voxels: DataFrame, dims: Dims, spacing: tuple, origin: tuple, outside: float, closed: bool) -> DataFrame:
    def index(c: str, axis: int) -> Column:
        return (F.col(c).cast("double") - float(origin[axis])) / float(spacing[axis])

    def brick(axis: int) -> Column:
        at = index(places[first][axis], axis)
        held = F.when(at.between(0, dims[axis] - 1), at).otherwise(0.0)
        return F.expr("cast(0 as int)") if dims[axis] <= 1 else F.least(F.floor(held / SIDE), F.lit((dims[axis] - 1) // SIDE)).cast("int")

    own = [c for c in rows.columns if c not in names]
    keep = rows.select(*own, *[c for c in names if c in rows.columns])
    asked = keep.withColumns({b: brick(a) for a, b in enumerate(BRICK)})
    shares = asked.groupBy(*BRICK).agg(F.ceil(F.count("*") / POINTS).cast("int").alias("shares"))
    shares = cut(shares, "shares")
    asked = asked.join(small_side(shares, 32), BRICK).withColumn("share", F.pmod(F.xxhash64(*[F.col(c) for c in places[first]], F.monotonically_increasing_id()), F.col("shares")).cast("int")).drop("shares")
    volume = dealt(voxels.select("x", "y", "z", F.col("value").cast("double").alias("value")), 0, 1)
    volume = volume.join(small_side(shares, 32), BRICK).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def run(points: pa.Table, block_rows: pa.Table) -> pa.Table:
        low = [int(points[b][0].as_py()) * SIDE for b in BRICK] if points.num_rows else [0, 0, 0]
        block = _block(block_rows, low, SIDE, np.float64) if block_rows.num_rows else np.zeros((SIDE + 1,) * 3)
        out = points.select(own)
        for name, place in zip(names, places, strict=True):
            if name in kept:
                out = out.append_column(name, points[name].combine_chunks())
                continue
            f = [(points[c].to_numpy(zero_copy_only=False).astype(float) - o) / s for c, o, s in zip(place, origin, spacing, strict=True)]
            beyond = np.zeros(len(f[0]), bool)
            here = np.ones(len(f[0]), bool)
            for c, d, a in zip(f, dims, low, strict=True):
                beyond |= ~((c >= 0) & ((c <= d - 1) if closed else (c < d - 1)))
                here &= (c >= a) & (c <= a + SIDE)
            value = np.full(len(f[0]), float(outside))
            some = here & ~beyond
            base = [np.minimum(np.floor(c[some]).astype(int) - a, SIDE - 1) for c, a in zip(f, low, strict=True)]
            value[some] = _read(block, base, [c[some] - a - b for c, a, b in zip(f, low, base, strict=True)])
            known = pa.array(value, mask=~(here | beyond))
            if name in points.column_names:
                known = pc.coalesce(points[name].combine_chunks(), known)
            out = out.append_column(name, known)
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    schema = f"{fields}, " + ", ".join(f"`{n}` double" for n in names)
    key = [*BRICK, "share"]
    return asked.groupBy(*key).cogroup(volume.groupBy(*key)).applyInArrow(run, schema)
