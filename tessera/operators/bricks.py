"""Kernels on bricks: cubes of voxels with a rim from their neighbours, dealt by one shuffle, of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.dealing import BRICK, SIDE, dealt
from tessera.operators.volume import scalar_range, valid_of

def by_brick(voxels: DataFrame, kernel: Callable[[np.ndarray, tuple[int, int, int]], pd.DataFrame], schema: str, before: int, after: int, side: int = SIDE) -> DataFrame:
    """kernel(values, low) of every brick that holds voxels.

    values is indexed [z, y, x] from `low`, the brick's corner less `before`, and reaches `after` voxels beyond the
    brick; voxels that are missing or invalid are NaN. A group has at most (side + before + after)^3 rows.
    """
    shape = (side + before + after,) * 3

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = tuple(int(rows[b].iat[0]) * side - before for b in ("bx", "by", "bz"))
        values = np.full(shape, np.nan)
        values[rows["z"] - low[2], rows["y"] - low[1], rows["x"] - low[0]] = rows["value"]
        return kernel(values, low)

    value = F.when(valid_of(voxels), F.col("value").cast("double")).otherwise(F.lit(float("nan")))
    rows = voxels.select("x", "y", "z", value.alias("value"))
    return dealt(rows, before, after, side).groupBy(*BRICK).applyInPandas(run, schema)


def denoised(voxels: DataFrame, iterations: int = 5, factor: float = 0.125, threshold: float = 0.02) -> DataFrame:
    """(x, y, z, value): diffusion that stops at edges.

    In each iteration a voxel moves by `factor` times the sum of its differences to face neighbours, counting those
    below `threshold` times the volume's range. Rims hold as many voxels as there are iterations, so bricks don't wait
    for each other. Invalid voxels take no part and are left out.
    """
    lo, hi = scalar_range(voxels).first()
    most = threshold * ((hi or 0.0) - (lo or 0.0))

    def kernel(values: np.ndarray, low: tuple[int, int, int]) -> pd.DataFrame:
        for _ in range(iterations):
            moved = np.zeros_like(values)
            for axis in range(3):
                step = np.diff(values, axis=axis)
                step = np.where(np.abs(step) < most, step, 0.0)
                pad = [(0, 0)] * 3
                pad[axis] = (0, 1)
                moved += np.pad(step, pad)
                pad[axis] = (1, 0)
                moved -= np.pad(step, pad)
            values = values + factor * moved
        own = values[(slice(iterations, iterations + SIDE),) * 3]
        z, y, x = np.nonzero(~np.isnan(own))
        at = [(a + iterations + b).astype(np.int32) for a, b in zip((x, y, z), low, strict=True)]
        return pd.DataFrame({"x": at[0], "y": at[1], "z": at[2], "value": own[z, y, x]})

    return by_brick(voxels, kernel, "x int, y int, z int, value double", iterations, iterations)


def gradients(voxels: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(x, y, z, gradient): length of the central differences of each valid voxel; a missing neighbour counts as the voxel itself."""

    def kernel(values: np.ndarray, low: tuple[int, int, int]) -> pd.DataFrame:
        own = values[1:-1, 1:-1, 1:-1]
        total = np.zeros_like(own)
        for axis, step in zip((2, 1, 0), spacing, strict=True):
            sides = []
            for move in (2, 0):
                at = [slice(1, -1)] * 3
                at[axis] = slice(move, move + SIDE)
                side = values[tuple(at)]
                sides.append(np.where(np.isnan(side), own, side))
            total += ((sides[0] - sides[1]) / (2 * step)) ** 2
        z, y, x = np.nonzero(~np.isnan(own))
        at = [(a + 1 + b).astype(np.int32) for a, b in zip((x, y, z), low, strict=True)]
        return pd.DataFrame({"x": at[0], "y": at[1], "z": at[2], "gradient": np.sqrt(total[z, y, x])})

    return by_brick(voxels, kernel, "x int, y int, z int, gradient double", 1, 1)


#: Six tetrahedra of a cell, which share its diagonal; corners as bits of x, y and z.
TETRAHEDRA = [(0, 1 << p[0], 1 << p[0] | 1 << p[1], 7) for p in permutations(range(3))]
TRIANGLE = ", ".join([f"{c}{i} double" for i in range(3) for c in "xyz"] + [f"k{i} long" for i in range(3)])
#: Bits of a coordinate in the number of a grid point.
AXIS_BITS = 20


def _cut(values: np.ndarray, corners: np.ndarray, ids: np.ndarray, ways: tuple[int, ...], iso: float, inside: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (n, 3, 3) of tetrahedra whose corners numbered `inside` are at least iso, and their points' numbers; normals point away from them.

    A point on a line from grid point a is numbered eight times a's number plus the line's way (1 to 7, bits of x, y and
    z); one on a grid point eight times its number. So all cells at a point give it the same number.
    """
    outside = tuple(i for i in range(4) if i not in inside)

    def on(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = min(a, b), max(a, b)  # both cells at a face work it out alike
        t = (iso - values[:, a]) / (values[:, b] - values[:, a])
        key = np.where(t == 0, 8 * ids[:, a], np.where(t == 1, 8 * ids[:, b], 8 * ids[:, a] + (ways[b] - ways[a])))
        return corners[:, a] + t[:, None] * (corners[:, b] - corners[:, a]), key

    if len(inside) == 2:
        p = [on(inside[0], outside[0]), on(inside[0], outside[1]), on(inside[1], outside[1]), on(inside[1], outside[0])]
        faces = [(p[0], p[1], p[2]), (p[0], p[2], p[3])]
    else:
        lone, rest = (inside[0], outside) if len(inside) == 1 else (outside[0], inside)
        faces = [tuple(on(lone, r) for r in rest)]
    out = np.concatenate([np.stack([q for q, _ in f], 1) for f in faces])
    keys = np.concatenate([np.stack([k for _, k in f], 1) for f in faces])
    away = np.tile(corners[:, outside].mean(1) - corners[:, inside].mean(1), (len(faces), 1))
    normal = np.cross(out[:, 1] - out[:, 0], out[:, 2] - out[:, 0])
    wrong = (normal * away).sum(1) < 0
    out[wrong], keys[wrong] = out[wrong][:, ::-1], keys[wrong][:, ::-1]
    flat = (normal == 0).all(1)
    return out[~flat], keys[~flat]


def iso_surface(voxels: DataFrame, iso: float, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """Triangles (x0, y0, z0, ... z2) of numbered_surface(), without the numbers."""
    return numbered_surface(voxels, iso, spacing, origin).drop("k0", "k1", "k2")


def numbered_surface(voxels: DataFrame, iso: float, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """Triangles (x0, y0, z0, ... z2, k0, k1, k2) where the linear field in six tetrahedra of each cell equals iso.

    Cells with an invalid corner are left out. Points that triangles share are equal to the last bit, and have the same
    number in k0 to k2. Coordinates of the grid are below 2^20.
    """

    def kernel(values: np.ndarray, low: tuple[int, int, int]) -> pd.DataFrame:
        eight = np.stack([values[k : SIDE + k, j : SIDE + j, i : SIDE + i] for k in (0, 1) for j in (0, 1) for i in (0, 1)])
        above = (eight >= iso).sum(0)
        z, y, x = np.nonzero(~np.isnan(eight).any(0) & (above > 0) & (above < 8))
        cell, base = eight[:, z, y, x].T, np.stack([x, y, z], 1) + np.array(low)
        bits = np.array([[c & 1, c >> 1 & 1, c >> 2] for c in range(8)])
        found, keys = [np.zeros((0, 3, 3))], [np.zeros((0, 3), np.int64)]
        for tet in TETRAHEDRA:
            v, at = cell[:, tet], base[:, None, :] + bits[list(tet)]
            ids = at.astype(np.int64) @ np.array([1, 1 << AXIS_BITS, 1 << 2 * AXIS_BITS])
            code = (v >= iso) @ np.array([1, 2, 4, 8])
            for c in range(1, 15):
                if (hit := code == c).any():
                    made = _cut(v[hit], at[hit].astype(float), ids[hit], tet, iso, tuple(i for i in range(4) if c >> i & 1))
                    found.append(made[0])
                    keys.append(made[1])
        all_ = np.concatenate(found) * np.array(spacing) + np.array(origin)
        out = pd.DataFrame(all_.reshape(-1, 9), columns=[f"{c}{i}" for i in range(3) for c in "xyz"])
        out[["k0", "k1", "k2"]] = np.concatenate(keys)
        return out

    return by_brick(voxels, kernel, TRIANGLE, 0, 1)
