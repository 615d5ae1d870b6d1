"""Voxels dealt to bricks: cubes of bounded size with a rim of their neighbours, by one shuffle; and kernels on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

SIDE = 32
BRICK = ["bx", "by", "bz"]


def _owners(c: str, before: int, after: int, side: int) -> Column:
    """Bricks along an axis that need a voxel: those from (c - after) div side to (c + before) div side."""
    first, last = F.floor((F.col(c) - after) / side).cast("int"), F.floor((F.col(c) + before) / side).cast("int")
    return F.sequence(F.greatest(first, F.lit(0)), last)


def dealt(voxels: DataFrame, before: int, after: int, side: int = SIDE) -> DataFrame:
    """voxels once for each brick (bx, by, bz) that holds them, or has them in its rim."""
    for c in "xyz":
        voxels = voxels.withColumn(f"b{c}", F.explode(_owners(c, before, after, side)))
    return voxels


def on_bricks(cells: DataFrame, kernel: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: StructType | str, before: int, after: int, side: int = SIDE) -> DataFrame:
    """kernel(rows, grid, own) of every brick that holds cells(x, y, z, ...).

    grid[z, y, x] is the number of the row at a place of the brick with its rim, -1 where there is none; own tells
    which rows are the brick's and not its rim's. A group has at most (side + before + after)^3 rows.
    """
    shape = (side + before + after,) * 3

    def run(rows: pa.Table) -> pa.Table:
        at = [rows[c].to_numpy() - side * rows[f"b{c}"][0].as_py() + before for c in "zyx"]
        grid = np.full(shape, -1)
        grid[tuple(at)] = np.arange(rows.num_rows)
        own = np.all([(a >= before) & (a < before + side) for a in at], axis=0)
        return kernel(rows.drop_columns(BRICK), grid, own)

    return dealt(cells, before, after, side).groupBy(*BRICK).applyInArrow(run, schema)


def _steps(grid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of face neighbours, for each axis."""
    for axis in range(3):
        a, b = np.delete(grid, -1, axis), np.delete(grid, 0, axis)
        both = (a >= 0) & (b >= 0)
        yield a[both], b[both]


def _least(idx: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Of every row the smallest idx of its component within the grid: roots hang on smaller ones until none differ."""
    order = np.argsort(idx)
    rank = np.empty(len(idx), dtype=np.int64)
    rank[order] = np.arange(len(idx))
    u, v = (rank[np.concatenate(ends)] for ends in zip(*_steps(grid), strict=True))
    root = np.arange(len(idx))
    while (differ := root[u] != root[v]).any():
        u, v = u[differ], v[differ]
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while not np.array_equal(root, up := root[root]):
            root = up
    return idx[order][root[rank]]


def parts(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """cells with part, the smallest idx of their component within their brick, and own, false for rows of a rim.

    Each brick has a rim of one voxel after it, so a voxel in a rim has a part in several bricks: these are one component.
    """

    def kernel(rows: pa.Table, grid: np.ndarray, own: np.ndarray) -> pa.Table:
        return rows.append_column("part", pa.array(_least(rows["idx"].to_numpy(), grid))).append_column("own", pa.array(own))

    fields = [StructField(f.name, f.dataType) for f in cells.schema]
    return on_bricks(cells, kernel, StructType([*fields, StructField("part", LongType()), StructField("own", BooleanType())]), 0, 1, side)


def eroded_roots(cells: DataFrame, erosions: int, side: int = SIDE) -> DataFrame:
    """(root), distinct: those of cells(x, y, z, root) that are left after so many erosions by face neighbours."""

    def kernel(rows: pa.Table, grid: np.ndarray, own: np.ndarray) -> pa.Table:
        left = grid >= 0
        for _ in range(erosions):
            whole = np.pad(left, 1)
            for axis, step in product(range(3), (-1, 1)):
                left = left & np.roll(whole, step, axis)[1:-1, 1:-1, 1:-1]
        rest = grid[left]
        return pa.table({"root": pa.array(np.unique(rows["root"].to_numpy()[rest[own[rest]]]), pa.int64())})

    return on_bricks(cells.select("x", "y", "z", F.col("root").cast("long").alias("root")), kernel, "root long", erosions, erosions, side).distinct()


def contacts(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(root, voxels, inside): how many cells(x, y, z, root) there are, and how many of their 26 neighbours have the same root."""

    def kernel(rows: pa.Table, grid: np.ndarray, own: np.ndarray) -> pa.Table:
        roots, code = np.unique(rows["root"].to_numpy(), return_inverse=True)
        marks = np.where(grid >= 0, code[grid], -1)
        centre = marks[1:-1, 1:-1, 1:-1]
        same = np.zeros(centre.shape, dtype=np.int64)
        for low in product(range(3), repeat=3):
            same += centre == marks[tuple(slice(a, a + side) for a in low)]
        held = centre >= 0
        voxels = np.bincount(centre[held], minlength=len(roots))
        inside = np.bincount(centre[held], same[held] - 1, minlength=len(roots)).astype(np.int64)
        some = voxels > 0
        return pa.table({"root": pa.array(roots[some]), "voxels": pa.array(voxels[some]), "inside": pa.array(inside[some])})

    found = on_bricks(cells.select("x", "y", "z", F.col("root").cast("long").alias("root")), kernel, "root long, voxels long, inside long", 1, 1, side)
    return found.groupBy("root").agg(F.sum("voxels").alias("voxels"), F.sum("inside").alias("inside"))


def projections(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(root, plane, bu, bv, bits): for each brick and plane (xy, xz, yz) a bitmap of the side^2 places that cells(x, y, z, root) cover."""

    def kernel(rows: pa.Table, grid: np.ndarray, own: np.ndarray) -> pa.Table:
        roots, code = np.unique(rows["root"].to_numpy(), return_inverse=True)
        at = {c: rows[c].to_numpy() for c in "xyz"}
        out: dict[str, list] = {"root": [], "plane": [], "bu": [], "bv": [], "bits": []}
        for u, v in ("xy", "xz", "yz"):
            place = at[u] % side + side * (at[v] % side)
            pairs = np.unique(code * side**2 + place)
            first = np.searchsorted(pairs, np.arange(len(roots) + 1) * side**2)
            for k, root in enumerate(roots.tolist()):
                held = np.zeros(side**2, bool)
                held[pairs[first[k] : first[k + 1]] % side**2] = True
                for name, value in zip(out, (root, u + v, int(at[u][0] // side), int(at[v][0] // side), np.packbits(held).tobytes()), strict=True):
                    out[name].append(value)
        return pa.table({"root": pa.array(out["root"], pa.int64()), "plane": pa.array(out["plane"], pa.string()), "bu": pa.array(out["bu"], pa.int32()), "bv": pa.array(out["bv"], pa.int32()), "bits": pa.array(out["bits"], pa.binary())})

    return on_bricks(cells.select("x", "y", "z", F.col("root").cast("long").alias("root")), kernel, "root long, plane string, bu int, bv int, bits binary", 0, 0, side)
