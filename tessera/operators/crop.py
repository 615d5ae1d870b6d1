"""Crop results as a whole, and the checks before them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.functions.geometry import check_compiled, is_affine
from tessera.operators import volume as V

GEOMETRY = ("dims", "spacing", "origin", "direction")


class EmptyResult(ValueError):
    """No voxel is kept."""


def check_mask(volume: dict, mask: dict) -> None:
    """A mask must have one component of type uint8 and exactly the volume's geometry."""
    if (mask["type"], mask["components"]) != ("uint8", 1):
        raise ValueError("a mask has one component of type uint8")
    for name in GEOMETRY:
        if not np.array_equal(np.asarray(volume[name]), np.asarray(mask[name])):
            raise ValueError(f"mask and volume differ in {name}")


def check_corners(dims: tuple[int, int, int], matrix: np.ndarray) -> None:
    """All eight corners of the grid must be finite in single precision."""
    corners = np.array([[i * (dims[0] - 1), j * (dims[1] - 1), k * (dims[2] - 1), 1.0] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    placed = corners @ np.asarray(matrix, dtype=float).T
    if not (np.isfinite(placed).all() and (np.abs(placed[:, :3]) <= np.finfo(np.float32).max).all()):
        raise ValueError("a corner is out of the range of single precision")


def check_input(version: int, bounds: list[tuple[float, float]], volume: dict | None = None, mask: dict | None = None, triangles: DataFrame | None = None) -> None:
    """A crop starts from one volume, with or without a mask, or from one mesh, which has no mask; of a version other than 0, within bounds in order."""
    if version == 0 or len(bounds) != 3 or not all(math.isfinite(a) and math.isfinite(b) and a < b for a, b in bounds):
        raise ValueError("no version, or bounds that are not in order")
    if (volume is None) == (triangles is None) or (mask is not None and volume is None):
        raise ValueError("either a volume or a mesh, and a mask for a volume only")
    if mask is not None:
        check_mask(volume, mask)


def kept_counts(masked: DataFrame) -> DataFrame:
    """(z, kept): valid voxels of each plane; counts are added up on the map side first."""
    return masked.groupBy("z").agg(F.count_if(V.valid_of(masked)).alias("kept"))


def cropped(voxels: DataFrame, ops: list[dict], count: int, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """voxels whose valid column holds where the present mask and the first `count` operations do; values stay.

    Raises EmptyResult if nothing is left, and ValueError for operations that check_compiled() rejects.
    """
    check_compiled(ops, count)
    masked = voxels.withColumn("valid", V.valid_of(voxels) & V.kept(V.point(spacing, origin), ops, count))
    if masked.where("valid").isEmpty():
        raise EmptyResult("no voxel is kept")
    return masked


def cropped_mesh(triangles: DataFrame, ops: list[dict], count: int) -> DataFrame:
    """mesh.clipped() by the first `count` operations; raises EmptyResult if nothing is left."""
    from tessera.operators import mesh

    check_compiled(ops, count)
    left = mesh.clipped(triangles, lambda p: V.kept(tuple(c.cast("float") for c in p), ops, count))
    if left.isEmpty():
        raise EmptyResult("no triangle is kept")
    return left


def same_operation(a: dict, b: dict, tolerance: float = 1e-9) -> bool:
    """Equal shape and mode, and numbers that differ by `tolerance` of the larger one (or of 1) at most."""
    if (a["shape"], a["mode"]) != (b["shape"], b["mode"]):
        return False
    for name in ("matrix",) if a["shape"] == "box" else ("center", "normal"):
        pairs = zip(np.ravel(a[name]).tolist(), np.ravel(b[name]).tolist(), strict=True)
        if not all(abs(x - y) <= tolerance * max(1.0, abs(x), abs(y)) for x, y in pairs):
            return False
    return True


def box_operation(world_box: np.ndarray, world_to_model: np.ndarray, mode: str, number: int) -> dict:
    """A box given in world space (the matrix of the unit cube [-1, 1]) as an operation on the model."""
    matrix = np.asarray(world_to_model, dtype=float) @ np.asarray(world_box, dtype=float)
    if not is_affine(matrix):
        raise ValueError("not an invertible affine matrix")
    return {"id": number, "shape": "box", "mode": mode, "matrix": matrix}


def plane_operation(center: tuple[float, float, float], normal: tuple[float, float, float], world_to_model: np.ndarray, mode: str, number: int) -> dict:
    """A plane given in world space as an operation on the model: points move, normals go by the inverse transpose."""
    m = np.asarray(world_to_model, dtype=float)
    if not is_affine(m):
        raise ValueError("not an invertible affine matrix")
    turned = np.linalg.inv(m[:3, :3]).T @ np.asarray(normal, dtype=float)
    length = math.sqrt(float(turned @ turned))
    if not 0 < length < math.inf:
        raise ValueError("a plane needs a normal")
    return {"id": number, "shape": "plane", "mode": mode, "center": (m @ [*center, 1.0])[:3].tolist(), "normal": (turned / length).tolist()}


def box_from_corners(corner: np.ndarray, along_x: np.ndarray, along_y: np.ndarray, along_z: np.ndarray) -> np.ndarray:
    """The matrix of the unit cube [-1, 1] for the box with a corner and its three neighbours."""
    corner = np.asarray(corner, dtype=float)
    edges = [np.asarray(p, dtype=float) - corner for p in (along_x, along_y, along_z)]
    out = np.eye(4)
    out[:3, :3] = np.stack([e / 2 for e in edges], axis=1)
    out[:3, 3] = corner + sum(edges) / 2
    if not is_affine(out):
        raise ValueError("a box must have a volume")
    return out
