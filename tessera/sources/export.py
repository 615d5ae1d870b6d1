"""Export of a volume after its model's matrix: raw values, or an iso-surface as a mesh, by the name of the format."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.functions.geometry import FORMATS, check_matrix, check_nodes
from tessera.operators import bricks, mesh
from tessera.operators.volume import scalar_range
from tessera.sources.volumes import write_turned
from tessera.storage import cut

Node = tuple[float, float, float, float]


def export(voxels: DataFrame, dims: tuple[int, int, int], folder: str, suffix: str, matrix: np.ndarray, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), iso: float | None = None, nodes: list[Node] | None = None, tint: DataFrame | None = None) -> str:
    """The path of the file written for suffix (.raw, .ply, .stl or .obj, in any case).

    .raw: write_turned(). Meshes: the surface where the volume equals iso, at all voxels whatever the mask, clipped by
    the mask if there is one, then moved by the matrix. A .ply has colours of the transfer function nodes (position, red, green, blue; a
    gray ramp without any) over the volume's range, at the value of `tint` (voxels on the same grid) at each point, or else at iso.
    Everything is checked before a folder is made; ValueError tells what is wrong, or that the mesh is empty.
    """
    kind = suffix.lower()
    if kind not in FORMATS:
        raise ValueError(f"no such format: {suffix}")
    check_matrix(matrix)
    if kind == ".raw":
        return write_turned(voxels, dims, folder, matrix, spacing, origin)[0]
    if iso is None or not math.isfinite(iso):
        raise ValueError("a mesh needs a finite iso value")
    if nodes:
        check_nodes(nodes)
    surface = bricks.numbered_surface(voxels.drop("valid"), iso, spacing, origin)
    if "valid" in voxels.columns:
        surface = mesh.clipped_by_mask(surface, voxels, dims, spacing, origin)
    rgb = None
    if kind == ".ply":
        lo, hi = scalar_range(voxels).first()  # one row
        place = np.linalg.inv(np.asarray(matrix, dtype=float))

        def rgb(points: DataFrame) -> DataFrame:
            if tint is None:
                return points.select("*", *mesh.color(F.lit(float(iso)), nodes or [], lo, hi))
            own = [F.col("x") * float(r[0]) + F.col("y") * float(r[1]) + F.col("z") * float(r[2]) + float(r[3]) for r in place[:3]]
            named = {f"_{c}": F.col(c) for c in "xyz"}
            back = points.withColumns(named).withColumns(dict(zip("xyz", own, strict=True)))
            done = mesh.colored(back, tint, dims, nodes or [], (lo, hi), spacing, origin)
            return done.withColumns({c: F.col(f"_{c}") for c in "xyz"}).drop(*named)

    return mesh.write_mesh(mesh.moved(cut(surface, "surface"), matrix), folder, dims, kind, rgb)
