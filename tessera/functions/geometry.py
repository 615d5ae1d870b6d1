"""Small matrices, names and request checks that the driver works out before a job; all plain values, no voxels."""

from __future__ import annotations

import math
import re
from pathlib import PurePath

import numpy as np
from pyspark.sql import Column, functions as F

#: Axis that a slice orientation looks along, its in-plane axes, and the axis and sign of its export rotation.
ORIENTATIONS = {"top_down": ("z", "x", "y", 2, -1), "front_back": ("y", "x", "z", 1, -1), "left_right": ("x", "y", "z", 0, 1)}
FORMATS = {".raw", ".ply", ".stl", ".obj"}


def rotation(axis: int, degrees: float) -> np.ndarray:
    a, b = (axis + 1) % 3, (axis + 2) % 3
    t, out = math.radians(degrees), np.eye(4)
    out[a, a] = out[b, b] = math.cos(t)
    out[b, a], out[a, b] = math.sin(t), -math.sin(t)
    return out


def translation(t: tuple[float, float, float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = t
    return out


def model_matrix(now: np.ndarray, move: tuple[float, float, float], turn: tuple[float, float, float], scale: tuple[float, float, float]) -> np.ndarray:
    """Scale (0 counts as 1), turns about x, y and z, and a move, after the present matrix."""
    out = np.diag([*(s or 1.0 for s in scale), 1.0])
    for axis in range(3):
        out = rotation(axis, turn[axis]) @ out
    return translation(move) @ out @ now


def slice_matrix(now: np.ndarray, orientation: str, center: tuple[float, float, float], degrees: float | None) -> np.ndarray:
    """The present matrix turned about a centre by the orientation's axis; without an angle as it is."""
    if degrees is None:
        return now
    *_, axis, sign = ORIENTATIONS[orientation]
    back = tuple(-c for c in center)
    return translation(center) @ rotation(axis, sign * degrees) @ translation(back) @ now


def box_matrix(low: tuple[float, float, float], high: tuple[float, float, float]) -> np.ndarray:
    """Takes the cube from -1 to 1 to the box: half extents on the diagonal, the centre in the last column."""
    out = np.diag([*((h - a) / 2 for a, h in zip(low, high, strict=True)), 1.0])
    out[:3, 3] = [(h + a) / 2 for a, h in zip(low, high, strict=True)]
    return out


def world_bounds(matrix: np.ndarray, low: tuple[float, float, float], high: tuple[float, float, float]) -> tuple[list[float], list[float]]:
    """Bounds of a box's eight corners after a matrix."""
    corners = np.array([[(low, high)[i][0], (low, high)[j][1], (low, high)[k][2], 1.0] for i in (0, 1) for j in (0, 1) for k in (0, 1)]) @ matrix.T
    corners = corners[:, :3] / np.where(corners[:, 3:] == 0, 1.0, corners[:, 3:])
    return corners.min(axis=0).tolist(), corners.max(axis=0).tolist()


def is_affine(m: np.ndarray) -> bool:
    """Finite, with the last row of an affine map, and a determinant that isn't lost in rounding at the rows' scale."""
    m = np.asarray(m, dtype=float)
    if m.shape != (4, 4) or not np.isfinite(m).all() or np.abs(m[3] - [0, 0, 0, 1]).max() > 1e-12:
        return False
    scale = np.linalg.norm(m[:3, :3], axis=1).prod()
    return abs(np.linalg.det(m[:3, :3])) > 8 * np.finfo(float).eps * scale


def check_matrix(m: np.ndarray) -> None:
    if not is_affine(m):
        raise ValueError("not an invertible affine matrix")


def check_layout(dims: tuple[int, int, int], spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), values: int | None = None) -> int:
    """The number of voxels. Sizes and spacings are positive, numbers finite, and four bytes a voxel are below 2^63; `values` has as many."""
    if len(dims) != 3 or any(d <= 0 for d in dims) or not all(math.isfinite(s) and s > 0 for s in spacing) or not all(map(math.isfinite, origin)):
        raise ValueError("a layout has positive sizes and spacings and a finite origin")
    count = math.prod(int(d) for d in dims)
    if 4 * count >= 1 << 63:
        raise ValueError("too many voxels")
    if values is not None and values != count:
        raise ValueError(f"{values} values for {count} voxels")
    return count


def check_snapshot(version: int, dims: tuple[int, int, int], image_dims: tuple[int, int, int], spacing: tuple[float, float, float], origin: tuple[float, float, float], span: tuple[float, float]) -> None:
    """What an analysis begins from: a published version (not 0) of an image with the sizes it says, and a finite range in order."""
    check_layout(image_dims, spacing, origin)
    if version == 0 or tuple(dims) != tuple(image_dims):
        raise ValueError("not a published version of this image")
    if not all(map(math.isfinite, span)) or span[0] > span[1]:
        raise ValueError("the range is not finite and in order")


def transformed(point: tuple[Column, Column, Column], m: np.ndarray) -> tuple[Column, Column, Column]:
    """A point after a homogeneous matrix; a zero weight divides nothing."""
    rows = [point[0] * float(r[0]) + point[1] * float(r[1]) + point[2] * float(r[2]) + float(r[3]) for r in np.asarray(m)]
    if np.array_equal(np.asarray(m)[3], [0, 0, 0, 1]):
        return tuple(rows[:3])
    w = F.when(rows[3] == 0, F.lit(1.0)).otherwise(rows[3])
    return tuple(r / w for r in rows[:3])


def crop_table(ops: list[dict]) -> list[dict]:
    """Operations ready for volume.kept(); ValueError tells what is wrong with one.

    Ids must be unique and positive; a box takes an invertible affine `matrix`, whose inverse is stored; a plane takes
    a finite centre and a normal that isn't zero, stored at length one.
    """
    out, seen = [], set()
    for op in ops:
        if op["id"] <= 0 or op["id"] in seen:
            raise ValueError("operation ids must be unique and positive")
        seen.add(op["id"])
        if op["mode"] not in ("keep", "remove"):
            raise ValueError("unknown mode")
        if op["shape"] == "box":
            if not is_affine(op["matrix"]):
                raise ValueError("the box has no inverse")
            out.append({"shape": "box", "mode": op["mode"], "inverse": np.linalg.inv(op["matrix"])[:3].tolist()})
        elif op["shape"] == "plane":
            numbers = np.array([*op["center"], *op["normal"]], dtype=float)
            size = float(np.linalg.norm(numbers[3:]))
            if not np.isfinite(numbers).all() or size == 0:
                raise ValueError("the plane needs a finite centre and a normal")
            out.append({"shape": "plane", "mode": op["mode"], "center": numbers[:3].tolist(), "normal": (numbers[3:] / size).tolist()})
        else:
            raise ValueError("unknown shape")
    return out


def check_compiled(ops: list[dict], count: int) -> None:
    """Of operations as crop_table() gives them, the first `count` are checked: there are as many, with known shapes and modes and finite numbers.

    A box's inverse is three rows of a map that can be inverted; a plane's normal isn't zero.
    """
    if not 0 <= count <= len(ops):
        raise ValueError("more operations are active than there are")
    for op in ops[:count]:
        if op["mode"] not in ("keep", "remove") or op["shape"] not in ("box", "plane"):
            raise ValueError("unknown shape or mode")
        numbers = np.array(op["inverse"] if op["shape"] == "box" else [op["center"], op["normal"]], dtype=float)
        if numbers.shape != ((3, 4) if op["shape"] == "box" else (2, 3)) or not np.isfinite(numbers).all():
            raise ValueError("an operation's numbers are missing or not finite")
        if np.linalg.det(numbers[:, :3]) == 0 if op["shape"] == "box" else np.linalg.norm(numbers[1]) <= 1e-12:
            raise ValueError("the box has no inverse, or the plane no normal")


def raw_dims(path: str) -> tuple[int, int, int] | None:
    """Sizes at the end of a .raw file's name, as in scan_3x4x5.raw."""
    name = PurePath(path)
    found = re.search(r"(?:^|\D)(\d+)[xX](\d+)[xX](\d+)$", name.stem) if name.suffix.lower() == ".raw" else None
    dims = tuple(map(int, found.groups())) if found else None
    return dims if dims and all(0 < d < 1 << 31 for d in dims) else None


def resolved_dims(path: str, dims: tuple[int, int, int]) -> tuple[int, int, int]:
    """The given sizes, or those of the name if all are zero."""
    found = raw_dims(path) if not any(dims) else dims
    if found is None or any(d <= 0 for d in found):
        raise ValueError("sizes must be positive, or all zero and in the name")
    return tuple(found)


def raw_dims_columns(name: Column) -> list[Column]:
    """raw_dims() of a column of names: nx, ny, nz, null where there are none."""
    pattern = r"(?:^|.*[^0-9])([0-9]{1,9})[xX]([0-9]{1,9})[xX]([0-9]{1,9})\.[rR][aA][wW]$"
    parts = [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("int") for i in (1, 2, 3)]
    good = (parts[0] > 0) & (parts[1] > 0) & (parts[2] > 0)
    return [F.when(good, p).alias(n) for p, n in zip(parts, ("nx", "ny", "nz"), strict=True)]


def natural_key(name: Column) -> Column:
    """A sort key that puts digit runs in the order of their numbers: each gets its length (2 digits) before it, zeros in front removed."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    number = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number(r)).cast("string"), 3, "0"), number(r))).otherwise(r)), "")


def downsampled_dims(dims: tuple[int, int, int], target: int = 766) -> tuple[int, int, int]:
    """Sizes with the largest at the target, all by the same factor; smaller volumes stay as they are."""
    f = target / max(dims)
    return tuple(dims) if f >= 1 else tuple(max(1, math.floor(d * f)) for d in dims)


def window_drag(dx: float, dy: float, width: float, height: float, window: float, center: float) -> tuple[float, float]:
    """Window and centre after a drag over a view: they move by three times its share, in proportion to their size (0.01 at least)."""
    if not width or not height:
        return window, center
    return max(0.01, window + 3 * dx / width * max(abs(window), 0.01)), center - 3 * dy / height * max(abs(center), 0.01)


def default_window(lo: float, hi: float) -> tuple[float, float]:
    return hi - lo, (lo + hi) / 2


def export_name(dims: tuple[int, int, int], suffix: str) -> str:
    if suffix.lower() not in FORMATS:
        raise ValueError(f"no such format: {suffix}")
    return f"{dims[0]}x{dims[1]}x{dims[2]}_transform{suffix.lower()}"


def export_format(view: str) -> str:
    """The format for a view's role where none is given."""
    found = {"volume": ".raw", "composite_volume": ".raw", "iso": ".ply", "composite_iso": ".ply"}.get(view)
    if found is None:
        raise ValueError("slices are not exported as data")
    return found


def check_nodes(nodes: list[tuple[float, ...]]) -> None:
    """Transfer functions: finite, positions and levels from 0 to 1, positions never falling, one node at least."""
    flat = [v for n in nodes for v in n]
    if not nodes or not all(math.isfinite(v) and 0 <= v <= 1 for v in flat) or any(a[0] > b[0] for a, b in zip(nodes, nodes[1:])):
        raise ValueError("bad transfer function")


def check_void_request(ratio: float | None, gray_min: float, gray_max: float, min_volume: float, erosions: int) -> None:
    numbers = [v for v in (ratio, gray_min, gray_max, min_volume) if v is not None]
    if not all(map(math.isfinite, numbers)) or (ratio is not None and not 0 <= ratio <= 1) or gray_min > gray_max or min_volume < 0 or erosions < 0:
        raise ValueError("bad void request")
