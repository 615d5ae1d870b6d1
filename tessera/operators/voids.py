"""The void analysis as a chain: threshold, enclosed voxels, dark candidates, opening, regions, label volume, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import bricks, volume as V
from tessera.storage import cut, small_side


def iso_by_ratio(voxels: DataFrame, ratio: float) -> float:
    """The value at `ratio` of the range of valid voxels, in single precision."""
    if not 0 <= ratio <= 1:
        raise ValueError("a ratio lies between 0 and 1")
    masked = voxels if "valid" in voxels.columns else voxels.withColumn("valid", F.lit(True))
    return V.masked_range(masked).select((F.col("lo") + (F.col("hi") - F.col("lo")) * ratio).cast("float")).first()[0]


def candidates(voxels: DataFrame, iso: float, gray_max: float, dims: tuple[int, int, int], erosions: int = 2) -> DataFrame:
    """Enclosed voxels of at most gray_max that opening leaves, with root, the smallest idx of their 6-connected component.

    Components are those of the dark voxels, so a brighter voxel parts two of them. Opening erodes `erosions` times
    and regrows what is left within its component. Voxels at a face are never enclosed, so none survives there.
    """
    dark = V.interior(voxels, iso, dims).where(F.col("value") <= V.single(gray_max))
    return V.opened(V.labelled(cut(dark.drop("root"), "dark")), erosions)


def region_table(cells: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0), min_volume: float = 0) -> DataFrame:
    """V.regions() with the extent of each region along the axes, in length units."""
    found = V.regions(cells, spacing, origin, min_volume)
    return found.withColumns({f"extent_{c}": (F.col(f"max_{c}") - F.col(f"min_{c}") + 1) * float(s) for c, s in zip("xyz", spacing, strict=True)})


def labels(voxels: DataFrame, cells: DataFrame, regions: DataFrame) -> DataFrame:
    """voxels with label: the id of their region, and 0 elsewhere, in dropped regions, too."""
    known = small_side(cut(regions.select("root", "id"), "region-ids"), 24)
    ids = cells.select("idx", "root").join(known, "root").select("idx", "id")
    return voxels.join(ids, "idx", "left").withColumn("label", F.coalesce("id", F.lit(0))).drop("id")


def statistics(labelled: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(object_voxels, void_voxels, object_volume, void_volume, porosity) of voxels with label.

    Raises an error on a negative label, a labelled voxel that is invalid, or a voxel without a volume.
    """
    size = float(spacing[0] * spacing[1] * spacing[2])
    if not 0 < size < float("inf"):
        raise ValueError("a voxel must have a volume")
    good = V.valid_of(labelled)
    bad = F.count_if((F.col("label") < 0) | (F.col("label") > 0) & ~good)
    counts = labelled.agg(F.count_if(good).alias("whole"), F.count_if(F.col("label") > 0).alias("void"), bad.alias("bad"))
    checked = F.when(F.col("bad") > 0, F.raise_error(F.lit("labels don't fit the mask")).cast("long")).otherwise(F.col("void"))
    counts = counts.withColumn("void", checked)
    void, solid = F.col("void"), F.col("whole") - F.col("void")
    ratio = F.when(F.col("whole") > 0, void / F.col("whole")).otherwise(0.0)
    return counts.select(solid.alias("object_voxels"), void.alias("void_voxels"), (solid * size).alias("object_volume"), (void * size).alias("void_volume"), ratio.alias("porosity"))


def void_mesh(labelled: DataFrame, spacing: tuple[float, float, float] = (1, 1, 1), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """Triangles around all regions of voxels with label: the surface between labels and 0, whatever the mask."""
    marked = labelled.select("x", "y", "z", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("value"))
    return bricks.iso_surface(marked, 0.5, spacing, origin)
