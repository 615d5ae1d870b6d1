"""Connected components by alternating star contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.storage import cut, drop, small_side


def _flat(edges: DataFrame) -> bool:
    """Whether edges(u, v), distinct and u above v, are stars: no node begins two of them, or begins one and ends another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    most = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.max("n")).first()[0]
    return most is None or most < 2


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst), orderable and not null: returns (node, component), the component's smallest node.

    Only nodes with an edge are returned. Each round joins every edge to its node's smallest neighbour
    (large star, then small star) and writes the contracted edges to the shared folder; the number of
    rounds grows with the logarithm of the longest chain, and edges that are stars take none. No edge list is ever
    gathered in one place.
    """
    now = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = cut(now, "edges")
    while not _flat(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(parent.select("u", "m"))
        after = cut(small.where("u != v").distinct(), "edges")
        drop(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known(node, component), as by connected_components(), after further edges(src, dst): again (node, component).

    The edges are moved to the components of their ends first, so only components that they connect are gone through.
    """
    roots = {c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")) for c in ("src", "dst")}
    moved = edges.select("src", "dst").join(roots["src"], "src", "left").join(roots["dst"], "dst", "left")
    met = connected_components(moved.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst")))
    least = small_side(met.select(F.col("node").alias("component"), F.col("component").alias("least")), 24)
    kept = known.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return kept.union(met.join(known.select("node"), "node", "left_anti").select("node", "component"))
