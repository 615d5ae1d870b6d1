"""State as tables: change events, interaction edges, flag coalescing, latest versions, crop histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def changes(events: DataFrame, keys: list[str], order: list[str], value: str, eps: float = 1e-6) -> DataFrame:
    """Rows whose value differs from the one before by more than eps; the first of each key counts as a change."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.abs(F.col(value) - F.col("before")) > eps)).drop("before")


def edges(events: DataFrame, keys: list[str], order: list[str], active: str) -> DataFrame:
    """Rows where the sum of +1 and -1 steps in `active` leaves or reaches zero."""
    own = Window.partitionBy(*keys).orderBy(*order)
    now = events.withColumn("level", F.sum(active).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return now.withColumn("was", F.col("level") - F.col(active)).where("(level = 0) != (was = 0)").drop("was")


def coalesced(events: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.bit_or(flag).alias("flags"))


def latest(rows: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """The row of each key with the highest version, as an aggregate; late rows with lower versions drop out."""
    best = F.max(F.struct(version, *fields)).alias("best")
    return rows.groupBy(key).agg(best).select(key, "best.*")
