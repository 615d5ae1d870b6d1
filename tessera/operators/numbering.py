"""Numbers without gaps over rows in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.storage import cut


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with `number` from 0 on without gaps, in the order of `by`: places within partitions, and the partitions' totals before."""
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    table = cut(placed, name)
    part = F.shiftright("place", 33).alias("part")
    totals = table.groupBy(part).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    base, bases = 0, []
    for r in totals:
        bases.append((r.part, base))
        base += r.n
    start = rows.sparkSession.createDataFrame(bases, "part long, base long")
    joined = table.withColumn("part", part).join(F.broadcast(start), "part")
    return joined.withColumn("number", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "base", "place")
