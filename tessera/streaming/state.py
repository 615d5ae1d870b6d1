"""The state operators on streams, with Spark's keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_edges(events: DataFrame, key: str, order: str, active: str) -> DataFrame:
    """(key, order, level) where the sum of +1 and -1 steps of a key leaves or reaches zero; state is one number a key.

    Within a micro-batch rows count by `order`; rows of later batches count after them.
    """

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(order)
        after = level + rows[active].cumsum()
        before = after - rows[active]
        hit = (after == 0) != (before == 0)
        state.update((int(after.iloc[-1]),))
        yield pd.DataFrame({key: name[0], order: rows[order][hit], "level": after[hit]})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, level long"
    return events.select(key, order, F.col(active).cast("long").alias(active)).groupBy(key).applyInPandasWithState(run, out, "level long", "append", GroupStateTimeout.NoTimeout)


def stream_flags(events: DataFrame, key: str, time: str, flag: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, key, flags): flags of a key joined by `or` in windows of event time; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), key).agg(F.bit_or(flag).alias("flags"))
