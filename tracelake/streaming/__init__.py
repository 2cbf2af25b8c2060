"""Incremental detection: each micro-batch is merged by key and only the keys that changed are checked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_changes(stream: DataFrame, history: Callable[[], DataFrame], detect: Callable[[DataFrame], DataFrame], keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that, for each batch, runs `detect` on the history of the keys in the batch and hands findings to `sink`."""

    def run(batch: DataFrame, number: int) -> None:
        changed = batch.select(*keys).distinct()
        sink(detect(history().join(changed, keys, "left_semi")), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def windowed_calls(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Calls per user in tumbling windows; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count(F.lit(1)).alias("n"))
