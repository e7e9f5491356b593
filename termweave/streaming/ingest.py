"""Documents that arrive as a stream: written as versions of shards, and summed by group and time as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.metrics import Stack


def append_shards(stream: DataFrame, root: str, dataset: str, checkpoint: str, prefix: str = "part", **trigger) -> StreamingQuery:
    """Each micro-batch becomes one shard, whose name holds the batch's number: a batch that runs again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{dataset}/{prefix}{number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def time_stats(stream: DataFrame, time: str, width: str, late: str, group: Column, stack: Stack) -> DataFrame:
    """(start, grp, s0 ...): sums of the metrics by group and tumbling window. What is later than ``late`` isn't counted."""
    metrics: Sequence[Column] = stack.metrics
    rows = stream.withWatermark(time, late).select(time, group.cast("int").alias("grp"), *(m.alias(f"s{i}") for i, m in enumerate(metrics))).where("grp <> 0")
    sums = rows.groupBy(F.window(time, width).alias("w"), "grp").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(metrics))))
    return sums.select(F.col("w.start").alias("start"), "grp", *(f"s{i}" for i in range(len(metrics))))
