"""Operator 7: contiguous shards of near-equal bytes.

Rows are put in the order of the key by a range exchange of 24-byte rows (the text stays behind) and written once. The
totals of the partitions, a row each, are summed into offsets; within a partition a running sum completes the global
prefix sum. Cuts stand at equal targets: a row goes to the shard in which its middle byte falls, so a shard misses its
target by less than one row's size at either end.

Order: key ascending, nulls first; ties by size, then checksum, whose equal rows are interchangeable. Null text: no bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch


def prefixed(ordered: DataFrame, part: str, order: list, sums: dict[str, str]) -> DataFrame:
    """``ordered`` with, for each ``out: column`` of ``sums``, the sum of the column over all rows before the row.

    ``part`` numbers contiguous runs of the order. Only one row a run meets in the window over totals.
    """
    totals = ordered.groupBy(part).agg(*(F.sum(c).alias(f"_t_{o}") for o, c in sums.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *(F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ordered.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_r_{o}") for o, c in sums.items()))
    out = run.join(F.broadcast(offsets), part)  # a row for each partition of the exchange
    return out.select(*ordered.columns, *((F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums))


def balanced_shards(df: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot (place in the shard, from 0) for every row of ``df``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    light = df.select(F.col(key).alias("_k"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = light.repartitionByRange(n, "_k", "size", "text_crc32").withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1).cast("long"))
    ordered = scratch(light, "shards")
    order = ["_k", "size", "text_crc32"]
    placed = prefixed(ordered, "part", order, {"before": "size", "row": "one"})
    total = ordered.agg(F.sum("size").alias("total"))
    shard = F.least(F.expr(f"((2 * before + size) * {n_shards}) div (2 * total)"), F.lit(n_shards - 1)).cast("int")
    placed = placed.crossJoin(F.broadcast(total)).withColumn("shard", shard)  # one row
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row a shard
    return placed.join(F.broadcast(firsts), "shard").select(F.col("_k").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
