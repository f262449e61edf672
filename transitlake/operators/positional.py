"""Positional numbering without a single-task window.

``row_number().over(Window.partitionBy(k).orderBy(...))`` sorts each whole
group inside one task; a hot group (or a global order with no partition key)
then becomes one task. ``with_position`` numbers rows the way zipWithIndex
does, but on DataFrames: range-partition on (group, order) so even one hot
group is split across many sorted partitions, read each row's rank inside
its partition from ``monotonically_increasing_id`` (the low 33 bits are the
record number within the partition), and add the number of earlier rows of
the same group held by earlier partitions (a tiny table: partitions × groups
touched). The sorted frame is written once (to the shared checkpoint folder) so both
passes see the same partition boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.session import stored

_LOW33 = (1 << 33) - 1


_TARGET_BYTES = 128 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the plan's leaves (files, tables) by Spark's own statistics; 0 for what has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def with_position(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "pos",
                  num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position of each row within its group (all rows when
    ``group_cols`` is empty), following ``order_cols`` (make them a total
    order for repeatable positions). The number of range partitions follows the input's size."""
    spark = df.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // _TARGET_BYTES))
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    mid = F.monotonically_increasing_id()
    ranked = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.shiftright(mid, 33))
              .withColumn("_local", mid.bitwiseAND(F.lit(_LOW33))))
    ranked = stored(ranked, "positions")
    g = group_cols
    span = ranked.groupBy(*g, "_pid").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = span.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (ranked.join(offsets.select(*g, "_pid", "_first", "_before"), [*g, "_pid"])
            .withColumn(name, F.col("_before") + F.col("_local") - F.col("_first"))
            .drop("_pid", "_local", "_first", "_before"))
