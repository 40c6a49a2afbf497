"""Numbers for all rows of a table in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cluster import written


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with numbers from 1 in order.

    Rows are range-partitioned and sorted, and written with their place in the partition; the counts of
    the partitions before give the rest. Only these counts, one for each partition, meet in a task.
    """
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": part, "__place": place}), "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("__part", before.alias("before")), "offsets")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("before") + F.col("__place") + 1).drop("__part", "__place", "before")
