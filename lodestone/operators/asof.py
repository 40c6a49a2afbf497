"""As-of and interval joins that sort and bin instead of comparing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cluster import written


def asof_join(requests: DataFrame, snapshots: DataFrame, key: str, at: str, ts: str, tie: str, max_age_s: int | None = None) -> DataFrame:
    """requests with a column snapshot: the newest of the same key that is not later and not older than max_age_s, or null.

    Both sides go through one sort by key and time over ranges of rows, in which each range looks back on
    its own rows; what the ranges before end with, a row for each range and key, is handed on. So a key
    that many rows share is many tasks. Of snapshots of one time the one with the largest `tie` counts;
    rows without key or time find nothing.
    """
    own = [F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(snapshots.schema[tie].dataType).alias("tie")]
    other = [F.col(key).alias("k"), F.col(ts).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie")]
    r, s = F.struct(*requests.columns).alias("r"), F.struct(*snapshots.columns).alias("s")
    both = requests.select(*own, r).unionByName(snapshots.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(*other, s), allowMissingColumns=True)
    order = ("k", "t", "side", "tie")
    cut = written(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "asof")
    near = cut.withColumn("found", F.last("s", ignorenulls=True).over(Window.partitionBy("part", "k").orderBy("row")))
    ends = cut.groupBy("part", "k").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("row"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    handed = ends.select(F.col("part").alias("of_part"), F.col("k").alias("of_key"), before.alias("before"))
    out = near.where("side = 1").join(handed, (F.col("part") == F.col("of_part")) & F.col("k").eqNullSafe(F.col("of_key")), "left")
    found = F.coalesce("found", "before")
    ok = F.col("k").isNotNull() & F.col("t").isNotNull()
    if max_age_s is not None:
        ok = ok & (F.col("t").cast("timestamp") - found[ts].cast("timestamp") <= F.make_dt_interval(secs=F.lit(max_age_s)))
    return out.select("r.*", F.when(F.coalesce(ok, F.lit(False)), found).alias("snapshot"))


def overlapping(a: DataFrame, b: DataFrame, key: str, start: tuple[str, str], end: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows (structs a, b) of one key whose half-open intervals share a point.

    Intervals are entered in each bin of `width` that they touch, and rows meet in bins; a pair counts in
    the first bin that both touch. Empty intervals and nulls meet nothing.
    """

    def binned(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        some = df.where(F.col(low) < F.col(high))
        bins = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
        return some.select(F.col(key).alias("k"), F.struct(*df.columns).alias(name), F.explode(bins).alias("bin"))

    x, y = binned(a, start[0], end[0], "a"), binned(b, start[1], end[1], "b")
    low = F.greatest(F.col(f"a.{start[0]}"), F.col(f"b.{start[1]}"))
    met: Column = (low < F.least(F.col(f"a.{end[0]}"), F.col(f"b.{end[1]}"))) & (F.col("bin") == F.floor(low / width))
    return x.join(y, ["k", "bin"]).where(met).select("a", "b")
