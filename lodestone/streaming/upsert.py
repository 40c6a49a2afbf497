"""Incremental merging of observations and time-limited dedup of repeated searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import identity
from lodestone.operators.resolution import PaperStore
from lodestone.operators.state import Store, current


BUCKETS = 64


def upsert(store: Store, batch: DataFrame, batch_id: str | None = None, name: str = "observations", merged: str = "papers") -> None:
    """Adds a batch of observations and the merged rows of the refs it touches.

    Nothing that is stored is written again: observations are appended by bucket of their ref, the
    refs of the batch are merged from the touched buckets alone, and their new rows supersede the old
    ones by a higher version. A batch whose id is known changes nothing, so a replay is harmless, also
    one that broke between the two appends.
    """
    if batch_id is not None and store.has(merged, batch_id):
        return
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64("ref"), F.lit(BUCKETS)).cast("int"))
    store.append(name, rows, batch_id, partition="bucket")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
    seen = store.read(name).where(F.col("bucket").isin(touched)).join(batch.select("ref").distinct(), "ref", "left_semi")
    version = F.lit(store.next_version(merged)).cast("long")
    store.append(merged, identity.merge_observations(seen).withColumn("version", version), batch_id)


def merged_papers(store: Store, merged: str = "papers") -> DataFrame | None:
    """The newest row of each ref."""
    rows = store.read(merged)
    return None if rows is None else current(rows, "ref")


def compact(store: Store, name: str = "observations", merged: str = "papers") -> None:
    """New bases of both tables; superseded papers go."""
    store.compact(name)
    store.compact(merged, lambda df: current(df, "ref"))


def run_upserts(stream: DataFrame, store: Store, checkpoint: str, query: str = "upserts") -> StreamingQuery:
    """Each micro-batch becomes a batch of the store, named by the query and its number."""
    return stream.writeStream.foreachBatch(lambda batch, n: upsert(store, batch, f"{query}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_resolution(stream: DataFrame, papers: PaperStore, checkpoint: str, query: str = "resolution") -> StreamingQuery:
    """Each micro-batch of observations (seq, ref, ...) is resolved by identity against the stored papers; a replayed one changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, n: papers.upsert(batch, f"{query}-{n}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_searches(stream: DataFrame, ts: str = "ts", key: str = "cache_key", minutes: int = 10) -> DataFrame:
    """A search of a key at most once within the minutes; state older than that is dropped."""
    return stream.withWatermark(ts, f"{minutes} minutes").dropDuplicatesWithinWatermark([key])
