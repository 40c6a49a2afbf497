"""Lookups of sources that may fail: one for each key, and none for an hour after a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.state import Store, fresh

MISS_MINUTES = 60


def to_ask(asked: DataFrame, failures: DataFrame | None, as_of: Column, key: str = "key", known: DataFrame | None = None) -> DataFrame:
    """The keys of asked, each once, that are not known and have not failed within the hour."""
    keys = asked.select(key).where(F.col(key).isNotNull()).distinct()
    for table in (known, None if failures is None else failures.where(fresh("at", as_of, minutes=MISS_MINUTES) & (F.col("at").cast("timestamp") <= as_of))):
        if table is not None:
            keys = keys.join(table.select(key).distinct(), key, "left_anti")
    return keys


class Misses:
    """Failed lookups of a Store, by key; an answer takes its key out."""

    def __init__(self, store: Store, name: str = "misses"):
        self.store, self.name = store, name

    def table(self) -> DataFrame | None:
        """The last outcome of each key, if it was a failure: (key, at)."""
        now = self.store.read(self.name)
        if now is None:
            return None
        last = now.groupBy("key").agg(F.max_by("failed", F.struct("at", "failed")).alias("failed"), F.max("at").alias("at"))
        return last.where("failed").select("key", "at")

    def record(self, outcomes: DataFrame, batch: str | None = None) -> None:
        """Adds outcomes (key, at, failed)."""
        self.store.append_keyed(self.name, outcomes.select("key", "at", "failed"), "key", batch)

    def ask(self, asked: DataFrame, as_of: Column, known: DataFrame | None = None) -> DataFrame:
        return to_ask(asked, self.table(), as_of, "key", known)

    def prune(self, as_of: Column) -> None:
        """Failures that count no more go."""
        self.store.compact(self.name, lambda df: df.where(fresh("at", as_of, minutes=MISS_MINUTES)))
