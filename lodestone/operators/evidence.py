"""Writers and readers of what runs leave behind: snapshots, quality of sources, operations, artifacts.

Each is a table of a Store with a key; a row supersedes those of its key that are older. Rows are put in
batches and read by key, so neither writing nor reading touches more than the buckets of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.state import RETENTION_DAYS, Store, fresh, newest

KEYS = {"snapshots": "id", "sources": "key", "operations": "id", "artifacts": "key"}
PENDING_DAYS = 7


class Evidence:
    def __init__(self, store: Store):
        self.store = store

    def put(self, kind: str, rows: DataFrame, batch: str | None = None) -> None:
        """Adds rows (the kind's key, updated, ...); of rows of one key in the batch the newest."""
        key = KEYS[kind]
        self.store.append_keyed(kind, newest(rows.where(F.col(key).isNotNull()), key, "updated"), key, batch)

    def get(self, kind: str, keys: list[str]) -> DataFrame | None:
        """The newest row of each key, by a few keys."""
        found = self.store.lookup(kind, KEYS[kind], keys)
        return None if found is None else newest(found.drop("bucket"), KEYS[kind], "updated")

    def all(self, kind: str) -> DataFrame | None:
        now = self.store.read(kind)
        return None if now is None else newest(now.drop("bucket"), KEYS[kind], "updated")

    def latest_snapshots(self) -> DataFrame | None:
        """The newest snapshot of each paper."""
        now = self.all("snapshots")
        return None if now is None else newest(now, "ref", "updated")

    def pending(self, as_of: Column) -> DataFrame | None:
        """Artifacts (key, incoming) whose transfer was begun within the week and has not ended."""
        now = self.all("artifacts")
        if now is None:
            return None
        begun = (F.col("state") == "clicked") & (F.coalesce("incoming", F.lit("")) != "") & fresh("updated", as_of, days=PENDING_DAYS)
        return now.where(begun).select("key", "incoming")

    def prune(self, as_of: Column) -> None:
        """Drops what is older than its kind is kept, and superseded rows; sources and artifacts stay."""
        for kind, key in KEYS.items():
            if self.store.read(kind) is not None:
                days = RETENTION_DAYS.get(kind)
                keep = (lambda df, days=days: df.where(fresh("updated", as_of, days=days))) if days else (lambda df: df)
                self.store.compact(kind, lambda df, key=key, keep=keep: keep(newest(df, key, "updated")))
