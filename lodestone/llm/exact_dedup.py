"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

A batch is reduced to one row per digest, joined by sort-merge with the index, whose buckets are read
in place, and what the anti-join leaves is appended. Only digests move: texts stay where they are
read. Rows learn what stays from the few digests that occur more than once, so a digest that a third
of all rows share is one row on that side, and adaptive execution splits the other.

Defined cases: a null text counts as empty; repeated rows of one doc_id count in the group's size
and share their flags; a row without doc_id stays only if no row of its text has one; an empty batch
leaves the index unchanged; a batch that is added again finds its digests and adds none; other
columns are never touched.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, release, shared_dir, stage, text_of

DIGESTS_PER_BUCKET = 4_000_000


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text_of(docs, text), 256)).alias("digest"))


class DigestIndex:
    """Digest table `name` of the session's catalog: digest, keep_id. Its files lie in the shared folder.

    The number of buckets is fixed when the table is made: by `buckets`, else by the first batch, but
    not below the session's shuffle partitions; who expects many more batches gives it.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    @property
    def path(self) -> str:
        return f"{shared_dir(self.spark)}/digest-index/{self.name}"

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

    def entries(self) -> DataFrame:
        """All rows of the index; joins on digest read its buckets without a shuffle."""
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> DataFrame:
        """Appends what is new of rows (doc_id, digest); gives the batch's digests with keep_id and n."""
        groups = stage(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "digest-groups")
        first = not self.exists()
        if self.buckets is None:
            self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups.count() / DIGESTS_PER_BUCKET))
        new = groups if first else groups.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")
        writer = new.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        writer.mode("errorifexists" if first else "append").format("parquet").option("path", self.path).saveAsTable(self.name)
        return groups

    def told(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """rows with the keep_id of the index and the group_size n of groups (digest, n)."""
        known = groups.select("digest", "n").hint("merge").join(self.entries(), "digest").select("digest", F.col("keep_id").alias("keeper"), F.col("n").alias("size"))
        out = rows.join(known, "digest", "left")
        keep, size = F.coalesce("keeper", "doc_id"), F.coalesce("size", F.lit(1)).cast("long")
        return out.select("doc_id", "digest", keep.alias("keep_id"), size.alias("group_size"), F.coalesce(keep == F.col("doc_id"), keep.isNull()).alias("kept"))

    def append(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Adds a batch and says per row which row stays.

        Rows: doc_id, digest, keep_id, group_size, kept. In the batch the largest doc_id of equal
        texts stays; where an earlier batch had the text, its row stays. group_size counts the rows
        of this batch.
        """
        rows = stage(digests(docs, doc_id, text), "digests")
        return self.told(rows, self.add(rows))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """All documents against an index of their own: doc_id, digest, keep_id, group_size, kept.

    They arrive in batches of falling doc_id, so the row that an earlier batch brought, which stays,
    is the one with the largest doc_id.
    """
    rows = stage(digests(docs, doc_id, text), "digests")
    cuts = rows.agg(F.percentile_approx("doc_id", [1 - k / batches for k in range(1, batches)], 1000)).first()[0] or []
    parts, above = [], None
    for cut in sorted(set(cuts), reverse=True):
        parts.append(rows.where((F.col("doc_id") >= cut) if above is None else (F.col("doc_id") >= cut) & (F.col("doc_id") < above)))
        above = cut
    parts.append(rows if above is None else rows.where(F.coalesce(F.col("doc_id") < above, F.lit(True))))
    index = DigestIndex(docs.sparkSession, f"lodestone_digest_{uuid.uuid4().hex}")
    try:
        groups = [index.add(part) for part in parts]
        repeated = reduce(DataFrame.union, groups).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
        out = stage(index.told(rows, repeated), "exact")
    finally:
        index.drop()
    release(rows, *groups)
    return out


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
