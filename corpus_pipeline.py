"""Corpus pipeline: quality filter, exact dedup, SimHash near-dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents. run() writes each result to the shared folder and reads it again.

Defined cases: a null text counts as empty; rows that share a doc_id are one document and stay or
go together; a row without doc_id is never dropped by the dedup stages; an empty table passes
through; further columns pass through unchanged until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cleared, stage
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.near_copies import near_copies
from lodestone.llm.packing import pack, pieces
from lodestone.llm.pii import redact
from lodestone.llm.quality import good_documents


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the doc_ids of dropped; a few of them are broadcast by their measured size."""
    return docs.join(stage(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer keeps, unchanged."""
    return good_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return _without(docs, exact_dedup(docs).where(~F.col("kept")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id: SimHash within three bits or Jaccard of 0.8, five words a shingle."""
    return _without(docs, near_copies(docs, shingle=5).where(F.col("doc_id") != F.col("component_id")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text where there is one."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence of 1024 tokens."""
    return pack(stage(pieces(docs), "pieces"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("simhash", near_stage), ("pii", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None
"""Packing, the classifier and connected components have no SQL; tests use brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they stage on the way is removed, only the result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with cleared(spark, lambda: docs):
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), name)
    return docs
