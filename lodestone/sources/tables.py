"""Views of stored tables as papers, observations and source quality, and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx

# Document types and the code of journals, tiers of sources.
DOC_TYPES = ("期刊", "会议", "博士", "硕士", "报纸", "其他")
TIERS = ("CSSCI", "SCI", "北大核心", "EI")

PAPER = T.StructType([
    T.StructField("ref", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("doc_type", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("cited", T.LongType()),
    T.StructField("doi", T.StringType()), T.StructField("url", T.StringType()), T.StructField("volume", T.StringType()),
    T.StructField("issue", T.StringType()), T.StructField("pages", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers; what they lack follows from doc_id by fixed rules."""
    i = F.col("doc_id")
    body = F.coalesce("text", F.lit(""))
    df = table(spark, sf_dir, "documents").select("doc_id", F.substring_index(body, "\n", 1).alias("title"), body.alias("body"), "source", "n_chars")
    df = df.withColumn("abstract", F.substr("body", F.char_length("title") + 2, F.lit(400))).drop("body")
    words = F.filter(tx.latin_tokens(F.concat_ws(" ", "title", "abstract")), lambda x: F.char_length(x) >= 6)
    kind = F.element_at(F.array(*map(F.lit, DOC_TYPES)), (i % 6 + 1).cast("int"))
    return df.select(
        "doc_id", tx.record_ref(tx.native_key(F.lit("DOC"), i.cast("string"))).alias("ref"), "title", "abstract", "source", F.slice(words, 1, 5).alias("keywords"),
        F.array(F.concat(F.lit("Author "), i % 97), F.concat(F.lit("Author "), i % 89)).alias("authors"),
        F.when(i % 17 == 0, 0).otherwise(2015 + i % 11).cast("int").alias("year"), kind.alias("doc_type"),
        F.when(i % 13 == 0, None).otherwise(F.col("n_chars") % 50).alias("cited"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("10.1000/"), i)).alias("doi"), F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("https://example.org/abstract/"), i)).alias("url"),
        (i % 30 + 1).cast("string").alias("volume"), F.when(i % 4 == 0, "").otherwise((i % 6 + 1).cast("string")).alias("issue"), F.concat_ws("-", i % 100 + 1, i % 100 + 9).alias("pages"),
    )


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per source: tiers, composite impact, state."""
    n = F.regexp_extract("source", "([0-9]+)", 1).try_cast("int")
    df = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", F.coalesce(n, F.lit(4)))
    # element_at is not reached where there is no tier
    tier = F.when(F.col("n") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.element_at(F.array(*map(F.lit, (*TIERS, ""))), F.col("n") % 5 + 1)))
    return df.select(
        tx.source_key("source").alias("source_key"), tier.alias("tiers"), F.when(F.col("n") % 7 == 0, None).otherwise(F.col("n") * 0.3).cast("double").alias("composite"),
        F.when(F.col("n") % 5 == 4, "unknown").otherwise("present").alias("state"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings (seq 1), details of even doc_ids (seq 2) and late listings of every third (seq 3)."""
    p = papers(spark, sf_dir).select("doc_id", "ref", "title", "authors", "source", "year", "abstract", "cited", "doi")
    seq = F.explode(F.filter(F.array(F.lit(1), F.when(F.col("doc_id") % 2 == 0, 2), F.when(F.col("doc_id") % 3 == 0, 3)), lambda x: x.isNotNull()))
    o = p.withColumn("seq", seq)
    return o.select(
        "ref", "seq", (F.col("seq") == 2).alias("is_detail"), F.when(F.col("seq") == 3, F.concat("title", F.lit(" (late)"))).otherwise(F.col("title")).alias("title"), "authors", "source",
        F.when(F.col("seq") == 3, F.col("year") + 1).otherwise(F.col("year")).alias("year"), F.when(F.col("seq") == 2, F.col("abstract")).otherwise("").alias("abstract"),
        F.when(F.col("seq") == 1, None).otherwise(F.col("cited") + F.col("seq")).alias("cited"), "doi",
    )
