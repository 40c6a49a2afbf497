"""Line dedup: lines whose key is common to many documents stay in one of them.

Long lines become 128-bit hashes. Per hash and salt the documents are counted before anything is
gathered, so a line that a third of all documents share is at most one row a salt. These rows are
range-partitioned by hash with a secondary sort by document and position, and streamed: a window
that runs over the sorted partition, without another exchange or sort, counts the documents of a
hash and takes its first row, which is the line's place in the document that keeps it. The answer is
one keep bitmap per document, 64 lines a word, of which words that keep all are left out; texts are
only joined to it by who wants the new text. DataFrame functions only.

Defined cases: a null or empty text is one empty line; a document is a doc_id, so repeated rows of
one doc_id count once; rows that share a doc_id but not the text get bitmaps of their own; an empty
table gives an empty result; further columns pass through apply_bitmaps unchanged, those with the
names of its results as `<name>_input`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, make_room, release, stage, text_of

BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, salts: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row_key, words) of the documents that lose lines; words: (word, keep), a set bit is a line that stays."""
    body = text_of(docs, text)
    keys = F.transform(_lines(body), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashes = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(ascii_lower(k)))))
    lines = docs.select(F.col(doc_id).alias("doc_id"), _row_key(body).alias("row_key"), F.posexplode(hashes).alias("pos", "hash")).where("hash IS NOT NULL")
    lines = stage(lines, "lines")

    # a salt holds all rows of its documents, so documents are counted exactly within it
    salted = lines.select("hash", "doc_id", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).repartition("hash", "salt")
    once = salted.groupBy("hash", "salt", "doc_id").agg(F.min("pos").alias("pos"))
    part = once.groupBy("hash", "salt").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", (-F.col("pos")).alias("back"))).alias("last"))
    part = part.select("hash", "n", F.col("last.doc_id").alias("holder"), (-F.col("last.back")).alias("pos"))
    ordered = part.repartitionByRange("hash").sortWithinPartitions("hash", F.desc("holder"), "pos")
    by_hash = Window.partitionBy("hash").orderBy(F.desc("holder"), "pos")
    streamed = ordered.select("hash", "holder", F.row_number().over(by_hash).alias("place"), F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("docs"))
    common = stage(streamed.where((F.col("place") == 1) & (F.col("docs") >= min_docs)).select("hash", "holder"), "common")

    lost = lines.join(common, "hash").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    word = lost.groupBy("doc_id", "row_key", F.expr("pos div 64").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("keep"))
    out = stage(word.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("word", "keep"))).alias("words")), "bitmaps")
    release(lines, common)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    docs = make_room(docs, "n_lines", "n_dropped", "kept_text")
    body = text_of(docs, text)
    maps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.map_from_entries("words").alias("__words"))
    both = docs.join(maps, docs[doc_id].eqNullSafe(maps["__id"]) & (_row_key(body) == maps["__key"]), "left")
    lines = _lines(body)

    def stays(i: Column) -> Column:
        keep = F.coalesce(F.try_element_at("__words", F.expr("0L") + F.floor(i / 64)), F.lit(-1).cast("long"))
        return keep.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) != 0

    kept = F.when(F.col("__words").isNull(), body).otherwise(F.array_join(F.filter(lines, lambda _, i: stays(i)), "\n"))
    lost = F.coalesce(F.aggregate(F.map_values("__words"), F.lit(0).cast("long"), lambda a, b: a + 64 - F.bit_count(b)), F.lit(0).cast("long"))
    out = both.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": lost, "kept_text": kept})
    return out.drop("__id", "__key", "__words")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, line_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.holder AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
