"""Titles in marks within a text, and their links to papers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.cluster import ship
from lodestone.functions import text as tx

# The marks around a title.
OPEN, CLOSE = "《", "》"
MAX_BYTES, MAX_TITLES = 512 << 10, 100


def reference_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, title) of outermost marked titles; code and existing links are skipped."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == "`":
            ticks = 1
            while i + ticks < n and text[i + ticks] == "`":
                ticks += 1
            end = text.find("`" * ticks, i + ticks)
            i = end + ticks if end >= 0 else i + ticks
        elif c == "[" and (close := text.find("](", i)) >= 0 and (end := text.find(")", close + 2)) >= 0:
            i = end + 1
        elif c == OPEN:
            start, depth = i, 0
            while i < n:
                depth += (text[i] == OPEN) - (text[i] == CLOSE)
                i += 1
                if depth == 0:
                    out.append((start, i, text[start + 1 : i - 1]))
                    break
        else:
            i += 1
    return out


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, span, start, end, title); texts without a mark never leave the JVM."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, k, a, b, t) for n, x in enumerate(batch.column(1)) for k, (a, b, t) in enumerate(reference_spans(x.as_py()))]
            at, *more = zip(*rows, strict=True) if rows else [()] * 5
            cols = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(more, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "span", "start", "end", "title"])

    ship(docs.sparkSession)
    marked = docs.where(F.contains(F.col(text), F.lit(OPEN))).select(doc_id, text)
    return marked.mapInArrow(run, f"doc_id {kind}, span long, start long, end long, title string")


def flat_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, title) of titles without inner marks, by a pattern alone."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{OPEN}([^{OPEN}{CLOSE}]*){CLOSE}"), F.lit(1))).alias("title"))


def link(found: DataFrame, papers: DataFrame) -> DataFrame:
    """found (doc_id, span, title) with status, url and number of matches.

    Papers are counted per title before the join, so a title that many papers share gives one row.
    """
    per_key = papers.groupBy(tx.title_key("title").alias("key")).agg(F.count(F.lit(1)).alias("matches"), F.min("ref").alias("ref"), F.max(F.coalesce("url", F.lit(""))).alias("url"))
    out = found.withColumn("key", tx.title_key("title")).join(per_key, "key", "left").drop("key")
    one = F.col("matches") == 1
    status = F.when(F.col("matches").isNull(), "unresolved").when(~one, "ambiguous").when(F.col("url") == "", "matched_without_link").otherwise("linked")
    return out.withColumns({"status": status, "matches": F.coalesce("matches", F.lit(0)), "ref": F.when(one, F.col("ref")), "url": F.when(one & (F.col("url") != ""), F.col("url"))})


def rendered(docs: DataFrame, linked: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with Markdown links in place of linked titles."""
    per_doc = linked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "status", "url"))).alias("marks"))
    body = F.col("body")

    def step(acc, x):
        raw = F.substr(body, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))
        safe = F.replace(F.replace(x["url"], F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
        shown = F.when(x["status"] == "linked", F.concat(F.lit("["), tx.markdown_text(raw), F.lit("]("), safe, F.lit(")"))).otherwise(raw)
        between = F.substr(body, acc["at"] + 1, x["start"].cast("int") - acc["at"])
        return F.struct(x["end"].cast("int").alias("at"), F.concat(acc["out"], between, shown).alias("out"))

    both = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).join(per_doc, "doc_id", "left")
    new = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)))
    return both.select("doc_id", F.when(F.col("marks").isNull(), body).otherwise(new).alias("text"))
