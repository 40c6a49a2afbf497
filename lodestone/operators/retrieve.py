"""Channel scans, positions, rounds and coverage."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.expression import QueryError, predicate, printed, validate
from lodestone.plans.planner import Channel

PAGE = 50


def year_between(low: int = 0, high: int = 0) -> Column:
    """An unknown year fails any bound."""
    if not low and not high:
        return F.lit(True)
    ok = F.col("year") > 0
    if low:
        ok = ok & (F.col("year") >= low)
    return ok & (F.col("year") <= high) if high else ok


def order_key(sort: str, terms: list[str]) -> Column:
    """What a channel is ordered by, the largest first; ties by ref."""
    if sort == "date":
        return F.col("year").cast("double")
    if sort == "citations":
        return F.coalesce("cited", F.lit(-1)).cast("double")
    return tx.dice(F.array_distinct(tx.tokens(F.lit(" ".join(terms)))), tx.tokens("title"))


def _matches(papers: DataFrame, channels: list[Channel], key: Column, *more: str) -> DataFrame:
    """(channel, weight, key, ref, year) of all channels by one pass over papers; only what some channel matches is exploded."""
    for c in channels:
        validate(c.expression)
    flags = F.array(*[F.when(predicate(c.expression), F.struct(F.lit(c.id).alias("channel"), F.lit(float(c.weight)).alias("weight"))) for c in channels])
    some = papers.withColumn("__in", F.filter(flags, lambda x: x.isNotNull())).where(F.size("__in") > 0)
    return some.select("ref", "year", key.alias("key"), F.explode("__in").alias("c"), *more).select("c.channel", "c.weight", "key", "ref", "year", *more)


def scan_all(papers: DataFrame, channels: list[Channel], terms: list[str], sort: str = "relevance", max_pages: int = 5) -> DataFrame:
    """First max_pages pages of each channel with raw positions: (channel, weight, position, page, ref, year).

    papers is read once, whatever the number of channels. The bound on positions holds in each task
    before anything is shuffled, so a channel's rows that meet are bounded by its pages and the tasks.
    """
    order = Window.partitionBy("channel").orderBy(F.desc("key"), F.asc("ref"))
    rows = _matches(papers, channels, order_key(sort, terms)).withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_pages * PAGE)
    return rows.select("channel", "weight", F.col("position").cast("long").alias("position"), F.ceil(F.col("position") / PAGE).alias("page"), "ref", "year")


def scan(papers: DataFrame, channel: Channel, terms: list[str], sort: str = "relevance", max_pages: int = 5) -> DataFrame:
    """The same of one channel."""
    return scan_all(papers, [channel], terms, sort, max_pages)


def totals(papers: DataFrame, channels: list[Channel]) -> DataFrame:
    """(channel, total): how many papers each channel matches; one pass."""
    sums = papers.agg(*[F.count_if(predicate(c.expression)).alias(c.id) for c in channels])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c.id).alias("channel"), F.col(c.id).alias("total")) for c in channels])).alias("t")).select("t.*")


@dataclass(frozen=True)
class GridPage:
    """A page of a channel; the cursor leads to the next one and is empty behind the last."""

    rows: DataFrame
    total: int
    page: int
    last_page: int
    exhausted: bool
    cursor: str


def fingerprint(channel: Channel, sort: str, year_from: int = 0, year_to: int = 0) -> str:
    return hashlib.sha256(json.dumps([printed(channel.expression), sort, year_from, year_to]).encode()).hexdigest()


def grid_page(papers: DataFrame, channel: Channel, terms: list[str], sort: str = "relevance", page: int = 1, cursor: str = "", size: int = PAGE, year_from: int = 0, year_to: int = 0) -> GridPage:
    """A page of a channel: rows (position, ref, year), total, last page, whether it is the last, and a cursor.

    A cursor holds the last row's order and ref, so the next page is a range of rows and not a count of
    them; it holds for its channel, sort and years only. Without one, a later page counts from the start.
    """
    mark = fingerprint(channel, sort, year_from, year_to)
    found = _matches(papers, [channel], order_key(sort, terms), *[c for c in ("title",) if c in papers.columns]).where(year_between(year_from, year_to))
    total = found.count()
    skip = (page - 1) * size
    if cursor:
        at = json.loads(cursor)
        if at["of"] != mark:
            raise QueryError("INVALID_CURSOR", "it belongs to another search")
        page, skip = at["page"] + 1, 0
        found = found.where((F.col("key") < at["key"]) | ((F.col("key") == at["key"]) & (F.col("ref") > at["ref"])))
    elif page < 1:
        raise QueryError("INVALID_OPTION", "page")
    rows = found.orderBy(F.desc("key"), "ref").offset(skip).limit(size)
    kept = rows.collect()  # a page
    spark, last_page = papers.sparkSession, -(-total // size)
    schema = "position long, ref string, year int"
    out = spark.createDataFrame([((page - 1) * size + i + 1, r["ref"], r["year"]) for i, r in enumerate(kept)], schema)
    exhausted = page >= last_page
    after = "" if exhausted or not kept else json.dumps({"of": mark, "page": page, "key": kept[-1]["key"], "ref": kept[-1]["ref"]})
    return GridPage(out, total, page, last_page, exhausted, after)


def hits(scanned: DataFrame, year_from: int = 0, year_to: int = 0) -> DataFrame:
    """First hit per ref and channel; positions were counted before the year filter."""
    kept = scanned.where(year_between(year_from, year_to))
    return kept.groupBy("ref", "channel").agg(F.min("position").alias("position"), F.min_by("weight", "position").alias("weight"))


def coverage(scanned: DataFrame) -> DataFrame:
    """Pages and rows read per channel."""
    return scanned.groupBy("channel").agg(F.max("page").cast("long").alias("pages"), F.count(F.lit(1)).alias("rows"))


def full_coverage(scanned: DataFrame, of_channel: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The same for all channels of totals(), with total, whether all of it was read, and the error of a channel that failed (channel, error)."""
    out = of_channel.join(coverage(scanned), "channel", "left").select("channel", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("rows", F.lit(0)).alias("rows"), "total")
    errors = failed if failed is not None else scanned.sparkSession.createDataFrame([], "channel string, error string")
    return out.join(errors, "channel", "left").select("channel", "pages", "rows", "total", (F.col("error").isNull() & (F.col("rows") >= F.col("total"))).alias("exhausted"), "error")


def rounds(scanned: DataFrame) -> DataFrame:
    """Distinct refs known after each round of pages."""
    first = scanned.groupBy("ref").agg(F.min("page").alias("round"))
    per_round = first.groupBy("round").agg(F.count(F.lit(1)).alias("new"))  # a row per round, bounded by max_pages
    known = F.sum("new").over(Window.partitionBy(F.lit(0)).orderBy("round"))
    return per_round.select(F.col("round").cast("long").alias("round"), "new", known.cast("long").alias("known"))


def until_target(scanned: DataFrame, target: int) -> DataFrame:
    """Rows of the rounds up to the first that knows `target` refs."""
    table = rounds(scanned)
    last = table.agg(F.coalesce(F.min(F.when(F.col("known") >= target, F.col("round"))), F.max("round")).alias("last"))
    return scanned.join(F.broadcast(last), scanned["page"] <= last["last"]).drop("last")  # one row
