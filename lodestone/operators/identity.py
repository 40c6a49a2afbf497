"""Identity keys, verified matches and merging of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.cluster import written
from lodestone.functions import text as tx


def identity_keys() -> Column:
    """Native, DOI and bibliography keys that a paper has; missing columns count as empty."""
    parts = {"native": "native_key", "doi": "doi_key", "bib": "bib_key"}
    return F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{k}:"), F.col(c))) for k, c in parts.items()]), lambda x: x.isNotNull())


def with_keys(papers: DataFrame) -> DataFrame:
    """papers (title, authors, source, year, doi, dbname, filename) with their keys.

    The title's key is a column of its own first, as the bibliography names it more than once.
    """
    return papers.withColumn("__title_key", tx.title_key("title")).withColumns({
        "native_key": tx.native_key("dbname", "filename"), "doi_key": tx.doi_key(F.coalesce("doi", F.lit(""))),
        "bib_key": tx.bibliography_key("title", "authors", "source", "year", F.col("__title_key")),
    }).drop("__title_key")


def _c(side: str, name: str) -> Column:
    return F.coalesce(F.col(f"{side}.{name}"), F.lit(""))


def conflicting(a: str, b: str) -> Column:
    """Both sides have an identifier and they differ."""

    def differ(name: str, f=lambda c: c) -> Column:
        x, y = _c(a, name), _c(b, name)
        return (x != "") & (y != "") & (f(x) != f(y))

    return differ("doi_key") | differ("native_key") | differ("dbcode", F.lower)


def same_paper(a: str, b: str) -> Column:
    """No conflict, and DOIs, native keys or full bibliographies agree; a title never suffices."""

    def both(name: str) -> Column:
        return (_c(a, name) != "") & (_c(b, name) != "")

    return ~conflicting(a, b) & (both("doi_key") | both("native_key") | (both("bib_key") & (_c(a, "bib_key") == _c(b, "bib_key"))))


def detail_matches(a: str, b: str) -> Column:
    """No conflict and equal titles; first authors and sources equal where both are known."""

    def first(side: str) -> Column:
        return tx.normalize(F.coalesce(F.try_element_at(F.col(f"{side}.authors"), F.lit(1)), F.lit("")))

    authors = (first(a) == "") | (first(b) == "") | (first(a) == first(b))
    source = (_c(a, "source") == "") | (_c(b, "source") == "") | (tx.source_key(f"{a}.source") == tx.source_key(f"{b}.source"))
    return ~conflicting(a, b) & (tx.title_key(f"{a}.title") == tx.title_key(f"{b}.title")) & authors & source


IDS = ("doi_key", "native_key", "dbcode")


def classes(papers: DataFrame) -> DataFrame:
    """papers' refs by class: rows (ref, rep, doi_key, native_key, dbcode, bib_key).

    A class holds what agrees in all identifiers and in the bibliography, so it is compared as one;
    its smallest ref represents it. An aggregate finds that, and refs join it on flat columns.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    slim = papers.select("ref", text("doi_key").alias("doi_key"), text("native_key").alias("native_key"), F.lower(text("dbcode")).alias("dbcode"), text("bib_key").alias("bib_key"))
    keys = (*IDS, "bib_key")
    return slim.join(slim.groupBy(*keys).agg(F.min("ref").alias("rep")), list(keys)).select("ref", "rep", *keys)


def members(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class's representative and its other members; a class without a key links none."""
    known = (F.col("doi_key") != "") | (F.col("native_key") != "") | (F.col("bib_key") != "")
    return found.where(known & (F.col("ref") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("ref").alias("b"))


def class_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives of different classes that are the same paper, all of them.

    Two classes are one paper if they share a key and no identifier that both have differs. Which
    identifiers a class has is one of eight masks; for each pair of masks the common identifiers
    are part of the join key. So the join gives linked pairs only, however many classes share a key,
    and conflicting ones never meet.
    """
    one = found.where("ref = rep").drop("ref").withColumn("mask", sum(F.when(F.col(c) != "", 1 << n).otherwise(0) for n, c in enumerate(IDS)))
    key = F.explode(identity_keys()).alias("key")

    def side(mine: str, theirs: str, name: str) -> DataFrame:
        other = one.select(key, "rep", "mask", *IDS, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("other"))
        both = F.col("mask").bitwiseAND(F.col("other"))
        shared = [F.when(both.bitwiseAND(F.lit(1 << n)) != 0, F.col(c)).otherwise("").alias(c) for n, c in enumerate(IDS)]
        return other.select("key", F.col("mask").alias(mine), F.col("other").alias(theirs), *shared, F.col("rep").alias(name))

    met = side("left", "right", "a").join(side("right", "left", "b"), ["key", "left", "right", *IDS]).where("a < b")
    return met.select("a", "b").distinct()


def same_pairs(papers: DataFrame) -> DataFrame:
    """All verified links: pairs (a, b) of class representatives, and of each with its members (kind)."""
    found = written(classes(papers), "classes")
    return class_pairs(found).withColumn("kind", F.lit("pair")).union(members(found).withColumn("kind", F.lit("member")))


def link_counts(papers: DataFrame) -> DataFrame:
    """(ref, n): with how many others each paper is linked; the sizes of its class and of the classes linked to it."""
    found = written(classes(papers), "classes")
    pairs = class_pairs(found)
    sizes = found.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(sizes, both["b"] == sizes["rep"]).groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("beside"))
    known = (F.col("doi_key") != "") | (F.col("native_key") != "") | (F.col("bib_key") != "")
    n = F.when(known, F.col("size") - 1).otherwise(0) + F.coalesce("beside", F.lit(0))
    return found.join(sizes, "rep").join(beside, "rep", "left").select("ref", n.alias("n")).where("n > 0")


def merge_observations(observations: DataFrame, by: str = "ref") -> DataFrame:
    """One row per ref: the last value that is not empty wins, but once a detail has been seen, listings change no title, authors, source or year.

    Aggregates only, so observations of a busy ref combine on the map side.
    """
    first_detail = observations.where("is_detail").groupBy(by).agg(F.min("seq").alias("first_detail"))
    o = observations.join(first_detail, by, "left")
    open_ = F.col("is_detail") | F.col("first_detail").isNull() | (F.col("seq") < F.col("first_detail"))

    def last(name: str, ok: Column) -> Column:
        return F.max_by(name, F.when(ok, F.col("seq"))).alias(name)

    return o.groupBy(by).agg(
        last("title", open_ & (F.coalesce("title", F.lit("")) != "")), last("authors", open_ & (F.size("authors") > 0)), last("source", open_ & (F.coalesce("source", F.lit("")) != "")),
        last("year", open_ & (F.col("year") > 0)), last("abstract", F.coalesce("abstract", F.lit("")) != ""), last("cited", F.col("cited").isNotNull()), last("doi", F.coalesce("doi", F.lit("")) != ""),
        F.max("seq").alias("last_seq"), F.count_if("is_detail").alias("details"),
    )
