"""Projections, views, paging and text slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.cluster import written
from lodestone.functions import text as tx
from lodestone.operators import identity
from lodestone.plans.expression import QueryError


def fields(papers: DataFrame, names: list[str]) -> DataFrame:
    """The named fields; ref and title always, unknown names ignored."""
    return papers.select(*dict.fromkeys([c for c in ("ref", "title", *names) if c in papers.columns]))


def brief(papers: DataFrame) -> DataFrame:
    """Row of a list: missing values are empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return papers.select(
        "ref", text("title").alias("title"), F.coalesce(F.array_join("authors", "; "), F.lit("")).alias("authors"), text("source").alias("source"),
        F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year").cast("string")).otherwise("").alias("year"), text("doc_type").alias("doc_type"), text("cited").alias("cited"),
    )


def full_json(papers: DataFrame) -> DataFrame:
    """(ref, record): JSON of the members that are not empty."""
    members = []
    for name, kind in papers.dtypes:
        if kind.startswith("array"):
            members.append(F.when(F.size(name) > 0, F.col(name)).alias(name))
        else:
            members.append((F.nullif(F.col(name), F.lit("")) if kind == "string" else F.nullif(F.col(name), F.lit(0)) if name == "year" else F.col(name)).alias(name))
    return papers.select("ref", F.to_json(F.struct(*members)).alias("record"))


def view(rows: DataFrame, kind: str = "compact") -> DataFrame:
    """compact, titles or full; score and eligible only in full."""
    if kind == "titles":
        return rows.select("ref", "title")
    if kind == "compact":
        return brief(rows)
    if kind == "full":
        return full_json(rows)
    raise QueryError("INVALID_VIEW", kind)


def nonempty(df: DataFrame) -> DataFrame:
    """Columnar view: columns that are empty in every row are left out; one aggregate decides."""
    flags = df.agg(*[F.max(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if flags[c]])


def columnar(df: DataFrame, limit: int) -> dict:
    """At most `limit` rows as {fields, rows} without the columns that are empty in all of them."""
    rows = df.limit(limit).collect()
    names = [c for c in df.columns if any(r[c] not in (None, "", []) for r in rows)]
    return {"fields": names, "rows": [[r[c] for c in names] for r in rows]}


def quality_view(papers: DataFrame) -> DataFrame:
    """(ref, quality): JSON of tiers, impacts, metric year and the page's title where it is another name; a state where nothing is shown."""
    other = F.when(tx.source_key(F.coalesce("canonical", F.lit(""))) != tx.source_key(F.coalesce("source", F.lit(""))), F.nullif("canonical", F.lit("")))
    shown = F.struct(
        F.when(F.size("tiers") > 0, F.col("tiers")).alias("tiers"), F.col("composite").alias("composite_impact"), F.col("aggregate").alias("aggregate_impact"),
        F.when(F.col("metric_year") > 0, F.col("metric_year")).alias("metric_year"), other.alias("journal_page_title"),
    )
    text = F.to_json(shown)
    return papers.select("ref", F.when(F.col("state").isNotNull(), F.when(text == "{}", '{"state":"no_indexing_or_metrics_shown"}').otherwise(text)).alias("quality"))


def bind_details(papers: DataFrame, details: DataFrame, at: str = "detail_at") -> DataFrame:
    """papers with the values of their details where these have any, and detail_error: IDENTITY_CONFLICT where the detail is of another paper.

    Of several details of a ref the newest counts; details without a time are compared by their values, so
    that the choice does not depend on their order. A detail is bound if no identifier conflicts and
    titles, first authors and sources agree as far as both have them. What it lacks stays.
    """
    names = [c for c in papers.columns if c in details.columns and c != "ref"]
    rest = [c for c in details.columns if c != "ref"]
    last = F.struct(*([at] if at in rest else []), F.to_json(F.struct(*rest)))
    newest = details.groupBy("ref").agg(F.max_by(F.struct(*rest), last).alias("d"))
    both = papers.select("ref", F.struct(*papers.columns).alias("p")).join(newest, "ref", "left")

    def side(s: str, columns: list[str]) -> Column:
        """What identity compares, of the paper or its detail."""
        kinds = {"title": "string", "authors": "array<string>", "source": "string", "doi": "string", "dbname": "string", "filename": "string", "dbcode": "string"}
        have = {c: F.coalesce(F.col(f"{s}.{c}"), F.lit(None).cast(k)) if c in columns else F.lit(None).cast(k) for c, k in kinds.items()}
        keys = {"doi_key": tx.doi_key(F.coalesce(have["doi"], F.lit(""))), "native_key": tx.native_key(have["dbname"], have["filename"])}
        return F.struct(*(v.alias(c) for c, v in (have | keys).items()))

    both = both.withColumns({"a": side("p", papers.columns), "b": side("d", rest)})
    # a detail without a title of its own says nothing against the paper's
    if "title" not in rest:
        both = both.withColumn("b", F.col("b").withField("title", F.col("a.title")))
    same = identity.detail_matches("a", "b")

    def merged(name: str) -> Column:
        new = F.col(f"d.{name}")
        empty = F.size(new) <= 0 if dict(papers.dtypes)[name].startswith("array") else new.cast("string") == ""
        return F.when(F.coalesce(F.col("d").isNotNull() & same & new.isNotNull() & ~empty, F.lit(False)), new).otherwise(F.col(f"p.{name}")).alias(name)

    error = F.when(F.col("d").isNotNull() & ~F.coalesce(same, F.lit(False)), "IDENTITY_CONFLICT").alias("detail_error")
    return both.select(*[merged(c) if c in names else F.col(f"p.{c}").alias(c) for c in papers.columns], error)


def with_details(papers: DataFrame, details: DataFrame) -> DataFrame:
    """papers with what their details add; one row for each paper."""
    return bind_details(papers, details).drop("detail_error")


def located(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """(ref, found, error) of papers among listed rows of the same title: one whose identity agrees, or why there is none.

    papers and rows have keys (with_keys); a paper without any key takes the one row that has its title.
    Rows that agree in title and all identifiers are one class with its number, and papers meet classes by
    title and key, so neither a common title nor many copies make pairs. Titles are compared by the SHA-256 of
    their keys, and both sides are written, so that each title is read once and none is shuffled.
    """
    title, low = F.sha2(tx.title_key("title"), 256).alias("key"), F.lower(F.coalesce("dbcode", F.lit(""))).alias("dbcode")
    of_class = written(rows.select(title, "doi_key", "native_key", low, "bib_key", "ref").groupBy("key", "doi_key", "native_key", "dbcode", "bib_key").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("first")), "listed")
    mine = written(papers.select("ref", title, "doi_key", "native_key", low, "bib_key"), "asked")
    a = mine.select("ref", "key", F.struct("doi_key", "native_key", "dbcode", "bib_key").alias("a"), F.explode(identity.identity_keys()).alias("id"))
    b = of_class.select("key", F.struct("doi_key", "native_key", "dbcode", "bib_key", "n", "first").alias("b"), F.explode(identity.identity_keys()).alias("id"))
    keyed = a.join(b, ["key", "id"]).where(identity.same_paper("a", "b")).select("ref", "b").distinct().select("ref", "b.n", "b.first")
    per_title = of_class.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    bare = mine.where(F.size(identity.identity_keys()) == 0).join(per_title, "key").select("ref", "n", "first")
    per_ref = keyed.union(bare).groupBy("ref").agg(F.sum("n").alias("n"), F.min("first").alias("found"))
    error = F.when(F.col("n").isNull(), "DOCUMENT_NOT_FOUND").when(F.col("n") > 1, "IDENTITY_AMBIGUOUS")
    return mine.select("ref").join(per_ref, "ref", "left").select("ref", F.when(F.col("n") == 1, F.col("found")).alias("found"), error.alias("error"))


def page_of(entries: DataFrame, scope: str = "candidates", offset: int = 0, limit: int = 50) -> DataFrame:
    """Entries of a scope by rank from offset; a bounded page, so the sort keeps offset + limit rows a task."""
    if scope not in ("candidates", "eligible", "selected"):
        raise QueryError("INVALID_OPTION", scope)
    kept = entries if scope == "candidates" else entries.where(scope)
    return kept.orderBy("rank").offset(offset).limit(limit)


def in_order(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """papers of requested refs (pos, ref), unknown refs left out; pos keeps the request's order."""
    return refs.join(papers, "ref")


def title_status(titles: DataFrame, papers: DataFrame) -> DataFrame:
    """(title, status, refs) of requested titles: not_found, one or ambiguous."""
    asked = titles.select("title", tx.title_key("title").alias("key")).distinct()
    stored = papers.select(tx.title_key("title").alias("key"), "ref")
    # counting before the join to texts keeps a title that many papers share to one row
    per_key = stored.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("first_ref"))
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "one").otherwise("ambiguous")
    return asked.join(per_key, "key", "left").select("title", status.alias("status"), F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("first_ref")).alias("ref"))


def text_slice(text: Column | str, offset: int = 0, limit: int = 8000) -> Column:
    """Characters from offset; code points."""
    c = F.col(text) if isinstance(text, str) else text
    return F.substr(c, F.lit(offset + 1), F.lit(limit))


def text_pages(docs: DataFrame, text: str = "text", limit: int = 8000) -> DataFrame:
    """A row per page: docs' columns but the text, offset, page, next_offset (null on the last)."""
    n = F.greatest(F.char_length(text), F.lit(1))
    starts = F.sequence(F.lit(0), n - 1, F.lit(limit))
    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, F.col(text), F.explode(starts).alias("offset"))
    following = F.when(F.col("offset") + limit < F.char_length(text), F.col("offset") + limit)
    return out.select(*rest, F.col("offset").cast("long").alias("offset"), F.substr(text, F.col("offset") + 1, F.lit(limit)).alias("page"), following.cast("long").alias("next_offset"))


def section_lengths(sections: DataFrame, by: str = "snapshot_id") -> DataFrame:
    """sections (by, level, title, offset, total) with length: up to two characters before the next heading of the same or a higher level.

    Per level one running minimum from the end gives the next offset; levels are 1 to 6.
    """
    later = Window.partitionBy(by).orderBy("offset").rowsBetween(1, Window.unboundedFollowing)
    following = F.lit(None).cast("long")
    for level in range(6, 0, -1):
        following = F.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("offset"))).over(later)).otherwise(following)
    return sections.withColumn("next", following).withColumn("length", F.coalesce(F.col("next") - 2, F.col("total")) - F.col("offset")).drop("next")


def missing_headings(catalog: Column, body: Column) -> Column:
    """Headings of the catalog whose key is not in the body; missing headings on either side do not count."""
    keys = F.transform(F.filter(body, lambda h: h.isNotNull()), tx.title_key)
    return F.filter(catalog, lambda h: h.isNotNull() & ~F.array_contains(keys, tx.title_key(h)))
