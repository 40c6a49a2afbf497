"""Citation formats as Columns over papers; missing values show fixed placeholders."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.numbering import numbered
from lodestone.plans.expression import QueryError

# Placeholders, type words in the order they are tested, tags of the tagged formats.
NO_AUTHORS, NO_SOURCE, NO_YEAR = "[作者未取得]", "[来源未取得]", "[年份未取得]"
TYPES = (
    ("会议", "C", "paper-conference", "inproceedings", "CONF"), ("博士", "D", "thesis", "phdthesis", "THES"), ("硕士", "D", "thesis", "mastersthesis", "THES"),
    ("学位", "D", "thesis", "misc", "THES"), ("报纸", "N", "article-newspaper", "misc", "NEWS"), ("期刊", "J", "article-journal", "article", "JOUR"), ("图书", "M", "book", "book", "BOOK"),
)
OTHER = ("Z", "document", "misc", "GEN")
ENDNOTE_KINDS = {"J": "Journal Article", "D": "Thesis", "C": "Conference Paper", "N": "Newspaper Article", "M": "Book"}
FORMATS = ("gbt7714", "apa", "mla", "chicago", "vancouver", "bibtex", "ris", "endnote", "csl_json", "json", "csv", "markdown", "custom")
ALIASES = {"": "gbt7714", "gbt7714-2015": "gbt7714", "csl-json": "csl_json"}
TEMPLATE_FIELDS = ("title", "authors", "source", "journal", "year", "volume", "issue", "pages", "doi", "url", "record_ref", "type")


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def type_code(n: int) -> Column:
    """Code of the document type in system n: 0 letter, 1 CSL, 2 BibTeX, 3 RIS; the first word that occurs decides."""
    out = F.lit(OTHER[n])
    for word, *codes in reversed(TYPES):
        out = F.when(F.contains(_s("doc_type"), F.lit(word)), codes[n]).otherwise(out)
    return out


def authors_text(sep: str = ", ") -> Column:
    return F.coalesce(F.array_join("authors", sep), F.lit(""))


def year_text() -> Column:
    return F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year").cast("string")).otherwise("")


def _or(c: Column, placeholder: str) -> Column:
    return F.when(c == "", placeholder).otherwise(c)


def _tail() -> Column:
    issue = F.when(_s("issue") != "", F.concat(F.lit("("), _s("issue"), F.lit(")"))).otherwise("")
    pages = F.when(_s("pages") != "", F.concat(F.lit(": "), _s("pages"))).otherwise("")
    return F.concat(_s("volume"), issue, pages)


def styled(style: str) -> Column:
    """gbt7714, apa, mla, chicago or vancouver; n is the number of the paper."""
    n, a, t, c, s, y = F.col("n").cast("string"), _or(authors_text(), NO_AUTHORS), _s("title"), type_code(0), _or(_s("source"), NO_SOURCE), _or(year_text(), NO_YEAR)
    body, sep = {
        "gbt7714": (("[", n, "] ", a, ". ", t, "[", c, "]. ", s, ", ", y), ", "),
        "apa": ((a, ". (", y, "). ", t, ". ", s), ", "),
        "mla": ((a, ". “", t, ".” ", s, ", ", y), ", "),
        "chicago": ((a, ". “", t, ".” ", s, " (", y, ")"), ": "),
        "vancouver": ((n, ". ", a, ". ", t, ". ", s, ". ", y), ";"),
    }[style]
    tail = F.when(_tail() == "", "").otherwise(F.concat(F.lit(sep), _tail()))
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in body], tail, F.lit("."))


def _lines(*parts: Column) -> Column:
    """Lines joined, null ones left out."""
    return F.concat_ws("\n", *parts)


def bibtex() -> Column:
    kind = type_code(2)
    place = F.when(kind == "article", "journal").when(kind == "inproceedings", "booktitle").when(kind.isin("phdthesis", "mastersthesis"), "school").otherwise("publisher")

    def field(name: Column | str, value: Column, plain: bool = False) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        shown = F.regexp_replace(F.replace(F.replace(value, F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D")), "[\n\r]", "") if plain else tx.bib_text(value)
        return F.when(value != "", F.concat(F.lit("  "), name, F.lit(" = {"), shown, F.lit("},")))

    names = F.array_join(F.transform("authors", lambda x: F.concat(F.lit("{"), tx.bib_text(x), F.lit("}"))), " and ")
    keywords = F.coalesce(F.array_join("keywords", "; "), F.lit(""))
    return _lines(
        F.concat(F.lit("@"), kind, F.lit("{"), F.col("ref"), F.lit(",")), F.when(F.size("authors") > 0, F.concat(F.lit("  author = {"), names, F.lit("},"))),
        field("title", _s("title")), field("year", year_text()), field("volume", _s("volume")), field("number", _s("issue")), field("pages", _s("pages")), field("abstract", _s("abstract")),
        field("keywords", keywords), field("doi", _s("doi"), True), field("url", _s("url"), True), field(place, _s("source")), F.lit("}"),
    )


def tagged(style: str) -> Column:
    """RIS or EndNote."""
    ris = style == "ris"
    code = type_code(0)
    kind = F.lit("Generic")
    for c, name in ENDNOTE_KINDS.items():
        kind = F.when(code == c, name).otherwise(kind)
    pages = F.split(_s("pages"), "-")
    last = F.when(F.size(pages) > 1, F.element_at(pages, -1)).otherwise("")
    none = F.array().cast("array<string>")
    rows = (
        ("TI", "%T", F.array(_s("title"))), ("AU", "%A", F.coalesce("authors", none)), ("JO", "%J", F.array(_s("source"))), ("PY", "%D", F.array(year_text())),
        ("VL", "%V", F.array(_s("volume"))), ("IS", "%N", F.array(_s("issue"))), ("SP", "", F.array(F.element_at(pages, 1))), ("EP", "", F.array(last)), ("", "%P", F.array(_s("pages"))),
        ("DO", "%R", F.array(_s("doi"))), ("UR", "%U", F.array(_s("url"))), ("AB", "%X", F.array(_s("abstract"))), ("KW", "%K", F.coalesce("keywords", none)),
    )
    head = F.concat(F.lit("TY  - "), type_code(3)) if ris else F.concat(F.lit("%0 "), kind)
    parts = [F.array(head)]
    for ris_key, end_key, values in rows:
        key = ris_key if ris else end_key
        if key:
            lead = f"{key}  - " if ris else f"{key} "
            parts.append(_with_lead(F.filter(values, lambda v: v != ""), lead))
    if ris:
        parts.append(F.array(F.lit("ER  -")))
    return F.array_join(F.concat(*parts), "\n")


def _with_lead(values: Column, lead: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(lead), tx.clean(v)))


def csl_json() -> Column:
    """Compact CSL-JSON of one paper; empty members are left out."""
    author = F.when(F.size("authors") > 0, F.transform("authors", lambda x: F.struct(x.alias("literal"))))
    issued = F.when(F.col("year") > 0, F.struct(F.array(F.array(F.col("year"))).alias("date-parts")))
    more = {"container-title": "source", "volume": "volume", "issue": "issue", "page": "pages", "DOI": "doi", "URL": "url", "abstract": "abstract"}
    members = [F.col("ref").alias("id"), type_code(1).alias("type"), _s("title").alias("title"), author.alias("author"), issued.alias("issued")]
    return F.to_json(F.struct(*members, *[F.nullif(_s(c), F.lit("")).alias(k) for k, c in more.items()]))


def csv_line() -> Column:
    """A CSV record; a value that a spreadsheet would run as a formula gets an apostrophe."""
    values = (_s("title"), authors_text("; "), _s("source"), year_text(), _s("volume"), _s("issue"), _s("pages"), _s("doi"), _s("url"))

    def cell(v: Column) -> Column:
        safe = F.when(v.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)
        return F.when(safe.rlike(r'[",\r\n]|^[ \t]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return F.concat_ws(",", *map(cell, values))


def markdown() -> Column:
    title = tx.markdown_text(_s("title"))
    return F.when(_s("url") != "", F.concat(F.lit("- ["), title, F.lit("]("), _s("url"), F.lit(")"))).otherwise(F.concat(F.lit("- "), title))


def custom(template: str) -> Column:
    """A template with {field} and doubled braces; anything else in braces is refused."""
    if len(template.encode()) > 5000 or "\0" in template or "\1" in template:
        raise QueryError("INVALID_TEMPLATE", "too long or with control characters")
    values = {
        "title": _s("title"), "authors": _or(authors_text(), NO_AUTHORS), "source": _or(_s("source"), NO_SOURCE), "journal": _s("source"), "year": year_text(), "volume": _s("volume"),
        "issue": _s("issue"), "pages": _s("pages"), "doi": _s("doi"), "url": _s("url"), "record_ref": F.col("ref"), "type": _s("doc_type"),
    }
    parts: list[Column] = []
    for piece in re.findall(r"\{\{|\}\}|\{[a-z_]+\}|[{}]|[^{}]+", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece in ("{", "}"):
            raise QueryError("INVALID_TEMPLATE", "only {field} is allowed in braces")
        elif piece[0] == "{":
            if piece[1:-1] not in values:
                raise QueryError("INVALID_TEMPLATE", f"unknown field {piece[1:-1]}")
            parts.append(values[piece[1:-1]])
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def missing_fields() -> Column:
    """Which of authors, source and year are missing, joined by commas."""
    flags = (F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, "authors"), F.when(_s("source") == "", "source"), F.when(F.coalesce("year", F.lit(0)) == 0, "year"))
    return F.concat_ws(",", *flags)


def citation(style: str, template: str = "") -> Column:
    """The citation of a paper; numbered styles need the column n."""
    style = ALIASES.get(style, style)
    if style not in FORMATS:
        raise QueryError("FORMAT_UNAVAILABLE", style)
    if style in ("gbt7714", "apa", "mla", "chicago", "vancouver"):
        return styled(style)
    if style in ("ris", "endnote"):
        return tagged(style)
    whole = ("ref", "title", "authors", "source", "year", "doc_type", "abstract", "keywords", "doi", "url", "volume", "issue", "pages")
    makers = {"bibtex": bibtex, "csl_json": csl_json, "csv": csv_line, "markdown": markdown, "custom": lambda: custom(template), "json": lambda: F.to_json(F.struct(*whole))}
    return makers[style]()


def listed(papers: DataFrame, order: str) -> DataFrame:
    """n from 1 in order for an export, a list of at most a thousand papers."""
    return papers.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).cast("long"))


def citations(papers: DataFrame, style: str = "gbt7714", template: str = "", order: str = "ref", number: Callable[[DataFrame, str], DataFrame] = numbered) -> DataFrame:
    """Rows (n, ref, text, missing_fields) of a whole table; for a short list give number=listed."""
    return number(papers, order).select("n", "ref", citation(style, template).alias("text"), missing_fields().alias("missing_fields"))


def joined(cited: DataFrame, style: str = "gbt7714", size: int | None = None) -> DataFrame:
    """All texts of an export in order as one row (text, count); CSV gets its header and CRLF.

    With a size, consecutive citations make exports of at most so many: (export, text, count).
    """
    sep = "\r\n" if style == "csv" else "\n\n"
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    body = F.array_join(texts, sep)
    if style == "csv":
        body = F.concat(F.lit("title,authors,source,year,volume,issue,pages,doi,url\r\n"), body, F.lit("\r\n"))
    if style in ("json", "csl_json"):
        body = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    grouped = cited.groupBy() if size is None else cited.groupBy(F.floor((F.col("n") - 1) / size).alias("export"))
    return grouped.agg(body.alias("text"), F.count(F.lit(1)).alias("count"))
