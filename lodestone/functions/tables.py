"""Table functions for SQL: rows of result lists, sections of pages, marked titles of texts.

register() makes them callable in a lateral join: SELECT p.page_id, g.* FROM pages p, LATERAL
read_grid(p.html, p.url) g. A call sees one row; a null text or a page that cannot be read gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestone.cluster import ship

ROW = "pos: int, title: string, authors: array<string>, source: string, year: int, doc_type: string, cited: bigint, url: string"


@udtf(returnType=ROW)
class ReadGrid:
    """Rows of a result list."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        from lodestone.sources.records import read_grid

        for pos, r in enumerate(read_grid(html or "", base or "")["rows"]):
            yield pos, r["title"], r["authors"], r["source"], r["year"], r["doc_type"], r["cited"], r["url"]


@udtf(returnType="pos: int, level: int, title: string, offset: bigint")
class PageSections:
    """Headings of a page with their places in its text."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        from lodestone.sources.html import read_page

        for pos, s in enumerate(read_page(html or "", url or "")["sections"] or []):
            yield pos, s["level"], s["title"], s["offset"]


@udtf(returnType="pos: int, start: int, end: int, title: string")
class MarkedTitles:
    """Outermost marked titles of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        from lodestone.operators.links import reference_spans

        for pos, (start, end, title) in enumerate(reference_spans(text or "")):
            yield pos, start, end, title


FUNCTIONS = {"read_grid": ReadGrid, "page_sections": PageSections, "marked_titles": MarkedTitles}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    ship(spark)
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
