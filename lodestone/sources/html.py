"""HTML pages: visible text, title, headings with offsets, links and meta values.

Real pages leave tags open, so the parser is the standard library's; it runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.cluster import ship

MAX_BYTES = 8 << 20
DROPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "li", "tr", "td", "th", "table", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "header", "footer", "main", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []  # (heading level or 0, text)
        self.part: list[str] = []
        self.level, self.skip, self.title_open = 0, [], False
        self.title, self.links, self.meta = "", [], {}

    def flush(self) -> None:
        text = " ".join("".join(self.part).split())
        if text:
            self.blocks.append((self.level, text))
        self.part = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "meta" and a.get("name"):
            self.meta.setdefault(a["name"].lower(), a.get("content") or "")
        if tag in VOID:
            if tag == "br":
                self.part.append(" ")
            return
        hidden = tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style") or "")
        if hidden or self.skip:
            self.skip.append(tag)
            return
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BLOCKS:
            self.flush()
            self.level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
            self.title_open = tag == "title"

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag in BLOCKS:
            if tag == "title":
                self.title, self.part = " ".join("".join(self.part).split()), []
                self.title_open = False
                return
            self.flush()
            self.level = 0

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.part.append(data)


def read_page(markup: str, url: str = "") -> dict:
    """title, text (blocks with a blank line between), sections (level, title, offset), links, meta."""
    if len(markup.encode()) > MAX_BYTES:
        return {"title": "", "text": "", "sections": [], "links": [], "error": "RESPONSE_TOO_LARGE"}
    page = _Page()
    page.feed(markup)
    page.close()
    page.flush()
    sections, at = [], 0
    for level, text in page.blocks:
        if level:
            sections.append({"level": level, "title": text, "offset": at})
        at += len(text) + 2
    links = []
    for href in page.links:
        try:
            links.append(urljoin(url, href))
        except ValueError:
            continue
    return {"title": page.title, "text": "\n\n".join(t for _, t in page.blocks), "sections": sections, "links": links, "error": None}


def slices(sizes: Iterable[int], rows: int = 256, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) of neighbours with at most so many rows, ended by the one that reaches the size.

    A batch holds thousands of pages; read in such ranges, a worker holds what it has made of one range only.
    """
    start = end = held = 0
    for end, n in enumerate(sizes, 1):
        held += n
        if end - start >= rows or held >= size:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


_KINDS = pa.struct([("level", pa.int32()), ("title", pa.string()), ("offset", pa.int64())])


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (page_id, url, html) to batches of fewer rows of parsed()."""
    for batch, (start, end) in ((b, s) for b in batches for s in slices(n or 0 for n in pc.binary_length(b.column(2)).to_pylist())):
        part = batch.slice(start, end - start)
        rows = [read_page(h.as_py() or "", u.as_py() or "") for u, h in zip(part.column(1), part.column(2), strict=True)]
        col = lambda k, t: pa.array([r[k] for r in rows], t)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), col("title", pa.string()), col("text", pa.string()), col("sections", pa.list_(_KINDS)), col("links", pa.list_(pa.string())), col("error", pa.string())],
            ["page_id", "title", "text", "sections", "links", "error"],
        )


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, title, text, sections, links, error)."""
    kind = pages.schema[page_id].dataType.simpleString()

    ship(pages.sparkSession)
    schema = f"page_id {kind}, title string, text string, sections array<struct<level:int,title:string,offset:bigint>>, links array<string>, error string"
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(read_batches, schema)
