"""From a query in words or concept groups to channels."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .expression import Expression, QueryError, of_concepts

MAX_GROUPS, MAX_TERMS, MAX_TERM = 8, 6, 80
# Opening words of a request, separators of concepts, words of time after a number.
REQUEST = re.compile("^(?:请|帮我|检索|搜索|研究一下|关于|有关|查找|分析一下|一下)+")
SEPARATOR = re.compile(r"\s+and\s+|[、，；,;]+", re.IGNORECASE)
TIME_WORDS = "月日年次个分时"
_WIFI = re.compile(r"wi[- ]?fi\s*([0-9]+)", re.IGNORECASE)
_IEEE = re.compile(r"(?:ieee\s*)?p?(802\.[0-9]+[a-z]*)", re.IGNORECASE)
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


@dataclass(frozen=True)
class Options:
    """Limits of a search; each has a default and a largest value."""

    query: str = ""
    mode: str = "balanced"
    limit: int = 20
    year_from: int = 0
    year_to: int = 0
    sort: str = "relevance"
    view: str = "compact"
    target: int = 300
    max_pages: int = 5
    metadata: str = "ranked"
    freshness: str = "prefer_cache"

    def checked(self) -> Options:
        if not 1 <= len(self.query) <= 1000:
            raise QueryError("INVALID_QUERY", "1 to 1000 characters")
        if self.mode not in ("precise", "balanced", "broad"):
            raise QueryError("INVALID_MODE", self.mode)
        if not 0 <= self.limit <= 100:
            raise QueryError("INVALID_LIMIT", "0 to 100 rows")
        for y in (self.year_from, self.year_to):
            if y and not 1800 <= y <= 2200:
                raise QueryError("INVALID_YEAR", str(y))
        if self.year_from and self.year_to and self.year_from > self.year_to:
            raise QueryError("INVALID_YEAR", "from is after to")
        if self.sort not in ("relevance", "date", "citations", "downloads"):
            raise QueryError("INVALID_SORT", self.sort)
        if self.view not in ("compact", "titles", "full"):
            raise QueryError("INVALID_VIEW", self.view)
        if not (1 <= self.target <= 3000 and 1 <= self.max_pages <= 100) or self.metadata not in ("basic", "ranked", "all"):
            raise QueryError("INVALID_OPTION", "target, max_pages or metadata")
        return self


@dataclass(frozen=True)
class Channel:
    id: str
    expression: Expression
    weight: float = 1.0
    reason: str = ""


@dataclass(frozen=True)
class Plan:
    concepts: list[list[str]]
    channels: list[Channel]
    method: str


def _unique(terms: list[str]) -> list[str]:
    first: dict[str, str] = {}
    for t in terms:
        if t.strip():
            first.setdefault(" ".join(t.split()).lower(), t.strip())
    return list(first.values())


def aliases(text: str) -> list[str]:
    """Spellings of version identifiers, unless the number belongs to a date."""
    out = [text.strip()]
    if m := _WIFI.search(text):
        if text[m.end() : m.end() + 1] not in tuple(TIME_WORDS):
            out += [text[: m.start()] + v + m[1] + text[m.end() :] for v in ("Wi-Fi ", "WiFi", "Wi-Fi")]
    if m := _IEEE.search(text):
        out += [text.replace(m[0], v + m[1], 1) for v in ("", "IEEE ", "IEEE P")]
    return _unique(out)


def lexical_parts(query: str) -> list[str]:
    """Concepts between explicit separators; neighbouring words without Han characters stay together."""
    out = []
    for segment in SEPARATOR.split(query):
        parts: list[str] = []
        for word in segment.split():
            if parts and not _HAN.search(word) and not _HAN.search(parts[-1]):
                parts[-1] += " " + word
            else:
                parts.append(word)
        out += parts
    return out


def make_plan(query: str = "", concept_groups: list[list[str]] | None = None) -> Plan:
    """Three channels that each ask for all concepts."""
    groups, method = concept_groups or [], "explicit"
    if not groups:
        stripped = REQUEST.sub("", query).strip().strip("？?。")
        groups = [aliases(p) for p in lexical_parts(stripped) if p.strip()] or [aliases(query)]
        method = "lexical"
    if len(groups) > MAX_GROUPS:
        raise QueryError("INVALID_PLAN", f"at most {MAX_GROUPS} groups")
    for g in groups:
        if not 1 <= len(g) <= MAX_TERMS:
            raise QueryError("INVALID_PLAN", f"1 to {MAX_TERMS} terms a group")
        if any(not t.strip() or len(t) > MAX_TERM for t in g):
            raise QueryError("INVALID_PLAN", f"1 to {MAX_TERM} characters a term")
    groups = [_unique(g) for g in groups]
    channels = [Channel(f"q{n}", of_concepts(f, groups), 1.0, f) for n, f in enumerate(("subject", "title", "keywords"), 1)]
    return Plan(groups, channels, method)


def search_input(query: str = "", concept_groups=None, expression: Expression | None = None, **options) -> tuple[Options, Plan]:
    """Either an expression or words and groups; an expression is searched precisely and without enrichment."""
    if (expression is not None) == bool(query or concept_groups):
        raise QueryError("INVALID_QUERY", "either an expression or a query")
    if expression is not None:
        o = replace(Options(query="expression", **options), mode="precise", metadata="basic", target=50)
        return o.checked(), Plan([], [Channel("q1", expression, 1.0, "structured")], "structured")
    return Options(query=query or " ".join(g[0] for g in concept_groups), **options).checked(), make_plan(query, concept_groups)
