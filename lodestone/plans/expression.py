"""Boolean field expressions: validation, branches, Column, text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as tx

# Field names and their codes.
FIELDS = {
    "subject": "SU", "title": "TI", "keywords": "KY", "abstract": "AB", "authors": "AU", "first_author": "FI", "corresponding_author": "RP", "institutions": "AF",
    "source": "LY", "doi": "DOI", "funds": "FU", "fulltext": "FT", "references": "RF", "classification": "CLC", "subtitle": "ST", "title_keywords_abstract": "TKA",
}
MAX_NODES, MAX_DEPTH, MAX_ITEMS, MAX_BRANCHES, MAX_VALUE = 96, 8, 12, 32, 120
TEXT_FIELDS = {"title": "title", "abstract": "abstract", "source": "source", "doi": "doi", "fulltext": "body"}
LIST_FIELDS = {"keywords": "keywords", "authors": "authors", "institutions": "institutions", "funds": "funds"}
WIDE = ("title", "keywords", "abstract")


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Expression:
    """A condition (field, value, match) or an operator over items."""

    field: str = ""
    value: str = ""
    match: str = ""
    op: str = ""
    items: tuple[Expression, ...] = ()


def as_expression(fields: dict) -> Expression:
    """An expression from its fields, such as a stored one."""
    return Expression(**(fields | {"items": tuple(as_expression(x) for x in fields["items"])}))


def term(name: str, value: str, match: str = "phrase") -> Expression:
    return Expression(name, value, match)


def _joined(op: str, items: list[Expression]) -> Expression:
    return items[0] if len(items) == 1 else Expression(op=op, items=tuple(items))


def all_of(*items: Expression) -> Expression:
    return _joined("and", list(items))


def any_of(*items: Expression) -> Expression:
    return _joined("or", list(items))


def none_of(item: Expression) -> Expression:
    return Expression(op="not", items=(item,))


def of_concepts(name: str, groups: list[list[str]]) -> Expression:
    """AND over groups of OR over terms."""
    return all_of(*[any_of(*[term(name, t) for t in g]) for g in groups])


def _checked(e: Expression) -> None:
    if not e.op:
        if e.field not in FIELDS or not e.value.strip() or len(e.value) > MAX_VALUE or e.items:
            raise QueryError("INVALID_CONDITION", "unknown field or empty or long value")
        if e.match not in ("", "phrase", "exact"):
            raise QueryError("INVALID_MATCH", "match is phrase or exact")
    elif e.value or e.field:
        raise QueryError("INVALID_EXPRESSION", "an operator takes no field")
    elif e.op == "not" and len(e.items) != 1:
        raise QueryError("INVALID_NOT", "not takes one item")
    elif e.op != "not" and (e.op not in ("and", "or") or not 2 <= len(e.items) <= MAX_ITEMS):
        raise QueryError("INVALID_OPERATOR", f"and, or take 2 to {MAX_ITEMS} items")


Literal = tuple[Expression, bool]


def branches(e: Expression) -> list[list[Literal]]:
    """Disjunctive normal form as lists of (condition, negative), for checks and reports; Catalyst runs the tree."""
    seen = 0

    def expand(x: Expression, negative: bool, depth: int) -> list[list[Literal]]:
        nonlocal seen
        seen += 1
        if depth > MAX_DEPTH or seen > MAX_NODES:
            raise QueryError("QUERY_TOO_COMPLEX", f"at most {MAX_NODES} nodes and {MAX_DEPTH} levels")
        _checked(x)
        if not x.op:
            return [[(x, negative)]]
        if x.op == "not":
            return expand(x.items[0], not negative, depth + 1)
        parts = [expand(i, negative, depth + 1) for i in x.items]
        if (x.op == "or") != negative:
            out = [b for p in parts for b in p]
        else:
            out = [[]]
            for p in parts:
                out = [a + b for a in out for b in p]
                if len(out) > MAX_BRANCHES:
                    break
        if len(out) > MAX_BRANCHES:
            raise QueryError("QUERY_TOO_COMPLEX", f"more than {MAX_BRANCHES} branches")
        return out

    return expand(e, False, 0)


def validate(e: Expression) -> list[list[Literal]]:
    """Branches with positive conditions first; every branch needs one."""
    out = []
    for b in branches(e):
        if all(negative for _, negative in b):
            raise QueryError("UNBOUNDED_QUERY", "every branch needs a positive condition")
        for x, _ in b:
            if x.field == "subject" and x.match == "exact":
                raise QueryError("QUERY_UNSUPPORTED", "subject has no exact match")
            if "'" in x.value and '"' in x.value:
                raise QueryError("QUERY_UNSUPPORTED", "a value with both kinds of quotes cannot be quoted")
        out.append(sorted(b, key=lambda x: x[1]))
    return out


def anchor(e: Expression) -> str:
    """A positive term of the expression."""
    if not e.op:
        return e.value
    return next((anchor(i) for i in e.items if i.op != "not"), "")


def _leaf(e: Expression) -> Column:
    want, exact = tx.normalize(F.lit(e.value)), e.match == "exact"

    def text(name: str) -> Column:
        have = tx.normalize(F.col(name))
        return have == want if exact else F.contains(have, want)

    def some(name: str) -> Column:
        return F.exists(name, lambda x: (tx.normalize(x) == want) if exact else F.contains(tx.normalize(x), want))

    if e.field in ("subject", "title_keywords_abstract"):
        hit = reduce(lambda a, b: a | b, [F.coalesce(some(n) if n in LIST_FIELDS else text(n), F.lit(False)) for n in WIDE])
    elif e.field in TEXT_FIELDS:
        hit = text(TEXT_FIELDS[e.field])
    elif e.field in LIST_FIELDS:
        hit = some(LIST_FIELDS[e.field])
    elif e.field == "first_author":
        first = tx.normalize(F.try_element_at("authors", F.lit(1)))
        hit = first == want if exact else F.contains(first, want)
    else:
        raise QueryError("QUERY_UNSUPPORTED", f"{e.field} is not stored")
    return F.coalesce(hit, F.lit(False))  # so that NOT of an unknown value is true


def predicate(e: Expression) -> Column:
    """The expression as a two-valued predicate."""
    if not e.op:
        return _leaf(e)
    if e.op == "not":
        return ~predicate(e.items[0])
    return reduce((lambda a, b: a & b) if e.op == "and" else (lambda a, b: a | b), map(predicate, e.items))


def printed(e: Expression) -> str:
    """SU='a' AND (TI=='b' OR NOT KY='c')."""
    if not e.op:
        return f"{FIELDS[e.field]}{'==' if e.match == 'exact' else '='}'{e.value}'"
    if e.op == "not":
        inner = printed(e.items[0])
        return f"NOT ({inner})" if e.items[0].op else f"NOT {inner}"
    return f" {e.op.upper()} ".join(f"({printed(i)})" if i.op in ("and", "or") else printed(i) for i in e.items)
